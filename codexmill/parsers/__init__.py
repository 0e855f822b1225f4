"""Parsers of publication formats: plain Python on one document, without Spark."""
