"""Part of codexmill; see README."""
