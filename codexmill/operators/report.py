"""Corpus report as JSON: one record of the whole run, and one a book."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.operators.inventory import corpus_totals

#: Name and version of the records' form.
SCHEMA = "codexmill.corpus-report.v1"


def report_records(summary: DataFrame, corpus: str) -> DataFrame:
    """JSON records (place, json): 0 the run with its totals, 1 each book of ``summary`` (``inventory.book_summary``).

    A corpus may have any number of books, so that books are records of their own and not one list in one task.
    """
    run = corpus_totals(summary).select(F.lit(0).alias("place"), F.lit("").alias("pub_id"), F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.lit(corpus).alias("corpus"), F.struct("*").alias("totals"))).alias("json"))
    books = summary.select(F.lit(1).alias("place"), "pub_id", F.to_json(F.struct(F.lit(SCHEMA).alias("schema"), F.struct("*").alias("book"))).alias("json"))
    return run.unionByName(books)


def write_report(summary: DataFrame, corpus: str, directory: str) -> None:
    """Writes the records as lines of JSON, the run first."""
    report_records(summary, corpus).repartitionByRange("place", "pub_id").sortWithinPartitions("place", "pub_id").select("json").write.mode("overwrite").text(directory)
