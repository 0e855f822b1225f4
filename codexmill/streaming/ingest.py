"""Incremental ingest: newly arrived books run through the batch analysis and are appended to the fact tables.

Each micro-batch overwrites its own partition (``batch``) of every table, so a replayed batch leaves the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codexmill.sources.books import analyse, book_tables

SOURCE = "path string, modificationTime timestamp, length bigint, content binary"


def arriving_books(spark: SparkSession, directory: str, suffix: str = "epub", per_batch: int = 100) -> DataFrame:
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.readStream.format("binaryFile").schema(SOURCE).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).load(directory)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("pub_id"), "content")


def ingest(spark: SparkSession, directory: str, output: str, checkpoint: str) -> StreamingQuery:
    """Starts the ingest of all books that are there and ends when they are done."""

    def write(batch: DataFrame, number: int) -> None:
        for name, table in book_tables(analyse(batch)).items():
            table.write.mode("overwrite").parquet(f"{output}/{name}/batch={number}")

    return arriving_books(spark, directory).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
