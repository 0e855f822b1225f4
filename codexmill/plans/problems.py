"""Queries of the core training-data operators (problems 1 to 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.operators import hierarchy, nested, orphans, timestamps
from codexmill.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.flatten_nodes(table(spark, d, "annotation_sets"), scalars=False).select("set_key", "node_path", "parent_path", "node_kind")


def p1_selectors(spark: SparkSession, d: str) -> DataFrame:
    return nested.annotation_tables(table(spark, d, "annotation_sets"))["selector"]


def p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return nested.annotation_tables(table(spark, d, "annotation_sets"))["body"]


def p1_targets(spark: SparkSession, d: str) -> DataFrame:
    return nested.annotation_tables(table(spark, d, "annotation_sets"))["target"]


def p1_annotations(spark: SparkSession, d: str) -> DataFrame:
    return nested.annotation_tables(table(spark, d, "annotation_sets"))["annotation"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    values = timestamps.publication_dates(table(spark, d, "metadata_elements"), table(spark, d, "metas"))
    return timestamps.normalise(values, table(spark, d, "feeds")).select("tab", "row_key", "utc_us")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.publication_orphans(*(table(spark, d, t) for t in ("declarations", "reading_order", "metas", "metadata_elements")))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(p4_found(spark, d))


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    edges = hierarchy.fallback_edges(table(spark, d, "declarations")).unionByName(hierarchy.navigation_edges(table(spark, d, "nav_points")))
    return hierarchy.resolve_hierarchy(edges)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _hierarchy(spark, d).select("tree", "node_key", "root_key", "depth", "cycle_state", F.concat_ws("/", F.transform("path", lambda x: x.cast("string"))).alias("node_path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy.descendants(_hierarchy(spark, d)).groupBy("tree", "ancestor").agg(F.count(F.lit(1)).alias("n_descendants"), F.max("distance").alias("height"))


QUERIES = {f.__name__: f for f in (p1_found, p1_annotations, p1_targets, p1_selectors, p1_bodies, p3_found, p4_found, p4_report, p5_found, p5_descendants)}
