"""Lookups, coverage views and set operations on the catalog tables.

Lookups are filters or equi-joins on keys; coverage works on (state, issue) columns, where a state is complete, partial,
unavailable or not_applicable, so that unknown never looks like absent.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.operators.inventory import numbered
from codexmill.session import Scratch


def resource_at(resources: DataFrame, kind: str, address: str) -> DataFrame:
    return resources.where((F.col("address_kind") == kind) & (F.col("address") == address))


def resource_by_path(resources: DataFrame, path: str) -> DataFrame:
    return resource_at(resources, "local", path)


def declarations_with_id(typed: DataFrame, id_: str) -> DataFrame:
    """All declarations that carry the id, which is normalised like theirs."""
    return typed.where(F.col("manifest_id") == V.manifest_id(F.lit(id_)))


def declaration_by_id(typed: DataFrame, id_: str) -> DataFrame:
    """The declaration of the id in each book where it is the only one."""
    found = declarations_with_id(typed, id_)
    return found.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("pub_id"))).where(F.col("n") == 1).drop("n")


def manifest_resources(resources: DataFrame) -> DataFrame:
    return resources.where(F.col("n_declarations") > 0)


def elements_of(elements: DataFrame, kind: str) -> DataFrame:
    """Dublin Core elements of one kind; ``ord`` tells their order."""
    return elements.where(F.col("kind") == kind)


def legacy_cover_ids(opf2_metas: DataFrame) -> DataFrame:
    """Content of the first legacy meta named cover, in any case."""
    return opf2_metas.where(F.lower("name") == "cover").groupBy("pub_id").agg(F.min_by("content", "ord").alias("cover_id"))


def list_of(points: DataFrame, semantic: str) -> DataFrame:
    """Points of the first list with the semantic; list_index and point_path tell their order."""
    first = points.where(F.col("semantic") == semantic).groupBy("pub_id").agg(F.min("list_index").alias("list_index"))
    return points.join(first, ["pub_id", "list_index"], "left_semi")


def auxiliary_lists(points: DataFrame) -> DataFrame:
    return points.where(F.col("semantic").isNull() | ~F.col("semantic").isin("toc", "page-list", "landmarks"))


def incoming_references(references: DataFrame, resources: DataFrame) -> DataFrame:
    """References with the resource they reach."""
    r = resources.select(F.col("pub_id").alias("r_pub"), F.col("address").alias("r_address"), "resource_ord")
    return references.join(r, (F.col("pub_id") == F.col("r_pub")) & (F.col("target_address") == F.col("r_address"))).drop("r_pub", "r_address")


def fragment_existence(references: DataFrame, fragments: DataFrame, contents: DataFrame) -> DataFrame:
    """``exists`` of each referenced fragment: true, false or, where the target was not read whole, null."""
    ids = fragments.select(F.col("pub_id").alias("f_pub"), F.col("path").alias("f_path"), F.col("id").alias("f_id")).distinct()
    read = contents.select(F.col("pub_id").alias("c_pub"), F.col("path").alias("c_path"), "content_state")
    j = references.join(ids, (F.col("pub_id") == F.col("f_pub")) & (F.col("target_address") == F.col("f_path")) & (F.col("fragment") == F.col("f_id")), "left")
    j = j.join(read, (F.col("pub_id") == F.col("c_pub")) & (F.col("target_address") == F.col("c_path")), "left")
    exists = F.when(F.col("fragment").isNull(), None).when(F.col("f_id").isNotNull(), True).when(F.col("content_state") == "complete", False)
    return j.select(*references.columns, exists.alias("exists"))


def move_impact(references: DataFrame, typed: DataFrame) -> DataFrame:
    """What a move of each local resource touches: references from elsewhere, and its own relative references."""
    own = typed.where(F.col("address_kind") == "local").select("pub_id", "address").distinct()
    incoming = references.where(~F.col("source_address").eqNullSafe(F.col("target_address"))).groupBy("pub_id", F.col("target_address").alias("address")).agg(F.count(F.lit(1)).alias("incoming"))
    relative = references.where(V.href_class(F.col("declared")).isin("local", "same-document", "empty")).groupBy("pub_id", F.col("source_address").alias("address")).agg(F.count(F.lit(1)).alias("outgoing"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return own.join(incoming, ["pub_id", "address"], "left").join(relative, ["pub_id", "address"], "left").select("pub_id", "address", zero("incoming"), zero("outgoing"))


def coverage(families: dict[str, DataFrame]) -> DataFrame:
    """Expected, complete, partial and unavailable of each family of (state, issue); what does not apply is not expected."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("family"), "state") for k, df in families.items()])
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.groupBy("family").agg(F.count_if(F.col("state") != "not_applicable").alias("expected"), n("complete"), n("partial"), n("unavailable"))


def issues(families: dict[str, DataFrame]) -> DataFrame:
    """How often each issue makes a result partial or unavailable."""
    rows = reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("area"), F.col("state").alias("kind"), "issue") for k, df in families.items()])
    return rows.where(F.col("kind").isin("partial", "unavailable")).groupBy("area", "kind", "issue").agg(F.count(F.lit(1)).alias("n"))


def incomplete(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("state").isin("complete", "not_applicable"))


def outcome(value: Column, state: Column) -> Column:
    """The value where there is one, partial ones included."""
    return F.when(state.isin("complete", "partial"), value)


def running_budget(resources: DataFrame, most_bytes: int, most_resources: int) -> DataFrame:
    """Resources in order with the state that their turn leaves them: complete, or unavailable by the limit on bytes or number. Null sizes take nothing."""
    placed = numbered(resources, "pub_id", ["resource_ord"], "_nth", Scratch(resources.sparkSession, "budget"), "size_bytes")
    cut = (F.col("_nth_sum") > most_bytes) | (F.col("_nth") >= most_resources)
    return placed.withColumns({"state": F.when(cut, "unavailable").otherwise("complete"), "issue": F.when(cut, "limit")}).drop("_nth", "_nth_sum")


def neighbours(order: DataFrame) -> DataFrame:
    """Occurrences with the ones before and behind them in the reading order of their book (by ro_ord, then key)."""
    placed = numbered(order.select("pub_id", "ro_ord", "itemref_key"), "pub_id", ["ro_ord", "itemref_key"], "n", Scratch(order.sparkSession, "neighbours")).select("pub_id", "itemref_key", "n")
    of = lambda step, name: placed.select("pub_id", (F.col("n") + step).alias("n"), F.col("itemref_key").alias(name))
    return placed.join(of(1, "previous"), ["pub_id", "n"], "left").join(of(-1, "following"), ["pub_id", "n"], "left").select("pub_id", "itemref_key", F.col("n").alias("place"), "previous", "following")


def candidates(refs: DataFrame, typed: DataFrame, ref: str, key: str) -> DataFrame:
    """(key, decl_key) of every declaration that an id reference may mean, ambiguous ones included."""
    ids = typed.where(F.col("manifest_id").isNotNull()).select(F.col("pub_id").alias("i_pub"), F.col("manifest_id").alias("i_id"), "decl_key")
    r = refs.select("pub_id", key, V.manifest_id(F.col(ref)).alias("norm"))
    return r.join(ids, (F.col("pub_id") == F.col("i_pub")) & (F.col("norm") == F.col("i_id"))).select(key, "decl_key")


def repeated_ids(typed: DataFrame) -> DataFrame:
    """Manifest ids that several declarations of a book carry."""
    return typed.where(F.col("manifest_id").isNotNull()).groupBy("pub_id", "manifest_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def shared_files(typed: DataFrame) -> DataFrame:
    """Local files that several declarations name: none of these may take the file along when it goes."""
    local = typed.where(F.col("address_kind") == "local")
    return local.groupBy("pub_id", "address").agg(F.count(F.lit(1)).alias("n_declarations")).where(F.col("n_declarations") > 1)


def merged_coverage(parts: DataFrame) -> DataFrame:
    """Coverage records of parts of a corpus as one; any order and grouping of parts gives the same."""
    return parts.groupBy("family").agg(*(F.sum(c).alias(c) for c in ("expected", "complete", "partial", "unavailable")))


def completeness(coverage_: DataFrame) -> DataFrame:
    """Whether all of a family that is expected is complete; a family without anything expected is."""
    return coverage_.select("family", (F.col("complete") == F.col("expected")).alias("is_complete"))


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Whether two runs gave the same rows, copies counted."""
    return left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def fifo_pairs(links: DataFrame, references: DataFrame, *keys: str) -> DataFrame:
    """Pairs the n-th link with the n-th reference of the same keys; both sides carry ``ord``."""
    rank = lambda df: df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("ord")))
    return rank(links).withColumnRenamed("ord", "link_ord").join(rank(references).select(*keys, "nth", F.col("ord").alias("slot")), [*keys, "nth"], "left").drop("nth")
