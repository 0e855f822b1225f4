"""Accessibility of publications: claims of their metadata, and what is observed in their content, in one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.functions import values as V

#: Branches of the observations in their order.
BRANCHES = ("navigation", "content", "structure", "smil", "overlay", "track", "captions")


def claims(metas: DataFrame) -> DataFrame:
    """Conformance claims: the versions and the level where the wording is that of the standard, else null."""
    m = metas.where((F.col("property") == "dcterms:conformsTo") & F.col("refines").isNull() & F.col("content").isNotNull())
    return m.select("pub_id", "ord", "content", V.conformance(F.col("content")).alias("claim")).select("pub_id", "ord", "content", "claim.*")


def observations(tables: dict[str, DataFrame], overlays: DataFrame | None = None) -> DataFrame:
    """What of accessibility is seen in parsed books: (pub_id, branch, path, place, kind, value), ordered by branch, path and place.

    Navigation lists; content facts; structure; overlay documents; overlay associations (``overlays``: pub_id, address, state); media tracks;
    captions. ``branch`` is the number in ``BRANCHES``; nulls are kept as what is not told.
    """
    res = tables["resources"]
    row = lambda df, branch, path, place, kind, value: df.select("pub_id", F.lit(BRANCHES.index(branch)).alias("branch"), path.alias("path"), place.cast("bigint").alias("place"), kind.alias("kind"), value.cast("string").alias("value"))
    smil = tables["smil"].groupBy("pub_id", "path").agg(F.count(F.lit(1)).alias("n"))
    tracks = res.select("pub_id", "path", F.posexplode("inspection.tracks").alias("i", "track"))
    parts = [
        row(tables["nav_lists"].where(F.col("selected")), "navigation", F.col("document"), F.col("list_index"), F.coalesce("semantic", F.lit("other")), F.col("points")),
        row(tables["accessibility"], "content", F.col("path"), F.col("place"), F.col("kind"), F.col("value")),
        row(tables["structure"], "structure", F.col("path"), F.col("place"), F.col("role"), F.col("label")),
        row(smil, "smil", F.col("path"), F.lit(0), F.lit("overlay"), F.col("n")),
        row(tracks, "track", F.col("path"), F.col("i"), F.col("track"), F.lit(None)),
        row(res.where(F.col("inspection.kind") == "webvtt"), "captions", F.col("path"), F.lit(0), F.when(F.col("inspection.valid"), "valid").otherwise("invalid"), F.col("inspection.cues")),
    ]
    if overlays is not None:
        parts.append(row(overlays, "overlay", F.col("address"), F.lit(0), F.col("state"), F.lit(None)))
    return reduce(DataFrame.unionByName, parts)
