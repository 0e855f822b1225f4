"""References to records that do not exist (problem 4).

The distinct non-null foreign keys are anti-joined against the parent keys (``missing``) and looked up for the parents
that are all deleted; only then are the referring rows joined back, where the arrival decides between ``late`` and no
orphan. Both sides are aggregated to distinct keys before any row-level join, so a key that a third of all rows names
costs one row in the anti-join, and the row-level join back is left to adaptive skew splitting.

Defined results: null and empty references (after trimming, where the field is trimmed) are none; ids that are null are
no parents; copies of a row count once, with their earliest arrival; rows with a null book refer to nothing and are
reported missing; extra columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Key spaces that a reference can point into.
SPACES = ("manifest", "refines")
BLANK = " \t\r\n"


def trimmed(c: Column | str) -> Column:
    """Without surrounding space, tab, CR and LF."""
    return F.btrim(F.col(c) if isinstance(c, str) else c, F.lit(BLANK))


def parent_keys(rows: DataFrame, key: Column, live: Column, spaces: list[str]) -> DataFrame:
    """One row per parent: pub_id, ref, the key spaces it belongs to, and its arrival if it is live."""
    held = [F.lit(s in spaces).alias(f"in_{s}") for s in SPACES]
    return rows.select("pub_id", key.alias("ref"), *held, F.when(live, F.col("loaded_at")).alias("live_at")).where(F.col("ref").isNotNull())


def references(rows: DataFrame, table: str, key: str, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    """One row per copy and non-empty reference: table, field, row key, space, pub_id, ref, loaded_at."""
    parts = F.array(*(F.struct(F.lit(n).alias("ref_field"), c.alias("ref"), F.lit(space).alias("space")) for n, (c, space) in fields.items()))
    named = rows.select(F.col(key).alias("row_key"), "pub_id", "loaded_at", F.explode(F.filter(parts, lambda x: x["ref"].isNotNull())).alias("r"))
    return named.select(F.lit(table).alias("ref_table"), "r.ref_field", "row_key", "r.space", "pub_id", "r.ref", "loaded_at")


def find_orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """The orphans among ``refs``: ref_table, ref_field, row_key, reason, period.

    Every shuffle is on (pub_id, ref) and the aggregates before them are partial first; only rows whose key is suspect
    reach the last aggregate, where copies of a row meet.
    """
    on = ["pub_id", "ref"]
    known = parents.groupBy(*on).agg(*(x for s in SPACES for x in (F.bool_or(f"in_{s}").alias(f"in_{s}"), F.min(F.when(F.col(f"in_{s}"), F.col("live_at"))).alias(f"live_{s}"))))
    wanted = refs.groupBy(*on).agg(*(F.min(F.when(F.col("space") == s, F.col("loaded_at"))).alias(f"seen_{s}") for s in SPACES))
    absent = wanted.join(known, on, "left_anti").select(*on, *(F.struct(F.lit("missing").alias("state"), F.lit(None).cast("timestamp").alias("live_at")).alias(s) for s in SPACES))

    def judged(s: str) -> Column:
        state = F.when(~F.col(f"in_{s}"), "missing").when(F.col(f"live_{s}").isNull(), "deleted").when(F.col(f"live_{s}") > F.col(f"seen_{s}"), "late")
        return F.struct(F.when(F.col(f"seen_{s}").isNotNull(), state).alias("state"), F.col(f"live_{s}").alias("live_at")).alias(s)

    present = wanted.join(known, on).select(*on, *(judged(s) for s in SPACES)).where(F.coalesce(*(F.col(f"{s}.state") for s in SPACES)).isNotNull())
    suspect = absent.unionByName(present).select(F.col("pub_id").alias("p"), F.col("ref").alias("k"), *SPACES)
    back = refs.join(suspect, F.col("pub_id").eqNullSafe(F.col("p")) & (F.col("ref") == F.col("k")))
    verdict = F.coalesce(*(F.when(F.col("space") == s, F.col(s)) for s in SPACES))
    hit = back.select("ref_table", "ref_field", "row_key", "loaded_at", verdict.alias("v")).where(F.col("v.state").isNotNull())
    rows = hit.groupBy("ref_table", "ref_field", "row_key", F.col("v.state").alias("reason"), F.col("v.live_at").alias("live_at")).agg(F.min("loaded_at").alias("arrived"))
    kept = rows.where((F.col("reason") != "late") | (F.col("live_at") > F.col("arrived")))
    return kept.select("ref_table", "ref_field", "row_key", "reason", F.date_format(F.to_utc_timestamp("arrived", F.current_timezone()), "yyyy-MM").alias("period"))


def publication_orphans(declarations: DataFrame, reading_order: DataFrame, metas: DataFrame, elements: DataFrame) -> DataFrame:
    """Orphans of the four reference fields of a publication corpus."""
    live = F.col("removed_at").isNull()
    real = lambda c: F.nullif(trimmed(c), F.lit(""))
    parents = reduce(
        DataFrame.unionByName,
        [
            parent_keys(declarations, trimmed("id"), live, ["manifest", "refines"]),
            parent_keys(elements, F.col("id"), live, ["refines"]),
            parent_keys(metas, F.col("id"), F.lit(True), ["refines"]),
        ],
    )
    bare = F.when(F.col("refines") != "", F.ltrim(F.col("refines"), F.lit("#")))
    refs = reduce(
        DataFrame.unionByName,
        [
            references(declarations, "declarations", "decl_key", {"fallback": (real("fallback"), "manifest"), "media_overlay": (real("media_overlay"), "manifest")}),
            references(reading_order, "reading_order", "itemref_key", {"idref": (real("idref"), "manifest")}),
            references(metas, "metas", "meta_key", {"refines": (bare, "refines")}),
        ],
    )
    return find_orphans(refs, parents)


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, field, reason and period."""
    return orphans.groupBy("ref_table", "ref_field", "reason", "period").agg(F.count(F.lit(1)).alias("n_orphans"))
