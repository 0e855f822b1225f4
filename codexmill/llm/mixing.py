"""Mixing sources to target weights (problem 8).

Poisson replication: each document gets a uniform number from a hash of its identifier and the seed, and its count is the
quantile of a Poisson distribution, cut at the source's highest repetition. The mean of each source is set so that the
counts meet its target size: tokens are summed over the range of the uniform numbers in ``BINS`` steps (one pass, one
small table), and as counts only rise with the mean, the mean follows by bisection on that table. Documents are then
exploded by their count and put in one global hash order.

Without a given total the mix is the largest in which every source that is present meets its share exactly; with one,
sources that are short give all they may, and the others share the rest in proportion.

Defined results: sources not listed, and documents without source or tokens, are not in the mix; listed sources that are
absent are reported with share 0 and their target is spread over the others; null targets or repeats count as 0;
repeated rows of a document count once.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexmill.session import Scratch

#: Steps of the uniform numbers on which the means are solved.
BINS = 4096
SEED = 2024


def _uniform(seed: int) -> Column:
    """A number in (0, 1) from a document's identifier."""
    return (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + F.lit(0.5)) / float(1 << 40)


def quantile(u: np.ndarray, mean: float, most: int) -> np.ndarray:
    """Poisson quantile of u at ``mean``, at most ``most``."""
    if not np.isfinite(mean):
        return np.full(len(u), most)
    out, term, total = np.zeros(len(u), np.int64), np.exp(-mean), 0.0
    for j in range(most):
        total += term
        out += u > total
        term *= mean / (j + 1)
    return out


def solve_mean(tokens: np.ndarray, target: float, most: int) -> float:
    """The mean at which the quantiles of the binned tokens come to ``target``; infinite where all repeats are needed."""
    u = (np.arange(len(tokens)) + 0.5) / len(tokens)
    if target >= tokens.sum() * most:
        return float("inf")
    low, high = 0.0, float(4 * most + 20)
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (tokens * quantile(u, mid, most)).sum() > target else (mid, high)
    return low


def target_sizes(supply: dict[str, float], share: dict[str, float], most: dict[str, int], total: float | None = None) -> dict[str, float]:
    """Tokens that each source is to give."""
    present = {s for s in supply if supply[s] > 0 and share.get(s, 0) > 0 and most.get(s, 0) > 0}
    weight = sum(share[s] for s in present)
    if not present:
        return {}
    reach = {s: supply[s] * most[s] for s in present}
    if total is None:
        whole = min(reach[s] * weight / share[s] for s in present)
        return {s: whole * share[s] / weight for s in present}
    out: dict[str, float] = {}
    open_, left = set(present), min(total, sum(reach.values()))
    while open_:
        w = sum(share[s] for s in open_)
        short = {s for s in open_ if left * share[s] / w >= reach[s]}
        if not short:
            return out | {s: left * share[s] / w for s in open_}
        out |= {s: reach[s] for s in short}
        left -= sum(reach[s] for s in short)
        open_ -= short
    return out


def repeats(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``sized`` (doc_id, source, n_tokens) of the listed sources with how often each document is used: doc_id, source, n_tokens, repeats."""
    wanted = {r["source"]: (float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where(F.col("source").isNotNull()).collect()}  # the fixed table of targets
    rows = sized.where(F.col("source").isin(list(wanted)) & (F.col("n_tokens") > 0)).groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.*").withColumn("u", _uniform(seed))
    binned = rows.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("b")).agg(F.sum("n_tokens").alias("t")).collect()  # BINS rows a listed source at most
    hist = {s: np.zeros(BINS) for s in wanted}
    for r in binned:
        hist[r["source"]][r["b"]] = r["t"]
    sizes = target_sizes({s: float(h.sum()) for s, h in hist.items()}, {s: w[0] for s, w in wanted.items()}, {s: w[1] for s, w in wanted.items()}, total)
    count = F.lit(0).cast("bigint")
    for s, target in sizes.items():
        most = wanted[s][1]
        mean = solve_mean(hist[s], target, most)
        if np.isfinite(mean):
            steps = np.cumsum([np.exp(-mean) * mean**j / float(np.prod(np.arange(1, j + 1))) for j in range(most)])
            n = sum((F.when(F.col("u") > float(p), 1).otherwise(0) for p in steps), F.lit(0))
        else:
            n = F.lit(most)
        count = F.when(F.col("source") == s, n.cast("bigint")).otherwise(count)
    return rows.withColumn("repeats", count).drop("u")


def mix(counted: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix in global hash order: place (sort key), doc_id, source, copy, n_tokens."""
    copies = counted.where(F.col("repeats") > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("repeats"))))
    placed = copies.withColumn("place", F.xxhash64("doc_id", "copy", F.lit(seed)))
    return placed.repartitionByRange("place").sortWithinPartitions("place").select("place", "doc_id", "source", "copy", "n_tokens")


def shares(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """Target and actual share of each listed source."""
    per = counted.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("supply_tokens"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mix_tokens"), F.max("repeats").alias("most_repeats"))
    whole = per.agg(F.sum("mix_tokens")).first()[0] or 1  # one number
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    out = targets.where(F.col("source").isNotNull()).join(per, "source", "left")
    return out.select("source", "target_share", "max_repeats", zero("n_docs"), zero("supply_tokens"), zero("mix_tokens"), zero("most_repeats"), F.coalesce(F.col("mix_tokens") / F.lit(whole), F.lit(0.0)).alias("actual_share"))


def mixture(sized: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED) -> DataFrame:
    """Repeats of all documents, the sizes being written once."""
    return repeats(Scratch(sized.sparkSession, "mixing").cut(sized), targets, total, seed)
