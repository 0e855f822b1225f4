"""Filling fixed-capacity containers with items (problem 7).

Hierarchical residual packing: items are dealt by hash to groups of bounded size, each group is packed best-fit (largest
first), and containers that are nearly full leave. The others go on as items of their own size: once more together, so
that what is small finds room in what is open, and then by a tree. Best fit leaves at most one container that is half full
or less in a group, and of two fuller ones none fits into the other; so only those small ones go on, one a group, and are
merged group by group until a pack has a single one. Groups never exceed their bound, however many items there are.

Defined results: an item above the capacity is cut into whole containers and one rest, nothing else is cut; items
without size need no room and are in no container; null sizes and null or non-positive capacities are left out; ties go
to the smaller identifier, so that the result is the same on every run. At the end at most one container of a pack is half
full or less, so that no two others could be one.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexmill.session import Scratch

#: Items that one task packs at once, on average.
GROUP = 4000
#: A container of at least this fill is done.
FULL = 0.98


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item: largest items first, each where it leaves the least room.

    ``room[r]`` stacks the containers with r free places, and a Fenwick-like jump list finds the least r that fits.
    """
    order = np.argsort(-sizes, kind="stable")
    out = np.empty(len(sizes), np.int64)
    room: dict[int, list[int]] = {}
    free: list[int] = []  # sorted rooms that exist
    from bisect import bisect_left, insort

    n = 0
    for i in order:
        size = int(sizes[i])
        at = bisect_left(free, size)
        if at == len(free):
            bin_, left = n, capacity - size
            n += 1
        else:
            had = free[at]
            stack = room[had]
            bin_ = stack.pop()
            if not stack:
                free.pop(at)
                del room[had]
            left = had - size
        out[i] = bin_
        if left > 0:
            if left not in room:
                insort(free, left)
                room[left] = []
            room[left].append(bin_)
    return out


_OPEN = "pack_name string, capacity bigint, id string, used bigint, members array<struct<doc_id:bigint,piece:bigint,first:bigint,n_tokens:bigint>>"


def _pack_group() -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        capacity = int(pdf.capacity.iloc[0])
        bins = best_fit(pdf.used.to_numpy(), capacity)
        order = np.argsort(bins, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(bins[order]) > 0])
        ends = np.r_[starts[1:], len(order)]
        used, ids, members = pdf.used.to_numpy(), pdf.id.to_numpy(), pdf.members.to_numpy()
        rows = [(pdf.pack_name.iloc[0], capacity, min(ids[order[a:b]]), int(used[order[a:b]].sum()), [m for i in order[a:b] for m in members[i]]) for a, b in zip(starts, ends, strict=True)]
        return pd.DataFrame(rows, columns=["pack_name", "capacity", "id", "used", "members"])

    return run


def pieces(items: DataFrame, packs: DataFrame) -> DataFrame:
    """Items per pack, cut only where they exceed the capacity: pack_name, capacity, id, used, members."""
    limits = sorted({(r.pack_name, int(r.capacity_tokens)) for r in packs.where((F.col("capacity_tokens") > 0) & F.col("pack_name").isNotNull()).collect()})  # a fixed handful
    sized = items.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens").distinct()
    kind = "array<struct<pack_name:string,capacity:bigint>>"
    held = F.array(*(F.struct(F.lit(p).alias("pack_name"), F.lit(c).cast("bigint").alias("capacity")) for p, c in limits)).cast(kind) if limits else F.lit(None).cast(kind)
    each = sized.withColumn("p", F.explode(held)).select("doc_id", "n_tokens", "p.pack_name", "p.capacity")
    cut = each.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n_tokens") - 1) / F.col("capacity")).cast("bigint"))))
    first = F.col("piece") * F.col("capacity")
    size = F.least(F.col("capacity"), F.col("n_tokens") - first)
    return cut.select(
        "pack_name",
        "capacity",
        F.format_string("%020d-%010d", "doc_id", "piece").alias("id"),
        size.alias("used"),
        F.array(F.struct("doc_id", "piece", first.alias("first"), size.alias("n_tokens"))).alias("members"),
    )


def pack(items: DataFrame, packs: DataFrame, group: int = GROUP, full: float = FULL) -> DataFrame:
    """Containers of ``items`` (doc_id, n_tokens) for each of ``packs`` (pack_name, capacity_tokens).

    pack_name, container, capacity, used, fill, members (doc_id, piece, first, n_tokens).
    """
    scratch = Scratch(items.sparkSession, "packing")
    now = scratch.cut(pieces(items, packs))
    done = [now.where(F.col("used") == F.col("capacity"))]
    rest = now.where(F.col("used") < F.col("capacity"))
    tally = lambda df: {r["pack_name"]: r["count"] for r in df.groupBy("pack_name").count().collect()}  # noqa: E731, one row a pack
    counts, level = tally(rest), 0
    while counts:
        groups = F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, max(1, -(-n // group)))))
        dealt = rest.withColumn("g", F.pmod(F.xxhash64("id", F.lit(level)), groups[F.col("pack_name")]))
        now = scratch.cut(dealt.groupBy("pack_name", "g").applyInPandas(_pack_group(), _OPEN))
        # a pack goes on while it had several groups: first all its open containers, then the small ones alone
        open_ = F.col("used") < full * F.col("capacity") if level == 0 else F.col("used") * 2 <= F.col("capacity")
        goes_on = F.col("pack_name").isin([p for p, n in counts.items() if n > group]) & open_
        done.append(now.where(~goes_on))
        rest = now.where(goes_on)
        counts, level = tally(rest), level + 1
        single = [p for p, n in counts.items() if n == 1]
        done.append(rest.where(F.col("pack_name").isin(single)))
        rest = rest.where(~F.col("pack_name").isin(single))
        counts = {p: n for p, n in counts.items() if n > 1}
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("pack_name", F.concat_ws("/", "pack_name", "id").alias("container"), "capacity", "used", (F.col("used") / F.col("capacity")).alias("fill"), "members")


def members(containers: DataFrame) -> DataFrame:
    """One row a member: pack_name, container, doc_id, piece, first_token, n_tokens, fill."""
    return containers.select("pack_name", "container", "fill", F.explode("members").alias("m")).select("pack_name", "container", "m.doc_id", "m.piece", F.col("m.first").alias("first_token"), "m.n_tokens", "fill")


def fill_report(containers: DataFrame) -> DataFrame:
    """Containers, tokens and mean fill per pack, beside the least number of containers that the tokens need."""
    return containers.groupBy("pack_name", "capacity").agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("used").alias("n_tokens"),
        (F.sum("used") / F.sum("capacity")).alias("mean_fill"),
        F.ceil(F.sum("used") / F.max("capacity")).alias("least_containers"),
    )
