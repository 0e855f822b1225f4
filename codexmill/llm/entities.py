"""Variant spellings of names to the people and houses they mean (problem 2).

Merge-and-rematch resolution. Every distinct string is parsed once; equal parses form a profile (family name, given name
or initial, middle initial). Where neither end of a string tells by itself which is the family name, both orders are
tried and the one that more other strings use so is taken. A profile's family name is blocked under keys that pairs one
slip of the pen apart share: the name with one place masked, with one place left out, and with two neighbours put in
order. In names of fewer than five letters only exchanged neighbours count as a slip (Lang, Lagn), as another or a missing
letter makes too many other names (Lang, Land, Lange). Inside a block all members are therefore near, so that linking
each to one of them loses no link and pairs are never written out.

Whether they may merge is decided on what the whole entity is known to be called: once profiles merge, their
given names, initials and middle initials are united as sets, and the richer entity re-enters all its blocks. Inside a
block given names are compared by slips, abbreviations and pet forms, those of the table in ``names`` being evidence
beside that; a bare initial joins a full name only where the block knows a single one with it, and a person without middle
initial joins one with it only where that name has a single one. Rounds go on, over the blocks of what has changed, until
nothing merges.

Defined results: null, empty and placeholder strings mean no one and belong to no entity; repeated rows count once;
people and houses are resolved apart; ties go to the smaller profile number; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexmill.llm.names import GIVEN_FORMS, called, parse_house, parse_person
from codexmill.session import Scratch

_PARSED = "class string, name string, family string, given string, middle string, family2 string, given2 string"


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        rows = []
        for kind, name in zip(pdf["class"], pdf["name"], strict=True):
            if kind == "house":
                p = parse_house(name)
                row = p and (p["stem"], p["form"], "", None, None)
            else:
                p = parse_person(name)
                row = p and (p["surname"], p["given"] or p["initial"], p["middle"], *(p["other"] or (None, None)))
            if row:
                rows.append((kind, name, *row))
        yield pd.DataFrame(rows, columns=["class", "name", "family", "given", "middle", "family2", "given2"])


def name_strings(elements: DataFrame) -> DataFrame:
    """Distinct (class, name) of the people and houses that elements name."""
    kinds = F.when(F.col("kind") == "publisher", "house").otherwise("person")
    rows = elements.where(F.col("kind").isin("creator", "contributor", "publisher"))
    return rows.select(kinds.alias("class"), F.explode(F.array_distinct(F.array("content", "opf2_file_as"))).alias("name")).where(F.col("name").isNotNull()).distinct()


def _ordered(parsed: DataFrame) -> DataFrame:
    """``parsed`` with one reading: strings open in their order take the reading that more other strings share, certain ones counting four times."""
    weight = F.sum(F.when(F.col("family2").isNull(), 4).otherwise(1))
    of = lambda c, n: parsed.where(F.col("class") == "person").groupBy(F.col(c).alias(f"k_{n}")).agg(weight.alias(n))
    told = parsed
    for column, count, name in (("family", "family", "f1"), ("given", "given", "g1"), ("family2", "family", "f2"), ("given2", "given", "g2")):
        told = told.join(of(count, name), F.when(F.col("family2").isNotNull(), F.col(column)) == F.col(f"k_{name}"), "left").drop(f"k_{name}")
    n = lambda c: F.coalesce(c, F.lit(0))
    turned = F.coalesce(F.col("family2").isNotNull() & (n("f2") + n("g2") > n("f1") + n("g1") - 2), F.lit(False))  # without itself
    return told.select("class", "name", F.when(turned, F.col("family2")).otherwise(F.col("family")).alias("family"), F.when(turned, F.col("given2")).otherwise(F.col("given")).alias("given"), "middle")


def _block_keys(profiles: DataFrame) -> DataFrame:
    """(pid, key, whole): the keys under which a family name meets all names one slip apart; whole marks the name itself."""
    n = F.length("family")
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    sub = lambda c, a, b: F.substring(c, a, b)
    f = F.col("family")
    masked = F.transform(at, lambda i: F.struct(F.concat(sub(f, F.lit(1), i - 1), F.lit("?"), sub(f, i + 1, n)).alias("key"), F.lit(False).alias("whole")))
    without = F.transform(at, lambda i: F.struct(F.concat(F.lit("-"), sub(f, F.lit(1), i - 1), sub(f, i + 1, n)).alias("key"), F.lit(False).alias("whole")))
    swapped = F.transform(
        F.slice(at, 1, F.greatest(n - 1, F.lit(0))),
        lambda i: F.struct(F.concat(sub(f, F.lit(1), i - 1), F.lit("~"), F.array_join(F.array_sort(F.array(sub(f, i, F.lit(1)), sub(f, i + 1, F.lit(1)))), ""), sub(f, i + 2, n)).alias("key"), F.lit(False).alias("whole")),
    )
    own = F.array(F.struct(F.concat(F.lit("-"), f).alias("key"), F.lit(True).alias("whole")))
    keys = F.when(n >= 5, F.concat(own, masked, without, swapped)).otherwise(F.concat(own, swapped))
    return profiles.select("pid", "class", F.explode(F.array_distinct(keys)).alias("k")).select("pid", F.concat_ws("\u0001", "class", "k.key").alias("key"), "k.whole")


def _pairs(names: list[str]) -> list[tuple[str, str]]:
    """Each given name of a block with what it is called there."""
    return sorted(called([n for n in names if n]).items()) + ([("", "")] if "" in names else [])


_called = F.udf(_pairs, T.ArrayType(T.StructType([T.StructField("t", T.StringType()), T.StructField("g", T.StringType())])), useArrow=False)


def _moves(met: DataFrame) -> DataFrame:
    """(entity, hub): entities that are called as a smaller one in some block. ``met``: key, entity, givens, middles."""
    terms = met.select("entity", "key", F.explode("givens").alias("t"), "middles")
    # blocks of several entities, each with the given names of one family
    told = terms.groupBy("key").agg(F.collect_set("t").alias("all"), F.min("entity").alias("lo"), F.max("entity").alias("hi")).where(F.col("lo") != F.col("hi"))
    told = told.select("key", "all", F.array_remove("all", "").alias("names"))
    person, names = ~F.col("key").startswith("house\u0001"), F.col("names")
    # names of the table need no comparison with each other: only initials are looked up, a bare house is its only form
    other = person & (F.size("names") > 1) & F.exists("names", lambda g: (F.length(g) > 1) & ~g.isin(*GIVEN_FORMS))
    begun = lambda t: F.filter(names, lambda g: (F.length(g) > 1) & g.startswith(t))
    alone = lambda t: F.when((F.length(t) == 1) & person, F.when(F.size(begun(t)) == 1, begun(t)[0])).when((t == "") & ~person & (F.size(names) == 1), names[0])
    plain = F.transform("all", lambda t: F.struct(t.alias("t"), F.coalesce(alone(t), t).alias("g")))
    compared = F.when(other, _called(F.when(other, F.col("all")).otherwise(F.array().cast("array<string>")))).otherwise(plain)
    # one row a name of a block, so that no row of a large family carries all its names along
    meant = told.select("key", F.explode(compared).alias("x")).select("key", "x.t", "x.g")
    fit = terms.join(meant, ["key", "t"]).select("entity", "key", "g", F.explode(F.when(F.size("middles") > 0, F.col("middles")).otherwise(F.array(F.lit("")))).alias("m"))
    groups = fit.groupBy("key", "g", "m").agg(F.min("entity").alias("lo"), F.max("entity").alias("hi"))
    # with one middle initial at most, all of a name may be one; with several, each only with its like
    name = Window.partitionBy("key", "g")  # of middle initials, already counted
    m = F.nullif("m", F.lit(""))
    several = F.min(m).over(name) != F.max(m).over(name)
    own = F.coalesce(several, F.lit(False))
    hubs = groups.select("key", "g", "m", F.when(own, F.col("lo")).otherwise(F.min("lo").over(name)).alias("hub"), F.when(own, F.col("hi")).otherwise(F.max("hi").over(name)).alias("top")).where(F.col("hub") != F.col("top"))
    return fit.join(hubs, ["key", "g", "m"]).where(F.col("hub") < F.col("entity")).groupBy("entity").agg(F.min("hub").alias("hub"))


def resolve(strings: DataFrame) -> DataFrame:
    """Entities of distinct (class, name) strings: class, name, entity. Placeholders are left out."""
    spark = strings.sparkSession
    scratch = Scratch(spark, "entities")
    parsed = scratch.cut(strings.select("class", "name").mapInPandas(_parse, _PARSED))
    parsed = parsed.drop("family2", "given2") if parsed.where(F.col("family2").isNotNull()).isEmpty() else scratch.cut(_ordered(parsed))
    identity = ["class", "family", "given", "middle"]
    profiles = parsed.groupBy(*identity).agg(F.min("name").alias("first"))
    profiles = scratch.cut(profiles.withColumn("pid", F.xxhash64(*identity)))
    keys = _block_keys(profiles.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "pid"))
    # only keys that two profiles share can merge anything; a left-out key links nothing unless a profile is called so
    shared = keys.groupBy("key").agg(F.min("pid").alias("a"), F.max("pid").alias("b"), F.bool_or("whole").alias("real")).where((F.col("a") != F.col("b")) & (F.col("real") | ~F.split("key", "\u0001")[1].startswith("-")))
    blocks = scratch.cut(keys.join(shared.select("key"), "key", "left_semi").select("pid", "key"))
    state = scratch.cut(profiles.select("pid", F.col("pid").alias("entity"), "given", "middle"))
    active = blocks
    while True:
        # what an entity is called: all its given names but those that only begin another one, and all its middle initials
        sets = state.groupBy("entity").agg(F.collect_set("given").alias("all"), F.array_remove(F.collect_set("middle"), "").alias("middles"))
        known = sets.select("entity", F.filter("all", lambda a: ~F.exists("all", lambda b: (a != b) & b.startswith(a))).alias("givens"), "middles")
        met = scratch.cut(active.join(state.select("pid", "entity"), "pid").select("key", "entity").distinct().join(known, "entity"))
        moves = scratch.cut(_moves(met))
        scratch.drop(met)
        if moves.isEmpty():
            break
        ahead = moves.select(F.col("entity").alias("hub"), F.col("hub").alias("further"))  # a hub that moves takes its followers along
        moved = scratch.cut(moves.join(ahead, "hub", "left").select("entity", F.coalesce("further", "hub").alias("hub")))
        new = scratch.cut(state.join(moved, "entity", "left").select("pid", F.coalesce("hub", "entity").alias("entity"), "given", "middle"))
        richer = new.join(moved.select(F.col("hub").alias("entity")).distinct(), "entity", "left_semi").select("pid")
        active = scratch.cut(blocks.join(blocks.join(richer, "pid", "left_semi").select("key").distinct(), "key", "left_semi"))
        scratch.drop(state)
        scratch.drop(moves)
        state = new
    return parsed.join(profiles.select(*identity, "pid"), identity).join(state.select("pid", "entity"), "pid").select("class", "name", "entity")


def spelling_pairs(entities: DataFrame) -> DataFrame:
    """All pairs (name_a < name_b) of different strings of one entity."""
    a, b = entities.alias("a"), entities.alias("b")
    same = (F.col("a.class") == F.col("b.class")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("a.name") < F.col("b.name"))
    return a.join(b, same).select(F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b")).distinct()
