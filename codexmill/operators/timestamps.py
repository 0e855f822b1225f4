"""Mixed timestamp formats and time zones to one UTC instant (problem 3).

Every value becomes an array of all its valid interpretations, built from JVM-side expressions: reading of the digits,
order of day and month, and, for local times that occur twice, both instants. One interpretation per value is then chosen
by Viterbi over each source's record order. A switch of format and a step back in time cost something each; so does a
reading, by what its source is known to write: the values that can be read in one order of day and month only are counted
per source, and a declared locale weighs as ``LOCALE_WEIGHT`` nats beside them. A source with a declared locale, or with
many plain values, is settled by that; where little or nothing is known of a source, its record order decides. What
contradicts the settled order of its source is dropped at the end by an exact check.

The search is exact and distributed. A run of records is a segment with its first and last interpretations and the
least cost between them; segments compose, so blocks of records are reduced to segments, blocks of segments again, until
one block a source is left, and the choice is then handed down the same levels. No task sees more than ``BLOCK``
segments of a source, however large the source is.

Defined results: null, empty and unparsable values, impossible dates or times, and approximate or open values give no row;
a value without a zone needs a source with a known zone; copies of a record count once; ties take the earlier instant;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.operators.orphans import trimmed
from codexmill.session import Scratch

#: Records or segments that one task combines.
BLOCK = 4096
#: Costs of a switch of format and of a step back in time.
SWITCH, BACK = 1.0, 1.0
#: Cost of the second occurrence of a local time that occurs twice. Two transitions can save 4 at most, so at this cost the
#: first is always meant; at a lower one the record order decides.
AGAIN_COST = 6.0
#: Weight of a declared locale in nats, as many plain values as e^8 to one would have.
LOCALE_WEIGHT = 8.0

# Month names (English, German, French), zone abbreviations in minutes east of UTC, month-first regions.
MONTHS = {
    1: ("january", "jan", "januar", "janvier"),
    2: ("february", "feb", "februar", "février"),
    3: ("march", "mar", "märz", "mars"),
    4: ("april", "apr", "avril"),
    5: ("may", "mai"),
    6: ("june", "jun", "juni", "juin"),
    7: ("july", "jul", "juli", "juillet"),
    8: ("august", "aug", "août"),
    9: ("september", "sep", "sept", "septembre"),
    10: ("october", "oct", "oktober", "okt", "octobre"),
    11: ("november", "nov", "novembre"),
    12: ("december", "dec", "dezember", "dez", "décembre"),
}
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "BST": 60, "WEST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "JST": 540, "IST": 330}
MONTH_FIRST_REGIONS = ("US",)

_ZONE = r"([Zz]|[+-]\d{2}:?\d{2}| ?[A-Z]{2,4}|\[[A-Za-z]+(?:/[A-Za-z0-9_+-]+)*\])?"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
#: name, pattern, groups of (year, month, day, hour, minute, second, fraction, zone, half of day); 0 where absent
SPECS = (
    ("iso", rf"^(\d{{4}})-(\d{{2}})-(\d{{2}})(?:[T ](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)?{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    ("slashed", rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}})(?: {_CLOCK}{_ZONE})?$", (1, 2, 3, 4, 5, 6, 7, 8, 0)),
    ("compact", r"^(\d{4})(\d{2})(\d{2})(?:T?(\d{2})(\d{2})(\d{2})?([Zz])?)?$", (1, 2, 3, 4, 5, 6, 0, 7, 0)),
    ("month", r"^(\d{4})-(\d{2})$", (1, 2, 0, 0, 0, 0, 0, 0, 0)),
    ("year", r"^(\d{4})$", (1, 0, 0, 0, 0, 0, 0, 0, 0)),
    ("mail", rf"^(?:\p{{L}}{{3}}, )?(\d{{1,2}}) (\p{{L}}+) (\d{{4}}) {_CLOCK} ?{_ZONE}$", (3, 2, 1, 4, 5, 6, 7, 8, 0)),
    ("day_name", r"^(\d{1,2})\.? (\p{L}+)\.? (\d{4})$", (3, 2, 1, 0, 0, 0, 0, 0, 0)),
    ("name_day", r"^(\p{L}+)\.? (\d{1,2}), (\d{4})$", (3, 1, 2, 0, 0, 0, 0, 0, 0)),
    ("day_first", rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}})(?:,? {_CLOCK}(?: ?([AaPp][Mm]|Uhr))?)?$", (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    ("month_first", rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}})(?:,? {_CLOCK}(?: ?([AaPp][Mm]|Uhr))?)?$", (3, 1, 2, 4, 5, 6, 7, 0, 8)),
)
_DAY = 86_400_000_000


def _month_number(text: Column) -> Column:
    names = {n: m for m, ns in MONTHS.items() for n in ns}
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(text.try_cast("int"), F.try_element_at(lookup, F.lower(text)))


def _parsed(values: DataFrame) -> DataFrame:
    """Adds ``spec`` (number of the pattern that fits ``s``, null if none) and ``part``, its pieces by name as strings."""
    names = ("year", "month", "day", "hour", "minute", "second", "fraction", "zone", "half")
    patterns = SPECS[:-1]  # the last two read the same pattern in either order
    spec = F.coalesce(*(F.when(F.col("s").rlike(p), F.lit(i)) for i, (_, p, _) in enumerate(patterns)), F.when(F.col("s").rlike(r"^\d{10}$"), F.lit(len(SPECS))), F.when(F.col("s").rlike(r"^\d{13}$"), F.lit(len(SPECS) + 1)))
    with_spec = values.withColumn("spec", spec)
    pieces = F.coalesce(*(F.when(F.col("spec") == i, F.split(F.regexp_replace("s", p, "|".join(f"${k}" if k else "" for k in groups)), r"\|")) for i, (_, p, groups) in enumerate(patterns)))
    return with_spec.withColumn("piece", pieces).withColumn("part", F.struct(*(F.coalesce(F.col("piece")[i], F.lit("")).alias(n) for i, n in enumerate(names)))).drop("piece")


def _local_micros(month: str, day: str) -> Column:
    """Microseconds of the civil time, null where it is no real day or time; ``month`` and ``day`` name the parts to read."""
    y, m, d = F.col("n.year"), F.col(f"n.{month}"), F.col(f"n.{day}")
    last = F.when(m == 2, F.when((y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)), 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)
    ok = (y >= 1) & m.between(1, 12) & (d >= 1) & (d <= last)
    return F.when(ok, F.unix_date(F.make_date(F.when(ok, y), F.when(ok, m), F.when(ok, d))).cast("bigint") * _DAY + F.col("n.clock"))


def _numbers(df: DataFrame) -> DataFrame:
    g = lambda k: F.col(f"part.{k}")
    hh, mi, ss = (F.when(g(k) == "", F.lit(0)).otherwise(g(k).try_cast("int")) for k in ("hour", "minute", "second"))
    half = F.upper(g("half"))
    twelve = half.isin("AM", "PM")
    df = df.withColumns({"hh": hh, "mi": mi, "ss": ss, "us": F.rpad(F.substring(g("fraction"), 1, 6), 6, "0").try_cast("bigint")})
    h = F.when(twelve, F.col("hh") % 12 + F.when(half == "PM", 12).otherwise(0)).otherwise(F.col("hh"))
    ok = F.col("hh").between(F.when(twelve, 1).otherwise(0), F.when(twelve, 12).otherwise(23)) & (F.col("mi") <= 59) & (F.col("ss") <= 59)
    clock = F.when(ok, ((h * 60 + F.col("mi")) * 60 + F.col("ss")).cast("bigint") * 1_000_000 + F.col("us"))
    month = F.when(g("month") == "", F.lit(1)).otherwise(_month_number(g("month")))
    day = F.when(g("day") == "", F.lit(1)).otherwise(g("day").try_cast("int"))
    return df.withColumn("n", F.struct(g("year").try_cast("int").alias("year"), month.alias("month"), day.alias("day"), clock.alias("clock"))).drop("hh", "mi", "ss", "us")


def _with_candidates(values: DataFrame, zones: list[str]) -> DataFrame:
    """``values`` (s, home_zone) with ``cands``, all valid readings of s: array of (utc, fmt, order, again).

    ``order`` is 1 where the day stands before the month, 2 where behind it, 0 where the pattern leaves no choice.

    Each step is a projection of its own, so that no expression is computed twice.
    """
    names = F.create_map(*(F.lit(x) for kv in ABBREVIATIONS.items() for x in kv))
    df = _numbers(_parsed(values))
    swappable = F.col("spec") == len(SPECS) - 2
    df = df.withColumns({"local1": _local_micros("month", "day"), "local2": F.when(swappable, _local_micros("day", "month")), "zone": F.btrim(F.col("part.zone"))})
    zone = F.col("zone")
    signed = F.regexp_extract(zone, r"^([+-]\d{2}):?(\d{2})$", 1)
    minutes = F.coalesce(
        F.when(F.upper(zone) == "Z", 0),
        F.when(signed != "", (F.abs(signed.try_cast("int")) * 60 + F.regexp_extract(zone, r"(\d{2})$", 1).try_cast("int")) * F.when(zone.startswith("-"), -1).otherwise(1)),
        F.try_element_at(names, zone),
    )
    named = F.when(zone.startswith("["), F.btrim(zone, F.lit("[]"))).when(zone == "", F.col("home_zone"))
    df = df.withColumns({"minutes": minutes, "region": F.when(named.isin(zones), named)})
    moment = lambda c: F.timestamp_micros(F.col(c))
    df = df.withColumns({f"utc{i}": F.coalesce(F.col(f"local{i}") - F.col("minutes").cast("bigint") * 60_000_000, F.unix_micros(F.to_utc_timestamp(moment(f"local{i}"), F.col("region")))) for i in (1, 2)})
    found = []
    reading = lambda utc, fmt, order, again: F.struct(utc.alias("utc"), fmt.alias("fmt"), order.alias("order"), F.lit(again).alias("again"))
    for i in (1, 2):  # the day before the month, or behind it
        order, fmt = F.when(swappable, i).otherwise(0), F.col("spec") * 2 + (i - 1)
        found.append(reading(F.col(f"utc{i}"), fmt, order, False))
        for later in (3_600_000_000, 1_800_000_000):  # the second occurrence of a local time
            utc = F.col(f"utc{i}") + later
            again = F.when(F.col("minutes").isNull() & F.col("region").isNotNull() & (F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), F.col("region"))) == F.col(f"local{i}")), utc)
            found.append(reading(again, fmt, order, True))
    epoch = F.when(F.col("spec") == len(SPECS), F.col("s").try_cast("bigint") * 1_000_000).when(F.col("spec") == len(SPECS) + 1, F.col("s").try_cast("bigint") * 1_000)
    found.append(reading(epoch, F.col("spec") * 2, F.lit(0), False))
    return df.withColumn("cands", F.filter(F.array(*found), lambda c: c["utc"].isNotNull()))


# --- segments: first and last interpretations and the least cost between each two of them


def _steps(l_utc: np.ndarray, l_fmt: np.ndarray, f_utc: np.ndarray, f_fmt: np.ndarray, costs: tuple[float, float]) -> np.ndarray:
    return (l_fmt[:, None] != f_fmt[None, :]) * costs[0] + (f_utc[None, :] < l_utc[:, None]) * costs[1]


def _compose(segments: list[tuple], costs: tuple[float, float] = (SWITCH, BACK)) -> np.ndarray:
    """Least cost between each first interpretation of the run and each last one."""
    total = segments[0][4]
    for prev, seg in zip(segments, segments[1:], strict=False):
        total = (total[:, :, None] + _steps(*prev[2:4], *seg[:2], costs)[None]).min(1)
        total = (total[:, :, None] + seg[4][None]).min(1)
    return total


def _decode(segments: list[tuple], entry: int | None, exit_: int | None, costs: tuple[float, float] = (SWITCH, BACK)) -> list[tuple[int, int]]:
    """The (first, last) interpretation of each segment on the cheapest way; None leaves an end free."""
    m = segments[0][4]
    cost = m.min(0) if entry is None else m[entry]
    firsts = [m.argmin(0) if entry is None else np.full(m.shape[1], entry)]
    via = []
    for prev, seg in zip(segments, segments[1:], strict=False):
        into = cost[:, None] + _steps(*prev[2:4], *seg[:2], costs)
        via.append(into.argmin(0))
        through = into.min(0)[:, None] + seg[4]
        firsts.append(through.argmin(0))
        cost = through.min(0)
    last = int(cost.argmin()) if exit_ is None else exit_
    choice = [(0, 0)] * len(segments)
    for i in range(len(segments) - 1, -1, -1):
        first = int(firsts[i][last])
        choice[i] = (first, last)
        if i:
            last = int(via[i - 1][first])
    return choice


def _segments(pdf: pd.DataFrame, costs: tuple[float, float]) -> tuple[list[tuple], np.ndarray]:
    """The segments of sorted rows, stretches without any choice put together, and for each row its segment."""
    single = (pdf.f_utc.str.len().to_numpy() == 1) & (pdf.l_utc.str.len().to_numpy() == 1)
    starts = np.flatnonzero(np.r_[True, ~(single[1:] & single[:-1])])
    of = np.cumsum(np.r_[True, ~(single[1:] & single[:-1])]) - 1
    f_utc, f_fmt, l_utc, l_fmt, m = (pdf[c].to_numpy() for c in ("f_utc", "f_fmt", "l_utc", "l_fmt", "m"))
    out = []
    for i, a in enumerate(starts):
        b = starts[i + 1] if i + 1 < len(starts) else len(pdf)
        if b - a == 1:
            x, y = np.asarray(f_utc[a], np.int64), np.asarray(l_utc[a], np.int64)
            out.append((x, np.asarray(f_fmt[a], np.int64), y, np.asarray(l_fmt[a], np.int64), np.asarray(m[a], float).reshape(len(x), len(y))))
        else:
            fu, ff, lu, lf, mm = (np.concatenate(v[a:b]) for v in (f_utc, f_fmt, l_utc, l_fmt, m))
            cost = mm.sum() + costs[0] * (ff[1:] != lf[:-1]).sum() + costs[1] * (fu[1:] < lu[:-1]).sum()
            out.append((fu[:1], ff[:1], lu[-1:], lf[-1:], np.array([[cost]])))
    return out, of


_SEG = "f_utc array<bigint>, f_fmt array<bigint>, l_utc array<bigint>, l_fmt array<bigint>, m array<double>"


def _combiner(costs: tuple[float, float]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def combine(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        segs, _ = _segments(pdf.sort_values("place"), costs)
        one = {"f_utc": segs[0][0], "f_fmt": segs[0][1], "l_utc": segs[-1][2], "l_fmt": segs[-1][3], "m": _compose(segs, costs).ravel()}
        return pd.DataFrame([{"source": key[0], "place": key[1], **one}])

    return combine


def _chooser(costs: tuple[float, float]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        entry, exit_ = pdf.entry.iloc[0], pdf.exit.iloc[0]
        segs, of = _segments(pdf, costs)
        choice = np.array(_decode(segs, None if pd.isna(entry) else int(entry), None if pd.isna(exit_) else int(exit_), costs))[of]
        return pd.DataFrame({"source": key[0], "place": pdf.place, "entry": choice[:, 0], "exit": choice[:, 1]})

    return choose


def viterbi_choice(rows: DataFrame, scratch: Scratch, costs: tuple[float, float] = (SWITCH, BACK)) -> DataFrame:
    """(source, place, entry): the interpretation chosen for each of ``rows``: source, place in the record order, and per interpretation utc, fmt and cost in arrays of one length."""
    whole = lambda c: F.transform(c, lambda x: x.cast("bigint"))
    diagonal = F.flatten(F.transform("cost", lambda c, i: F.transform("cost", lambda _, j: F.when(i == j, c).otherwise(F.lit(1e18)))))
    utc, fmt = whole("utc"), whole("fmt")
    level = rows.select("source", "place", utc.alias("f_utc"), fmt.alias("f_fmt"), utc.alias("l_utc"), fmt.alias("l_fmt"), diagonal.alias("m"))
    # place is partition << 33 | row: blocks of BLOCK consecutive places keep the order and bound what one task combines
    block = F.floor(F.col("place") / BLOCK).cast("bigint")
    levels = [level]
    while True:
        packed = scratch.cut(levels[-1].groupBy("source", block.alias("b")).applyInPandas(_combiner(costs), f"source string, place bigint, {_SEG}"))
        levels.append(packed)
        if (packed.groupBy("source").count().agg(F.max("count")).first()[0] or 0) <= BLOCK:
            break
    fixed = levels.pop().withColumn("entry", F.lit(None).cast("int")).withColumn("exit", F.lit(None).cast("int"))
    schema = "source string, place bigint, entry int, exit int"
    picked = fixed.groupBy("source").applyInPandas(_chooser(costs), schema)
    while levels:
        ends = picked.select("source", F.col("place").alias("b"), "entry", "exit")
        picked = levels.pop().withColumn("b", block).join(ends, ["source", "b"]).groupBy("source", "b").applyInPandas(_chooser(costs), schema)
    return picked.select("source", "place", "entry")


def source_habits(rows: DataFrame, settled: float) -> DataFrame:
    """What each source writes, from ``rows`` (source, locale, cands): the costs of the day standing first and behind, and the settled order, 0 if none.

    An order is settled if no two transitions (``settled``) could make up for the other.
    """
    has = lambda k: F.exists("cands", lambda c: c["order"] == k)
    plain = rows.groupBy("source").agg(F.count_if(has(1) & ~has(2)).alias("n1"), F.count_if(has(2) & ~has(1)).alias("n2"), F.min("locale").alias("locale"))
    month_first = F.regexp_extract("locale", r"[-_]([A-Z]{2})$", 1).isin(*MONTH_FIRST_REGIONS)
    told = F.when(F.col("locale").isNull(), 0.0).when(month_first, -LOCALE_WEIGHT).otherwise(LOCALE_WEIGHT)
    odds = plain.select("source", (told + F.log((F.col("n1") + 1) / (F.col("n2") + 1))).alias("odds"))
    return odds.select("source", F.log1p(F.exp(-F.col("odds"))).alias("cost1"), F.log1p(F.exp("odds")).alias("cost2"), F.when(F.col("odds") > settled, 1).when(F.col("odds") < -settled, 2).otherwise(0).alias("settled"))


def normalise(values: DataFrame, feeds: DataFrame, costs: tuple[float, float] = (SWITCH, BACK), again_cost: float = AGAIN_COST) -> DataFrame:
    """UTC instants of ``values`` (tab, row_key, content, feed, loaded_at): tab, row_key, utc_us, fmt, feed.

    ``feeds`` (feed, home_zone, locale) is a fixed small table of the sources; a null locale is learned. ``costs`` are those of a
    switch of format and of a step back in time.
    """
    spark = values.sparkSession
    scratch = Scratch(spark, "timestamps")
    zones = [str(z) for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds()]
    once = values.where(F.col("content").isNotNull()).groupBy("tab", "row_key").agg(F.min(F.struct("loaded_at", "feed", "content")).alias("r")).select("tab", "row_key", "r.*")
    sources = feeds.groupBy("feed").agg(F.min("home_zone").alias("home_zone"), F.min("locale").alias("locale"))
    order = ["source", "loaded_at", "tab", "row_key"]
    known = once.join(sources, "feed", "left").select(F.coalesce("feed", F.lit("")).alias("source"), *order[1:], "home_zone", "locale", trimmed("content").alias("s"))
    # placed before anything is parsed: what draws the ranges reads the plain columns only
    placed = known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    # values without a reading go only after the cut: pushed below the projections, the test would repeat them all
    rows = scratch.cut(_with_candidates(placed, zones).select("source", "place", "tab", "row_key", "locale", "cands")).where(F.size("cands") > 0)
    habits = scratch.cut(source_habits(rows, 2 * sum(costs)))
    cost = F.transform("cands", lambda c: F.when(c["order"] == 1, F.col("cost1")).when(c["order"] == 2, F.col("cost2")).otherwise(0.0) + F.when(c["again"], again_cost).otherwise(0.0))
    ready = rows.join(habits, "source").select("source", "place", F.col("cands.utc").alias("utc"), F.col("cands.fmt").alias("fmt"), cost.alias("cost"))
    chosen = rows.join(viterbi_choice(ready, scratch, costs), ["source", "place"]).withColumn("chosen", F.col("cands")[F.col("entry")])
    # the exact check: what contradicts the settled order of its source is no certain date
    sure = chosen.join(habits.select("source", "settled"), "source").where((F.col("chosen.order") == 0) | (F.col("settled") == 0) | (F.col("chosen.order") == F.col("settled")))
    return sure.select("tab", "row_key", F.col("chosen.utc").alias("utc_us"), F.col("chosen.fmt").alias("fmt"), F.col("source").alias("feed"))


def publication_dates(elements: DataFrame, metas: DataFrame) -> DataFrame:
    """The typed dates and times of a publication corpus."""
    e = elements.where(F.col("kind") == "date").select(F.lit("metadata_elements").alias("tab"), F.col("elem_key").alias("row_key"), "content", "feed", "loaded_at")
    m = metas.where(F.col("property").startswith("dcterms:")).select(F.lit("metas").alias("tab"), F.col("meta_key").alias("row_key"), "content", "feed", "loaded_at")
    return reduce(DataFrame.unionByName, (e, m))
