"""Text cut off by field limits or in transfer (problem 9).

Intact values are cut artificially to make positives, and ended in the ways that whole texts end (with and without the
stop, on an ellipsis, on a closing line) to make negatives; a hashed logistic regression is trained on closing
characters and words, punctuation, open brackets, marks and length-to-limit features, and then scores every record.

Two statistics cover all rows: the lengths at which the values of a source and feed pile up more than chance allows (its
limits, of which there may be several, and longer values beside them), and how often a last line of any length ends
texts (closing lines repeat, cut ones do not). The regression is fitted on a bounded sample taken by hash (``TRAIN_TEXTS``
in expectation).

Texts are never shuffled. Python reads each once and leaves the sum of the weights that depend on the text alone; limits and
line counts are joined to that by hashes, and their weights are added from a table of the few cases.

Defined results: null, empty and blank texts are whole; a null source or feed is a source or feed of its own; repeated
texts are judged alike; texts of any length are read whole (brackets and tags are balanced over all of it).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import Scratch

TRAIN_TEXTS = 12000
#: Characters of the sample in expectation, and the longest text that is taken for it; both bound what the fit brings to the driver.
TRAIN_CHARS, TRAIN_LONGEST = 128 << 20, 1 << 20
BITS = 18
EPOCHS = 6
#: Records are reported as cut from this probability on.
THRESHOLD = 0.5
#: Chance, over all lengths of a source and feed, that a pile is taken for a limit; and what it weighs in nats that hardly
#: any value (one in eight of the pile) is longer.
FALSE_LIMIT, CEILING = 0.001, 6.0
#: A source writes without stops, or ends on ellipses, if at least this share of its values does so below their limit.
BARE_STYLE, MARK_STYLE = 0.25, 0.03
#: How often a text that ends on a closing line is taken as an example.
CLOSING_WEIGHT = 8
SEED = 7

# Characters that end a sentence, that close behind it, and marks set in place of a rest.
STOPS = ".!?。！？"
CLOSERS = "\"'”’»“‘›)]*–—_~#"
MARKS = ("…", "...", "[...]", "[…]", "�")
_TAG_END = re.compile(r"(?:\s*</?[A-Za-z][^<>]*>)+\s*$")
_BOUNDARY = re.compile(rf"[{re.escape(STOPS)}](?:[\"'”’»“‘›)]|\s(?=[»›]))*(?=\s|$)")
_WORDS = re.compile(r"\S+")


#: From this bucket on a last line is one that ends many texts (three or more).
AGAIN = 2
#: The ways a text ends.
KINDS = ("tag", "stop", "mark", "closer", "digit", "sign", "bare")


def _bucket(n: int) -> int:
    return (n + 1).bit_length() - 1


def _hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(f.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1) for f in names]


def text_features(text: str, source: str | None) -> tuple[list[int], str]:
    """Hashed features of a text's end, the same number for every text, and its kind."""
    solid = text.rstrip()
    space = text[len(solid) :]
    tagged = _TAG_END.search(solid) if solid.endswith(">") else None
    body = solid[: tagged.start()].rstrip() if tagged else solid
    mark = next((m for m in MARKS if body.endswith(m)), "")
    core = body[: len(body) - len(mark)] if mark else body
    bare = core.rstrip()
    # the wording is read without the stop, so that what ends a sentence is known with and without one
    stem = bare.rstrip(CLOSERS + STOPS + " \u00a0\u202f")[-48:].lower()
    words = _WORDS.findall(stem)[-3:]
    end = bare[-1:]
    inner = bare.rstrip(CLOSERS + " \u00a0\u202f")[-1:]
    kind = "tag" if tagged else "stop" if inner and inner in STOPS else "mark" if mark else "closer" if end and end in CLOSERS else "digit" if end.isdigit() else "sign" if end and not end.isalnum() else "bare"
    opened = min(2, max(0, bare.count("(") - bare.count(")"))) + 3 * min(2, max(0, bare.count("«") - bare.count("»"))) + 9 * min(2, max(0, text.count("<p") - text.count("</p")))
    quotes = (bare.count("“") + bare.count("”") + bare.count("„")) % 2
    out = [
        f"kind={kind}",
        f"kind={kind} mark={mark}",
        f"kind={kind} space={space[:1] == ' '}",
        f"source={source} kind={kind}",
        f"open={opened}",
        f"open={opened} kind={kind}",
        f"quotes={quotes} kind={kind}",
        f"gap={len(core) - len(bare) > 0} mark={mark}",
        f"w1={words[-1] if words else ''}",
        f"w2={' '.join(words[-2:])}",
        f"w3={' '.join(words[-3:])}",
        f"w1={words[-1] if words else ''} kind={kind}",
    ]
    out += [f"s{n}={core[-n:]}" for n in (1, 2, 3)]
    out += [f"t{n}={stem[-n:]}" for n in (2, 3, 4, 5, 6, 8, 10, 14)]
    return _hashed(out), kind


def place_features(kind: str, at_limit: bool, near_limit: bool, line_bucket: int) -> list[int]:
    """Hashed features of a text's length and last line among the others."""
    return _hashed([f"kind={kind} limit={at_limit}", f"limit={at_limit} near={near_limit}", f"line={line_bucket} kind={kind}", f"again={line_bucket >= AGAIN}"])


def features(text: str, source: str | None, at_limit: bool, near_limit: bool, line_count: int) -> list[int]:
    own, kind = text_features(text, source)
    return own + place_features(kind, at_limit, near_limit, _bucket(line_count))


def _cut(text: str, rng: np.random.Generator, bare_style: bool) -> str | None:
    """A prefix that ends within a word or sentence."""
    for _ in range(6):
        c = int(rng.integers(min(20, len(text) // 2), len(text)))
        head, rest = text[:c], text[c:]
        solid = head.rstrip()
        if not solid or not rest.strip() or solid.rstrip(CLOSERS)[-1:] in STOPS or rest.lstrip()[:1] in CLOSERS or (bare_style and rest.lstrip()[:1] in STOPS):
            continue
        if "\n" in rest[: len(rest) - len(rest.lstrip())]:
            continue
        return head
    return None


def examples(rows: list[tuple[str, str | None, int]], styles: dict[str | None, tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Training examples from intact (text, source, repeats of the last line); ``styles``: whether a source's whole values end without a stop, on ellipses."""
    rng = np.random.default_rng(SEED)
    x: list[list[int]] = []
    y: list[int] = []

    def add(text: str, source: str | None, cut: int, limit: bool, line: int = 1) -> None:
        x.append(features(text, source, limit, limit or bool(rng.random() < 0.1), line))
        y.append(cut)

    for text, source, line in rows:
        # closing lines are rare among texts, so that each counts several times
        for _ in range(CLOSING_WEIGHT if _bucket(line) >= AGAIN else 1):
            add(text, source, 0, bool(rng.random() < 0.02), line)
        ends = [m for m in _BOUNDARY.finditer(text)]
        bare, marked = styles.get(source, (False, False))
        for m in (ends[int(rng.integers(len(ends)))] for _ in range(2 if ends else 0)):
            whole = text[: m.start()]
            if bare or rng.random() < 0.03:
                add(whole, source, 0, False)
            if marked or rng.random() < 0.1:
                add(whole + ("…", "...")[int(rng.integers(2))], source, 0, False)
            add(text[: m.end()], source, 0, bool(rng.random() < 0.05))
        for _ in range(4):
            head = _cut(text, rng, bare)
            if head is None:
                continue
            r = rng.random()
            if r < 0.2:
                head += "…" if r < 0.1 else "..."
            elif r < 0.28:
                head += "�"
            # what is left of a line can be so short that it repeats by chance, but not often
            short = len(head) - head.rfind("\n") - 1 <= 12
            add(head, source, 1, bool(rng.random() < 0.5), int(rng.integers(1, 3)) if short else 1)
    return np.array(x, np.int64).reshape(len(y), -1), np.array(y, float)


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression on hashed features, by mini-batches with adaptive steps."""
    w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-6)
    rng = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 256):
            i = order[at : at + 256]
            p = 1 / (1 + np.exp(-np.clip(w[x[i]].sum(1), -30, 30)))
            flat, back = np.unique(x[i], return_inverse=True)
            step = np.bincount(back.ravel(), np.repeat(p - y[i], x.shape[1]), len(flat)) / len(i) + 1e-6 * w[flat]
            g2[flat] += step**2
            w[flat] -= 0.3 * step / np.sqrt(g2[flat])
    return w


def probability(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(w[x].sum(1), -30, 30)))


def last_line(text: Column) -> Column:
    """Hash of the last line, null where it is the only one."""
    whole = F.btrim(text, F.lit(" \t\r\n"))
    line = F.btrim(F.substring_index(whole, "\n", -1), F.lit(" \t\r"))
    return F.when(F.length(line) < F.length(whole), F.xxhash64(line))


def field_limits(rows: DataFrame) -> DataFrame:
    """(source, feed, measure, limits): the lengths at which different values of a source and feed pile up; ``rows``: source, feed, n, bytes, digest.

    A pile is a limit if so many values at one length, given those up to ten around it, would come by chance somewhere among
    all lengths with probability ``FALSE_LIMIT`` at most (bound of the Poisson tail). Fields are limited in characters or in
    bytes of UTF-8: the measure with the less likely pile is the one.
    """
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).alias("at")) for m, c in (("chars", "n"), ("bytes", "bytes"))))
    each = rows.select("source", "feed", "digest", F.explode(measures).alias("m")).select("source", "feed", "digest", "m.*")
    counts = each.groupBy("source", "feed", "measure", "at").agg(F.count_distinct("digest").alias("c"))
    by = Window.partitionBy("source", "feed", "measure")  # over distinct lengths, already counted
    piled = counts.withColumns({"near": F.sum("c").over(by.orderBy("at").rangeBetween(-10, 10)) - F.col("c"), "above": F.sum("c").over(by) - F.sum("c").over(by.orderBy("at")), "lengths": F.count("at").over(by)})
    chance = (F.col("near") + 1) / 20.0
    surprise = F.col("c") * F.log(F.col("c") / chance) - (F.col("c") - chance) + F.when(F.col("above") * 8 <= F.col("c"), CEILING).otherwise(0.0)
    heaps = piled.withColumn("surprise", surprise).where((F.col("c") > 2) & (F.col("c") > chance) & (F.col("at") >= 20) & (surprise >= F.log(F.col("lengths") / FALSE_LIMIT)))
    found = heaps.groupBy("source", "feed", "measure").agg(F.sort_array(F.collect_list("at")).alias("limits"), F.max("surprise").alias("surprise"))
    return found.groupBy("source", "feed").agg(F.max_by(F.struct("measure", "limits"), F.struct("surprise", "measure")).alias("x")).select("source", "feed", "x.*")


def _placed(rows: DataFrame, limits: DataFrame, lines: DataFrame) -> DataFrame:
    """``rows`` (source, feed, n, bytes, line, key) with at_limit, near_limit and line_count. Rows without a repeated line are spread by their key."""
    told = limits.select(F.col("source").alias("l_source"), F.col("feed").alias("l_feed"), "measure", "limits")
    counted = lines.select(F.col("line").alias("a_line"), "line_count")
    joined = (
        rows.join(told, F.col("source").eqNullSafe(F.col("l_source")) & F.col("feed").eqNullSafe(F.col("l_feed")), "left")
        .withColumns({"has_line": F.col("line").isNotNull(), "line": F.coalesce("line", F.xxhash64("key", "n"))})
        .join(counted, (F.col("line") == F.col("a_line")) & F.col("has_line"), "left")
    )
    in_bytes = F.col("measure") == "bytes"
    length = F.when(in_bytes, F.col("bytes")).otherwise(F.col("n"))
    # a character that did not fit in bytes leaves up to three free, or a mark of three in the place of one or two
    split = in_bytes & (F.col("bytes") != F.col("n"))
    fits = lambda x: (length == x) | (split & length.between(x - 3, x + 2))
    told = lambda test: F.coalesce(F.exists("limits", test), F.lit(False))
    return joined.select(*rows.columns, told(fits).alias("at_limit"), told(lambda x: fits(x) | length.between(x - 5, x)).alias("near_limit"), F.coalesce("line_count", F.lit(1)).alias("line_count"))


def _score_frames(w: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            seen = [text_features(t, s) for t, s in zip(pdf.text, pdf.source, strict=True)]
            own = w[np.array([x for x, _ in seen], np.int64)].sum(1) if seen else np.zeros(0)
            yield pdf.drop(columns="text").assign(own=own, kind=[k for _, k in seen])

    return run


def score(documents: DataFrame) -> DataFrame:
    """Probability that each text was cut: doc_id, source, feed, p_cut. Blank texts have none."""
    scratch = Scratch(documents.sparkSession, "truncation")
    rows = documents.select(F.col("doc_id").alias("key"), "source", "feed", "text", F.length("text").alias("n"), F.octet_length("text").alias("bytes"), last_line(F.col("text")).alias("line")).where(F.col("text").rlike(r"\S"))
    # what the statistics and the fit ask of all rows is written once, without the texts
    signs = scratch.cut(rows.select("key", "source", "feed", "n", "bytes", "line", F.xxhash64("text").alias("digest"), *_signs(F.col("text"))))
    limits = scratch.cut(field_limits(signs))
    lines = scratch.cut(signs.where(F.col("line").isNotNull()).groupBy("line").agg(F.count_distinct("digest").alias("line_count")).where(F.col("line_count") > 1))
    w = fit_on_sample(_placed(signs, limits, lines), rows)
    # keys and hashes go through Python as strings: columns with nulls would come back as floating numbers
    told = rows.select(F.col("key").cast("string"), "source", "feed", "n", "bytes", F.col("line").cast("string"), "text")
    own = told.mapInPandas(_score_frames(w), "key string, source string, feed string, n int, bytes int, line string, own double, kind string").withColumns({"key": F.col("key").cast("bigint"), "line": F.col("line").cast("bigint")})
    flags, cases = (False, True), [(f"{k} {a}", place_features(k, a, False, 1)[:1]) for k in KINDS for a in (False, True)]
    cases += [(f"{a} {b}", place_features("", a, b, 1)[1:2]) for a in flags for b in flags] + [(f"{k} {b}", place_features(k, False, False, b)[2:]) for k in KINDS for b in range(1, 64)]
    by_kind = F.create_map(*(F.lit(x) for name, at in cases for x in (name, float(w[at].sum()))))
    bucket = F.length(F.bin(F.col("line_count") + 1)) - 1
    text = lambda *c: F.concat_ws(" ", *(F.initcap(x.cast("string")) if k else x.cast("string") for k, x in c))
    kind, at, near = F.col("kind"), F.col("at_limit"), F.col("near_limit")
    total = F.col("own") + by_kind[text((0, kind), (1, at))] + by_kind[text((1, at), (1, near))] + by_kind[text((0, kind), (0, bucket))]
    return _placed(own, limits, lines).select(F.col("key").alias("doc_id"), "source", "feed", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))).alias("p_cut"))


def _signs(text: Column) -> list[Column]:
    """How a text ends: on a stop, on a mark, as a short label. The text is read from its end, so that closing tags and spaces of any length are passed in one go."""
    turned = F.reverse(text)
    behind = F.length(F.regexp_extract(turned, r"^(?:\s|>[^<>]*[A-Za-z]/?<)*+", 0))
    tail = F.substring(turned, behind + 1, F.length(turned))
    marked = tail.rlike(r"^(…|\.\.\.)")
    ended = tail.rlike(r"^([\"'”’»“‘›)]|[»›][ \u00a0\u202f])*[.!?]") & ~tail.rlike(r"^\.\.\.")
    label = (F.length(text) < 150) & ~text.rlike(r"[.!?](\s|$)") & ~marked & ~tail.startswith("�") & text.rlike(r"^\s*\p{Lu}")
    return [ended.alias("ended"), marked.alias("marked"), label.alias("label")]


def fit_on_sample(signs: DataFrame, rows: DataFrame, n_texts: int = TRAIN_TEXTS) -> np.ndarray:
    """Fits on a bounded sample of texts that show no sign of a cut: those that end on a stop, a tag or a repeated line, and short labels below their limit."""
    below = signs.where(~F.col("at_limit"))
    ways = below.groupBy("source").agg(F.avg((~F.col("ended") & ~F.col("marked") & (F.col("line_count") < 3)).cast("int")).alias("bare"), F.avg(F.col("marked").cast("int")).alias("marked"))
    styles = {r["source"]: (r["bare"] >= BARE_STYLE, r["marked"] >= MARK_STYLE) for r in ways.collect()}  # one row a source
    intact = below.where((F.col("ended") | (F.col("line_count") >= 3) | F.col("label")) & (F.col("n") <= TRAIN_LONGEST))
    sizes = {r["source"]: (r["k"], r["chars"]) for r in intact.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("chars")).collect()}  # one row a source
    if not sizes:
        return np.zeros(1 << BITS)
    share = F.create_map(*(F.lit(v) for s, (k, chars) in sizes.items() for v in (s, min(1.0, n_texts / len(sizes) / k, TRAIN_CHARS / len(sizes) / chars))))
    unit = F.pmod(F.xxhash64("key", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    taken = intact.where(unit < share[F.coalesce("source", F.lit(""))]).select("key", "line_count")
    sample = rows.select("key", "source", "text").join(taken, "key").collect()
    x, y = examples([(r["text"], r["source"], int(r["line_count"])) for r in sorted(sample, key=lambda r: (r["key"], r["text"]))], styles)
    return fit(x, y) if len(y) else np.zeros(1 << BITS)


def cut_rates(scored: DataFrame) -> DataFrame:
    """How often each source and feed cuts its texts."""
    cut = F.count_if(F.col("p_cut") >= THRESHOLD)
    return scored.groupBy("source", "feed").agg(F.count(F.lit(1)).alias("n_texts"), cut.alias("n_cut"), (cut / F.count(F.lit(1))).alias("rate"))
