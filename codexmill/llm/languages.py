"""Missing or wrong language labels (problem 6).

Texts are scored as byte buffers: hashed four-byte grams look up the log-likelihood of each language, sums over
sentences come from one segmented reduction, and a Viterbi pass over all texts of a batch at once joins sentences to
passages. The language of a passage is then a Bayesian fusion in plain SQL: its text likelihood, the declared label
(with the reliability that the whole corpus shows for that label) and the prior of its book, smoothed towards its feed
and the feed towards the corpus, all three levels from grouped aggregation over every passage.

The grams are fitted on a bounded sample of labelled rows (``sample_per_language`` texts in expectation, taken by hash),
re-labelled sentence by sentence to shed wrong labels. Everything else covers all rows.

Defined results: null and empty texts have no passages; a label that names no known language is none; a null book falls
back to its feed's prior and a null feed to the corpus; copies of a row count once in results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexmill.session import Scratch

LANGUAGES = ("en", "de", "fr", "es", "it", "nl", "pt", "ru")
# How labels name the languages, besides the two-letter codes.
LABELS = {
    "en": ("eng", "english", "englisch", "anglais", "inglés", "ingles", "inglese", "engels", "английский"),
    "de": ("deu", "ger", "german", "deutsch", "allemand", "alemán", "aleman", "tedesco", "duits", "немецкий"),
    "fr": ("fra", "fre", "french", "français", "francais", "französisch", "francés", "frances", "francese", "frans", "французский"),
    "es": ("spa", "spanish", "español", "espanol", "castellano", "castilian", "spanisch", "espagnol", "spagnolo", "spaans", "испанский"),
    "it": ("ita", "italian", "italiano", "italienisch", "italien", "italiaans", "итальянский"),
    "nl": ("nld", "dut", "dutch", "nederlands", "flemish", "vlaams", "niederländisch", "néerlandais", "olandese", "нидерландский"),
    "pt": ("por", "portuguese", "português", "portugues", "portugiesisch", "portugais", "portoghese", "portugees", "португальский"),
    "ru": ("rus", "russian", "русский", "russisch", "russe", "ruso", "russo"),
}

SAMPLE_PER_LANGUAGE = 400
#: Characters of the sample that one language may have in expectation, and the longest text that is taken for it; both bound
#: what the fit brings to the driver.
SAMPLE_CHARS, SAMPLE_LONGEST = 8 << 20, 1 << 20
BITS = 16
PASSAGE_CHARS = 100
#: Cost of a change of language between sentences, in nats of tempered likelihood.
SWITCH = 4.0
#: Grams overlap, so their evidence is counted at this fraction.
TEMPER = 0.25
#: Weight in pseudo-passages of the broader level of a prior.
SMOOTHING = 4.0
#: A sentence of fewer letters is no sentence of its own.
MIN_LETTERS = 8
CHUNK_BYTES = 1 << 20


def label_code(label: Column) -> Column:
    """The two-letter code that a label names, null if none."""
    names = {n: c for c, ns in LABELS.items() for n in (c, *ns)}
    lookup = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.try_element_at(lookup, F.element_at(F.split(F.lower(F.trim(label)), "[-_ ]"), 1))


def _grams(buf: np.ndarray) -> np.ndarray:
    b = np.concatenate([buf, np.full(3, 32, np.uint8)]).astype(np.uint32)
    x = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16) | (b[3:] << 24)
    return (x * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _sentences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of each sentence and its text; a sentence ends behind a stop, question or exclamation mark or line end."""
    stop = (buf == 46) | (buf == 33) | (buf == 63) | (buf == 10)
    stop[:-1] &= ~stop[1:]
    starts = np.unique(np.concatenate([np.flatnonzero(stop) + 1, offs[:-1][offs[:-1] < offs[1:]]]))
    starts = starts[starts < offs[-1]]
    text = np.searchsorted(offs, starts, "right") - 1
    # closing quotes, tags and numbers behind a stop are no sentence: with too few letters they stay with the one before
    letters = np.add.reduceat(((buf >= 97) & (buf <= 122)) | (buf >= 195), starts) if len(starts) else starts
    keep = (letters >= MIN_LETTERS) | np.r_[True, text[1:] != text[:-1]][: len(text)]
    return starts[keep], text[keep]


def _scores(buf: np.ndarray, starts: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.add.reduceat(table[_grams(buf)], starts, axis=0)


def _best_path(ll: np.ndarray, text: np.ndarray, n_texts: int) -> np.ndarray:
    """Language of each sentence: Viterbi over all texts at once, one step for the sentences of the same ordinal."""
    n, k = ll.shape
    first = np.searchsorted(text, np.arange(n_texts))
    count = np.searchsorted(text, np.arange(n_texts), "right") - first
    rank = np.argsort(-count, kind="stable")
    first, count = first[rank], count[rank]
    back = np.zeros((n, k), np.int8)
    best = np.zeros((n_texts, k), np.float32)
    out = np.zeros(n, np.int8)
    steps = int(count[0]) if n_texts else 0
    alive = [int(np.searchsorted(-count, -t, "left")) for t in range(steps)]  # texts with more than t sentences
    own = np.arange(k, dtype=np.int8)
    for t in range(steps):
        m = alive[t]
        at = first[:m] + t
        if t:
            top = best[:m].argmax(1)
            cut = best[:m][np.arange(m), top] - SWITCH
            stay = best[:m] >= cut[:, None]
            back[at] = np.where(stay, own[None], top[:, None])
            best[:m] = np.maximum(best[:m], cut[:, None])
        best[:m] += ll[at]
    state = best.argmax(1).astype(np.int8)
    for t in range(steps - 1, -1, -1):
        m = alive[t]
        at = first[:m] + t
        out[at] = state[:m]
        state[:m] = back[at, state[:m]]
    return out


def _passages(buf: np.ndarray, offs: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first character, characters, likelihoods) of each passage."""
    starts, text = _sentences(buf, offs)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, len(LANGUAGES)), np.float32)
    ll = _scores(buf, starts, table) * TEMPER
    lang = _best_path(ll, text, len(offs) - 1)
    new = np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])])
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    solid = np.flatnonzero(buf > 32)  # passages are measured without the white space around them
    p_start, p_text = starts[new], text[new]
    p_end = np.r_[starts[new[1:]], offs[-1]]
    p_end = np.minimum(p_end, offs[p_text + 1])
    i, j = np.searchsorted(solid, p_start), np.searchsorted(solid, p_end) - 1
    some = i <= j
    i, j, new, p_text = i[some], j[some], new[some], p_text[some]
    sums = np.add.reduceat(ll, np.flatnonzero(np.r_[True, (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])]), axis=0)[some]
    a, b = solid[i], solid[j] + 1
    return p_text, points[a] - points[offs[p_text]], points[b] - points[a], sums


def fit(texts: list[tuple[str, str]], rounds: int = 2) -> np.ndarray:
    """Log-likelihood table of hashed grams per language, from texts with their labelled language."""
    k = len(LANGUAGES)
    data = [(np.frombuffer(t.encode(), np.uint8), LANGUAGES.index(c)) for c, t in texts if t]
    counts = np.full((1 << BITS, k), 0.05)
    for buf, c in data:
        np.add.at(counts[:, c], _grams(buf), 1.0)
    table = _table(counts)
    for _ in range(rounds):
        counts = np.full((1 << BITS, k), 0.05)
        for buf, _c in data:
            starts, text = _sentences(buf, np.array([0, len(buf)]))
            lang = _best_path(_scores(buf, starts, table) * TEMPER, text, 1)
            np.add.at(counts, (_grams(buf), np.repeat(lang, np.diff(np.r_[starts, len(buf)]))), 1.0)
        table = _table(counts)
    return table


def _table(counts: np.ndarray) -> np.ndarray:
    p = counts / counts.sum(0)
    return np.log(p / p.mean(1, keepdims=True)).astype(np.float32)


def fit_on_sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> np.ndarray:
    """Fits on a bounded sample of ``labelled`` (key, code, text): about ``per_language`` texts a language, by hash of the key."""
    known = labelled.where(F.col("code").isNotNull() & F.length("text").between(1, SAMPLE_LONGEST))
    sizes = {r["code"]: (r["n"], r["chars"]) for r in known.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}  # at most one row a language
    if not sizes:
        return np.zeros((1 << BITS, len(LANGUAGES)), np.float32)
    share = F.create_map(*(F.lit(x) for c, (n, chars) in sizes.items() for x in (c, min(1.0, per_language / n, SAMPLE_CHARS / chars))))
    unit = F.pmod(F.xxhash64("key"), F.lit(1 << 30)) / float(1 << 30)
    rows = known.where(unit < share[F.col("code")]).select("code", lowered(F.col("text")).alias("text")).collect()
    return fit(sorted((r["code"], r["text"]) for r in rows))


_PASSAGE = "i int, first int, chars int, ll array<float>"


def _score_batches(table: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            if not len(text):
                continue
            offs_all = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :]
            buf_all = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.zeros(0, np.uint8)
            at = 0
            while at < len(text):
                upto = max(at + 1, int(np.searchsorted(offs_all, offs_all[at] + CHUNK_BYTES, "right")) - 1)
                offs = offs_all[at : upto + 1]
                row, first, chars, ll = _passages(buf_all[offs[0] : offs[-1]], offs - offs[0], table)
                if len(row):
                    keep = [batch.column(c).take(pa.array(row + at)) for c in range(batch.num_columns - 1)]
                    order = np.arange(len(row)) - np.searchsorted(row, row)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(row) + 1) * len(LANGUAGES), pa.int32()), pa.array(ll.ravel(), pa.float32()))
                    yield pa.RecordBatch.from_arrays([*keep, pa.array(order, pa.int32()), pa.array(first, pa.int32()), pa.array(chars, pa.int32()), lists], names=[*batch.schema.names[:-1], "i", "first", "chars", "ll"])
                at = upto

    return run


def lowered(text: Column) -> Column:
    """The text in lower case with as many characters as it has (the capital I with a dot alone would become two)."""
    return F.lower(F.translate(text, "\u0130", "i"))


def passages(rows: DataFrame, table: np.ndarray) -> DataFrame:
    """Passages of ``rows`` (tab, row_key, pub_id, feed, label, text): those columns but text, and i, first, chars, ll."""
    source = rows.select("tab", "row_key", "pub_id", "feed", "label", lowered(F.col("text")).alias("text")).where(F.col("text").isNotNull())
    return source.mapInArrow(_score_batches(table), f"tab string, row_key bigint, pub_id string, feed string, label string, {_PASSAGE}")


def fuse(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Language and confidence of each passage, from its text, its label and its place in the corpus.

    Adds ``lang`` and ``confidence``. All passages are counted once, per book, feed and label; the broader priors are sums of
    those counts, and all are joined back.
    """
    k = len(LANGUAGES)
    best = F.array_position("ll", F.array_max("ll").cast("float")).cast("int") - 1
    p = found.withColumn("guess", best).withColumn("code", F.coalesce(label_code(F.col("label")), F.lit("")))
    counted = scratch.cut(p.groupBy("pub_id", "feed", "code").agg(*(F.count_if(F.col("guess") == i).cast("double").alias(f"n{i}") for i in range(k))))
    tally = lambda *by: counted.groupBy(*by).agg(*(F.sum(f"n{i}").alias(f"n{i}") for i in range(k)))
    vector = lambda *c: F.array(*(F.col(f"{c[0]}{i}") for i in range(k)))
    add = lambda a, b, w: F.zip_with(a, b, lambda x, y: x + w * y)

    def share(v: Column) -> Column:
        total = F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
        return F.transform(v, lambda x: x / total)

    counts = tally().first()  # the corpus prior: one number a language
    counts = [n or 0.0 for n in counts]
    world = F.array(*(F.lit((n + 1.0) / (sum(counts) + k)) for n in counts))
    feeds = tally("feed").select(F.col("feed").alias("f_feed"), share(add(vector("n"), world, SMOOTHING)).alias("of_feed"))
    books = tally("pub_id", "feed").select(F.col("pub_id").alias("b_pub"), F.col("feed").alias("b_feed"), vector("n").alias("n_book"))
    labels = tally("code").select(F.col("code").alias("l_code"), F.zip_with(share(add(vector("n"), world, SMOOTHING)), world, lambda x, w: F.log(x / w)).alias("of_label"))
    placed = (
        p.join(books, p.pub_id.eqNullSafe(F.col("b_pub")) & p.feed.eqNullSafe(F.col("b_feed")), "left")
        .join(F.broadcast(labels), F.col("code") == F.col("l_code"), "left")  # at most one row a language and one without
        .join(feeds, F.col("feed").eqNullSafe(F.col("f_feed")), "left")
    )
    prior = F.transform(share(add(F.col("n_book"), F.col("of_feed"), SMOOTHING)), lambda x: F.log(x))
    score = F.zip_with(F.zip_with(F.transform("ll", lambda x: x.cast("double")), prior, lambda a, b: a + b), F.col("of_label"), lambda a, b: a + b)
    fused = placed.withColumn("score", score).withColumn("top", F.array_max("score"))
    mass = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    names = F.array(*(F.lit(x) for x in LANGUAGES))
    lang = names[F.array_position("score", F.col("top")).cast("int") - 1]
    return fused.select("tab", "row_key", "pub_id", "feed", "label", "code", "i", "first", "chars", lang.alias("lang"), (1.0 / mass).alias("confidence"))


def merged(fused: DataFrame) -> DataFrame:
    """Neighbouring passages of one language as one: tab, row_key, code, lang, first, chars, confidence."""
    # one order serves both: of copies of a passage the least one stays, and what stays is compared with the one before
    w = Window.partitionBy("tab", "row_key").orderBy("i", "first", "chars", "lang", "code", "confidence")
    once = fused.withColumn("before", F.lag("i").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("i")))
    turn = once.withColumn("turn", F.when(F.lag("lang").over(w).eqNullSafe(F.col("lang")), 0).otherwise(1)).withColumn("run", F.sum("turn").over(w))
    return (
        turn.groupBy("tab", "row_key", "run", "lang")
        .agg(F.min("first").alias("first"), (F.max(F.col("first") + F.col("chars")) - F.min("first")).alias("chars"), F.min("code").alias("code"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"))
        .drop("run")
    )


def detect(rows: DataFrame, labelled: DataFrame, name: str = "languages") -> DataFrame:
    """Merged passages of ``rows``, the grams being fitted on a sample of ``labelled``."""
    scratch = Scratch(rows.sparkSession, name)
    return merged(fuse(scratch.cut(passages(rows, fit_on_sample(labelled))), scratch))


def text_languages(merged_: DataFrame) -> DataFrame:
    """The language of each text as a whole: that of most of its characters, its share of them and its confidence (ties: by name), beside all its languages."""
    per = merged_.groupBy("tab", "row_key", "lang").agg(F.sum("chars").alias("chars"), (F.sum(F.col("confidence") * F.col("chars")) / F.sum("chars")).alias("confidence"), F.min("code").alias("code"))
    best = per.groupBy("tab", "row_key").agg(F.min(F.struct(-F.col("chars"), "lang", "confidence", "code")).alias("b"), F.sum("chars").alias("n"), F.sort_array(F.collect_list("lang")).alias("languages"))
    return best.select("tab", "row_key", F.col("b.lang").alias("lang"), F.col("b.confidence").alias("confidence"), (-F.col("b.col1") / F.col("n")).alias("share"), F.nullif("b.code", F.lit("")).alias("label"), "languages")


def corpus_texts(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """All non-empty texts, however short, with their label: tab, row_key, pub_id, feed, label, text."""
    docs = documents.select(F.lit("documents").alias("tab"), F.col("doc_id").alias("row_key"), "pub_id", "feed", F.col("lang").alias("label"), "text")
    told = elements.where(F.col("kind") == "language").groupBy("pub_id").agg(F.min_by("content", "ord").alias("of_book"))
    elems = (
        elements.where(F.length("content") > 0)
        .join(told, "pub_id", "left")
        .select(F.lit("metadata_elements").alias("tab"), F.col("elem_key").alias("row_key"), "pub_id", "feed", F.coalesce("xml_lang", "of_book").alias("label"), F.col("content").alias("text"))
    )
    return docs.where(F.length("text") > 0).unionByName(elems)
