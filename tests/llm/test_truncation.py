import numpy as np
from pyspark.sql import functions as F

from codexmill.llm import truncation

S = ["The old ferryman tells the story backwards while the others are asleep", "Every footnote hides a borrowed violin before the first snow falls", "The archive of letters admires the blue notebook after a long silence", "Nobody in the village repairs the broken clock for readers of every age", "Her younger sister explains how the bridge was built", "A careful reader burns a wooden staircase with a great deal of patience"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    return [". ".join(S[i] for i in rng.integers(0, len(S), rng.integers(3, 9))) + "." for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, feed string, text string, n int, line string")


def test_held_out_cuts(spark):
    """Whole texts train; held-out cuts are found, whole endings are not."""
    whole = texts(800, 1)
    held = texts(60, 2)
    rows = [(i, "book", "f", t, 0, "") for i, t in enumerate(whole)]
    rows += [(10_000 + i, "book", "f", t[: len(t) - 9], 0, "") for i, t in enumerate(held)]
    rows += [(20_000 + i, "book", "f", t + "\nTHE END", 0, "") for i, t in enumerate(held)]
    rows += [(30_000, "book", None, "", 0, ""), (30_001, None, "f", None, 0, ""), (30_002, "book", "f", " \n", 0, ""), (30_003, None, None, held[0], 0, ""), (30_004, "book", "f", held[1] * 500, 0, "")]
    got = {r.doc_id: r.p_cut for r in truncation.score(frame(spark, rows)).collect()}
    cut = [got[10_000 + i] >= truncation.THRESHOLD for i in range(len(held))]
    ended = [got[20_000 + i] >= truncation.THRESHOLD for i in range(len(held))]
    assert np.mean(cut) >= 0.95
    assert np.mean(ended) <= 0.05
    assert np.mean([got[i] >= truncation.THRESHOLD for i in range(len(whole))]) <= 0.01
    assert not {30_000, 30_001, 30_002} & set(got)
    assert got[30_003] < truncation.THRESHOLD
    assert got[30_004] < truncation.THRESHOLD


def test_limits(spark):
    """Piles are limits wherever they lie: under a longer value, two of one source, of few rows; lengths that repeat by chance or texts that do are none."""
    rng = np.random.default_rng(3)
    piles = [("blurb", "f", 280, 30), ("raised", "f", 280, 40), ("raised", "f", 320, 40), ("small", "f", 125, 5), ("one", "f", 280, 60), ("one", "f", 321, 1)]
    rows = [("blurb", "f", int(n), i) for i, n in enumerate(rng.integers(100, 280, 300))] + [("raised", "f", int(n), i) for i, n in enumerate(rng.integers(100, 320, 300))]
    rows += [("small", "f", 20 + 9 * i, i) for i in range(8)] + [("free", "f", int(n), i) for i, n in enumerate(rng.integers(100, 2000, 3000))]
    rows += [(s, f, n, 10_000 + i) for s, f, n, k in piles for i in range(k)] + [("same", "f", 90, 7) for _ in range(50)] + [(None, None, None, 1)]
    rows = [(*r[:3], r[2], r[3]) for r in rows] + [("octets", "f", int(n), 250, 20_000 + i) for i, n in enumerate(rng.integers(180, 240, 60))]
    df = spark.createDataFrame(rows, "source string, feed string, n int, bytes int, digest long")
    assert {r.source: r.limits for r in truncation.field_limits(df).collect()} == {"blurb": [280], "raised": [280, 320], "small": [125], "one": [280], "octets": [250]}


def test_signs_read_whole_endings(spark):
    close = "</p>\n" * 300  # closing markup longer than any window
    rows = [(1, "He left." + close), (2, "He left..." + close), (3, "He le" + close), (4, "Chapter One"), (5, "»Er ging. »"), (6, "x" * 1000 + ">")]
    got = {r.k: (r.ended, r.marked, r.label) for r in spark.createDataFrame(rows, "k int, text string").select("k", *truncation._signs(F.col("text"))).collect()}
    assert got == {1: (True, False, False), 2: (False, True, False), 3: (False, False, False), 4: (False, False, True), 5: (True, False, False), 6: (False, False, False)}


def test_empty(spark):
    assert truncation.score(frame(spark, [])).count() == 0
