from collections import Counter, defaultdict

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from codexmill.llm import mixing, packing, tokens


@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_best_fit(sizes, capacity):
    bins = packing.best_fit(np.array(sizes, np.int64), capacity)
    fill = Counter()
    for b, s in zip(bins, sizes, strict=True):
        fill[b] += s
    assert all(v <= capacity for v in fill.values())
    assert len(fill) <= 1.7 * -(-sum(sizes) // capacity) + 1
    assert sum(2 * v <= capacity for v in fill.values()) <= 1


def test_pack_levels(spark):
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 300, 3000)] + [2500, 1024, 0]
    items = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(0, sizes[0], "copy"), (9999, None, "n")], "doc_id long, n_tokens long, id string")
    packs = spark.createDataFrame([("a", 512), ("b", 1024), ("none", 0), (None, 5), ("a", 512)], "pack_name string, capacity_tokens int")
    out = packing.pack(items, packs, group=200)
    rows = packing.members(out).collect()
    for pack, capacity in (("a", 512), ("b", 1024)):
        got, fill = defaultdict(list), Counter()
        for r in rows:
            if r.pack_name == pack:
                got[r.doc_id].append((r.first_token, r.n_tokens))
                fill[r.container] += r.n_tokens
        for i, s in enumerate(sizes):
            parts = sorted(got.pop(i, []))
            assert sum(n for _, n in parts) == s
            assert [f for f, _ in parts] == [k * capacity for k in range(len(parts))]
            assert len(parts) == -(-s // capacity)
        assert not got
        assert max(fill.values()) <= capacity
        assert len(fill) <= 1.02 * sum(sizes) / capacity + 2
        assert sum(2 * v <= capacity for v in fill.values()) <= 1  # merged to the root
    assert {r.pack_name for r in rows} == {"a", "b"}
    assert packing.pack(items.limit(0), packs).count() == 0


def test_nothing_that_fits_stays_apart(spark):
    """Items that fill poorly in every group are merged to the root, however little a level gains."""
    items = spark.createDataFrame([(i, 60 if i % 40 else 3) for i in range(4000)], "doc_id long, n_tokens long")
    out = packing.pack(items, spark.createDataFrame([("a", 100)], "pack_name string, capacity_tokens int"), group=50).collect()
    assert sum(r.used for r in out) == 3900 * 60 + 100 * 3
    assert sum(2 * r.used <= 100 for r in out) <= 1
    assert len(out) == 3900


def test_sizes(spark):
    df = spark.createDataFrame([(1, "hello world", 5), (2, "", 6), (3, None, 7), (4, "é☃ " * 1000, 8)], "doc_id long, text string, n_tokens2 long")
    got = {r.doc_id: r.n_tokens for r in tokens.token_sizes(df).collect()}
    encode = tokens.encoding(tokens.TOKENIZER_DIR, tokens.VOCABULARY).encode_ordinary
    assert got == {1: len(encode("hello world")), 2: 0, 3: 0, 4: len(encode("é☃ " * 1000))}


def test_mix_meets_shares_and_caps(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "big" if i % 5 else "small", int(rng.integers(1, 200)), "x") for i in range(4000)] + [(5000, "other", 10, ""), (5001, None, 10, ""), (5002, "big", 0, ""), (1, "big", None, "")]
    sized = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, u string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    counted = mixing.mixture(sized.where("n_tokens is not null"), targets)
    share = {r.source: r for r in mixing.shares(counted, targets).collect()}
    assert abs(share["big"].actual_share - 0.5 / 0.9) < 0.01
    assert abs(share["small"].actual_share - 0.4 / 0.9) < 0.01
    assert share["gone"].actual_share == 0
    assert share["big"].most_repeats <= 1
    assert share["small"].most_repeats <= 3
    mixed = mixing.mix(counted).collect()
    assert Counter(r.doc_id for r in mixed) == {r.doc_id: r.repeats for r in counted.collect() if r.repeats}
    assert [r.place for r in mixed] == sorted(r.place for r in mixed)
    assert mixing.mixture(sized.limit(0), targets).count() == 0


def test_total_with_short_sources():
    sizes = mixing.target_sizes({"a": 100.0, "b": 10.0, "c": 0.0}, {"a": 0.5, "b": 0.4, "c": 0.1}, {"a": 1, "b": 2, "c": 3}, total=60)
    assert sizes == {"b": 20.0, "a": 40.0}


def test_quantiles_follow_poisson():
    u = (np.arange(100_000) + 0.5) / 100_000
    counts = mixing.quantile(u, 1.7, 40)
    assert abs(counts.mean() - 1.7) < 0.01
    assert abs(counts.var() - 1.7) < 0.02
