import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codexmill.operators.nested import annotation_tables, flatten_buffer, flatten_nodes


def brute(payload):
    """Nodes of one payload by plain recursion."""
    try:
        root = json.loads(payload)
    except (TypeError, ValueError):
        return set()
    out = set()
    if not isinstance(root, dict):
        return out

    def held(o, member, base):
        v, path = o.get(member), f"{base}/{member}" if base else member
        if isinstance(v, dict):
            yield v, path
        if isinstance(v, list):
            yield from ((x, f"{path}/{i}") for i, x in enumerate(v) if isinstance(x, dict))

    def selectors(o, member, base):
        for s, p in held(o, member, base):
            out.add(("selector", p, base))
            selectors(s, "refinedBy", p)

    for a, p in held(root, "items", ""):
        out.add(("annotation", p, ""))
        for t, q in held(a, "target", p):
            out.add(("target", q, p))
            selectors(t, "selector", q)
        for _, q in held(a, "body", p):
            out.add(("body", q, p))
    return out


def fast(payloads):
    raw = [p.encode() for p in payloads]
    offs = np.r_[0, np.cumsum([len(x) for x in raw])]
    if not offs[-1]:
        return set()
    r = flatten_buffer(np.frombuffer(b"".join(raw), np.uint8), offs)
    return set(zip(r["row"].tolist(), *(r[c].to_pylist() for c in ("node_kind", "node_path", "parent_path")), strict=True)) if r else set()


ODD = [
    "",
    " ",
    "null",
    "[]",
    "{}",
    "{",
    '"',
    "\\",
    "[{}]",
    '{"items":{}}',
    '  {"items" : [ { } ] } \n',
    '{"items":[{}]} x',
    '{"items":{},}',
    '{"items":[{} {}]}',
    '{"items":[{},]}',
    '{"items"[{}]}',
    '{"items":{"target":{"selector":[1,{"refinedBy":{"refinedBy":[{},{}]}},"s",null,true]}}}',
    '{"items":{"body":[{},[{}],"{\\"type\\":1}"],"target":"{}"}}',
    '{"it\\u0065ms":{}}',
    '{"items":[{}],"items":3}',
    '{"items":3,"items":[{}]}',
    '{"a":"\\x","items":{}}',
    '{"a":"\\u12","items":{}}',
    '{"a":01,"items":{}}',
    '{"a":-0.5e+3,"items":{}}',
    '{"a":"\t","items":{}}',
    '{"items":{}}{"items":{}}',
    '{"a":{"items":{"target":{}}}}',
    '{"items":{"target":{"items":[{}],"selector":{}}}]',
    '{"é":"☃","items":[{"body":{"value":"☃\\\\"}}]}',
]


def test_odd_payloads_in_one_buffer():
    assert fast(ODD) == {(i, *n) for i, p in enumerate(ODD) for n in brute(p)}


@pytest.mark.parametrize("payload", ODD)
def test_odd_payload_alone(payload):
    assert fast([payload]) == {(0, *n) for n in brute(payload)}


leaf = st.none() | st.booleans() | st.integers(-5, 5) | st.text('ab"\\{}[]:,é\n', max_size=4)
member = st.sampled_from(["items", "target", "body", "selector", "refinedBy", "x"])
value = st.recursive(leaf, lambda c: st.lists(c, max_size=3) | st.dictionaries(member, c, max_size=4), max_leaves=25)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(member, value, max_size=4), max_size=4), st.integers(0, 60), st.booleans())
def test_random_payloads(objects, cut, ascii_only):
    payloads = [json.dumps(o, ensure_ascii=ascii_only) for o in objects]
    payloads += [p[:cut] for p in payloads]
    assert fast(payloads) == {(i, *n) for i, p in enumerate(payloads) for n in brute(p)}


def test_deep_and_long_payload():
    deep = '{"refinedBy":' * 3000 + "{}" + "}" * 3000
    payload = '{"items":{"target":{"selector":' + deep + '},"body":{"value":"' + "x" * 300_000 + '"}}}'
    nodes = fast([payload])
    assert len(nodes) == 3004
    assert max(len(n[2].split("/")) for n in nodes) == 3003


def test_tables_with_copies_nulls_and_extra_columns(spark):
    payload = '{"items":[{"id":"a","target":{"source":"s","selector":{"type":"T\\u0041"}},"body":{"value":7}}]}'
    df = spark.createDataFrame([(1, payload, "x"), (1, payload, "y"), (2, None, "z"), (None, payload, "q")], "set_key long, payload string, node_path string")
    tables = annotation_tables(df)
    assert {tuple(r) for r in tables["selector"].select("set_key", "node_path", "parent_path", "type").collect()} == {(k, "items/0/target/selector", "items/0/target", "TA") for k in (1, None)}
    assert [r["value"] for r in tables["body"].collect()] == ["7", "7"]
    assert flatten_nodes(df.limit(0)).count() == 0
