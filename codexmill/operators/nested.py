"""Deeply nested JSON records to flat, linked node tables (problem 1).

The payload column of an Arrow batch is one byte buffer with row offsets. The kernels below work on that buffer as a
whole: a structural index (quotes, brackets, separators) is computed with vectorised scans, every token gets the index
of the container that holds it (the parent-index kernel), and the nodes are then found level by level, each level's
keys and paths being a vectorised ``take`` from its parents. No payload is parsed row by row and the depth is not bounded.

Defined results: a null, empty, truncated or otherwise invalid payload, or one whose root is not an object, has no
nodes; of a repeated member name the last counts; repeated input rows give their nodes once; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The members that hold nodes, and the scalar members kept beside each node.
HOLDERS = ("items", "target", "body", "selector", "refinedBy")
SCALARS = ("id", "type", "source", "value", "created", "motivation")
KINDS = ("annotation", "target", "body", "selector")

#: Bytes of payload handled at once; a longer single payload is handled alone.
CHUNK_BYTES = 8 << 20

_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA, _STRING, _SCALAR = range(1, 9)
_CLASS = np.zeros(256, np.uint8)
for _c, _t in zip(b"{}[]:,", (_OPEN_O, _CLOSE_O, _OPEN_A, _CLOSE_A, _COLON, _COMMA), strict=True):
    _CLASS[_c] = _t
_CLASS[34] = _STRING
_SPACE = 9
_CLASS[[9, 10, 13, 32]] = _SPACE
_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdefABCDEF"]] = True
_ESC = np.zeros(256, bool)
_ESC[[*b'"\\/bfnrtu']] = True


def _slices(buf: np.ndarray, start: np.ndarray, stop: np.ndarray, valid: np.ndarray) -> pa.Array:
    """The byte ranges of ``buf`` as one string array, null where not valid."""
    length = np.where(valid, stop - start, 0)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(np.where(valid, start, 0) - offsets[:-1], length)
    mask = pa.array(valid).buffers()[1]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(buf[take].tobytes()), mask)


def _scalar_ok(buf: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    texts = _slices(buf, start, stop, np.ones(len(start), bool))
    ok = pc.match_substring_regex(texts, r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)$")
    return ok.to_numpy(zero_copy_only=False).astype(bool)


class StructuralIndex:
    """Tokens of all valid object payloads of one buffer, with the container of each."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        n_rows = len(offs) - 1
        bad = np.zeros(n_rows, bool)
        row_of = lambda pos: np.searchsorted(offs, pos, "right") - 1
        # escapes: in a run of backslashes every second one is escaped itself
        slash = np.flatnonzero(buf == 92)
        if len(slash):
            first = np.r_[True, np.diff(slash) > 1]
            start = np.maximum.accumulate(np.where(first, np.arange(len(slash)), 0))
            escaper = slash[(np.arange(len(slash)) - start) % 2 == 0]
            inside = escaper + 1 < offs[row_of(escaper) + 1]
            bad[row_of(escaper[~inside])] = True
            escaper = escaper[inside]
            nxt = buf[escaper + 1]
            bad[row_of(escaper[~_ESC[nxt]])] = True
            uni = escaper[nxt == 117]
            if len(uni):
                fits = uni + 6 <= offs[row_of(uni) + 1]
                bad[row_of(uni[~fits])] = True
                uni = uni[fits]
                bad[row_of(uni[~_HEX[buf[uni[:, None] + np.arange(2, 6)]].all(1)])] = True
            escaped = escaper + 1
        else:
            escaped = slash
        quote = buf == 34
        quote[escaped] = False
        q = np.flatnonzero(quote)
        q_row = row_of(q)
        bad |= np.bincount(q_row, minlength=n_rows) % 2 == 1
        q = q[~bad[q_row]]
        toggles = np.zeros(len(buf), np.uint8)
        toggles[q] = 1
        inside = (np.cumsum(toggles, dtype=np.uint8) & 1).astype(bool)  # opening quote up to the last character
        alive = np.repeat(~bad, np.diff(offs))
        bad[row_of(np.flatnonzero(inside & (buf < 32) & alive))] = True
        kind = _CLASS[buf]
        kind[~alive | inside] = _SPACE
        kind[q[1::2]] = _SPACE
        other = kind == 0
        begins = other.copy()
        begins[1:] &= ~other[:-1]
        ends = other.copy()
        ends[:-1] &= ~other[1:]
        begins[offs[:-1][offs[:-1] < len(buf)]] |= other[offs[:-1][offs[:-1] < len(buf)]]
        s0, s1 = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        if len(s0) == len(s1) and len(s0):
            bad[row_of(s0[~_scalar_ok(buf, s0, s1)])] = True
        elif len(s0):
            bad[row_of(np.r_[s0, s1 - 1])] = True
            s1 = np.resize(s1, len(s0))
        struct = np.flatnonzero((kind >= 1) & (kind <= 6))
        pos = np.concatenate([struct, q[::2], s0])
        end = np.concatenate([struct + 1, q[1::2] + 1, s1])
        typ = np.concatenate([kind[struct], np.full(len(q) // 2, _STRING, np.uint8), np.full(len(s0), _SCALAR, np.uint8)])
        order = np.argsort(pos, kind="stable")
        pos, end, typ = pos[order], end[order], typ[order]
        row = row_of(pos)
        bad |= np.bincount(row, minlength=n_rows) == 0

        def keep() -> None:
            nonlocal pos, end, typ, row
            ok = ~bad[row]
            pos, end, typ, row = pos[ok], end[ok], typ[ok], row[ok]

        keep()
        step = np.isin(typ, (_OPEN_O, _OPEN_A)).astype(np.int64) - np.isin(typ, (_CLOSE_O, _CLOSE_A))
        depth = np.cumsum(step)
        if len(depth):
            last = np.r_[row[1:] != row[:-1], True]
            rows, totals = row[last], depth[last]
            base = np.zeros(n_rows, np.int64)
            base[rows] = np.r_[0, totals[:-1]]
            depth = depth - base[row]
            bad[row[last & (depth != 0)]] = True
            bad[row[depth < 0]] = True
            ok = ~bad[row]
            pos, end, typ, row, depth = pos[ok], end[ok], typ[ok], row[ok], depth[ok]
        # parent-index kernel: order by (level, position); the last opened container of a level holds what follows
        opens = np.isin(typ, (_OPEN_O, _OPEN_A))
        closes = np.isin(typ, (_CLOSE_O, _CLOSE_A))
        n = len(pos)
        level = depth - opens + closes
        idx = np.arange(n)
        o = idx[opens]
        lv = np.concatenate([level, depth[opens]])
        at = np.concatenate([pos, pos[opens]])
        tok = np.concatenate([idx, o])
        is_container = np.concatenate([np.zeros(n, bool), np.ones(len(o), bool)])
        srt = np.lexsort((at, lv))
        tok, is_container, lv = tok[srt], is_container[srt], lv[srt]
        where = np.arange(len(tok))
        held = np.maximum.accumulate(np.where(is_container, where, -1)) if len(tok) else where
        content = ~is_container
        place = where - held - 1  # ordinal of the token in its container
        root = content & (lv == 0)
        container = np.full(n, -1)
        nth = np.zeros(n, np.int64)
        inner = content & ~root
        container[tok[inner]] = tok[held[inner]]
        nth[tok[inner]] = place[inner]
        # grammar by ordinal: object contents cycle key : value , and array contents value ,
        in_obj = (container >= 0) & (typ[container] == _OPEN_O)
        in_arr = (container >= 0) & (typ[container] == _OPEN_A)
        value = opens | (typ == _STRING) | (typ == _SCALAR)
        slot = nth % 4
        good = np.where(
            in_obj,
            np.where(typ == _CLOSE_O, (nth == 0) | (slot == 3), np.where(slot == 0, typ == _STRING, np.where(slot == 1, typ == _COLON, np.where(slot == 2, value, typ == _COMMA)))),
            np.where(in_arr, np.where(typ == _CLOSE_A, (nth == 0) | (nth % 2 == 1), np.where(nth % 2 == 0, value, typ == _COMMA)), typ == _OPEN_O),
        )
        bad[row[~good.astype(bool)]] = True
        tops = row[tok[root]]
        bad |= np.bincount(tops, minlength=n_rows) != 1
        self.buf, self.pos, self.end, self.typ, self.row, self.level = buf, pos, end, typ, row, level
        self.container, self.nth, self.in_obj, self.in_arr, self.value = container, nth, in_obj, in_arr, value
        self.ok = ~bad[row]
        # the key of an object's value is the content two places before it
        self.key = np.full(n, -1)
        flat = tok[content]
        back = np.full(n, -1)
        back[flat[2:]] = flat[:-2]
        named = self.ok & in_obj & value & (nth % 4 == 2)
        self.key[named] = back[named]
        self.close = np.full(n, -1)  # end of a container's text
        c = idx[closes & (container >= 0)]
        self.close[container[c]] = end[c]

    def named(self, names: tuple[str, ...]) -> np.ndarray:
        """For each token the number of its member name in ``names`` from 1, else 0; of repeated names the last counts."""
        code = np.zeros(len(self.pos), np.int64)
        at = np.flatnonzero(self.key >= 0)
        k = self.key[at]
        start, length = self.pos[k] + 1, self.end[k] - self.pos[k] - 2
        for i, name in enumerate(names, 1):
            raw = np.frombuffer(name.encode(), np.uint8)
            hit = np.flatnonzero(length == len(raw))
            hit = hit[(self.buf[start[hit][:, None] + np.arange(len(raw))] == raw).all(1)]
            code[at[hit]] = i
        long = np.flatnonzero(length >= 6)
        runs = np.add.reduceat(np.r_[self.buf == 92, False].astype(np.int64), np.c_[start[long], start[long] + length[long]].ravel())[::2] if len(long) else long
        for j in long[np.flatnonzero(runs)]:  # names written with escapes
            text = json.loads(bytes(self.buf[start[j] - 1 : start[j] + length[j] + 1]))
            code[at[j]] = names.index(text) + 1 if text in names else 0
        hit = np.flatnonzero(code)
        if len(hit):
            group = self.container[hit] * (len(names) + 1) + code[hit]
            _, last = np.unique(group[::-1], return_index=True)
            drop = np.ones(len(hit), bool)
            drop[len(hit) - 1 - last] = False
            code[hit[drop]] = 0
        return code


def flatten_buffer(buf: np.ndarray, offs: np.ndarray) -> dict[str, pa.Array | np.ndarray]:
    """Nodes of the payloads in ``buf``: row, kind, path, parent path and the raw JSON of their scalar members."""
    x = StructuralIndex(buf, offs)
    code = x.named(HOLDERS)
    objects = np.flatnonzero(x.ok & (x.typ == _OPEN_O))
    up = x.container[objects]
    direct = code[objects] > 0
    through = ~direct & (up >= 0) & x.in_arr[objects]
    through[through] = code[up[through]] > 0
    holder = np.where(direct, up, np.where(through, x.container[up], -1))
    role = np.where(direct, code[objects], np.where(through, code[up], 0))
    nth = np.where(through, x.nth[objects] // 2, -1)
    kind = np.full(len(x.pos), -1, np.int64)
    kind[objects[x.level[objects] == 0]] = 0
    slot = np.full(len(x.pos), -1)  # place of a node in the output
    out: list[tuple[np.ndarray, np.ndarray, pa.Array, pa.Array]] = []
    n_out = 0
    paths: list[pa.Array] = []
    allowed = {(1, 0): 1, (2, 1): 2, (3, 1): 3, (4, 2): 4, (5, 4): 4}  # (member, holder's kind): kind
    names, slash = pa.array(HOLDERS, pa.large_string()), pa.scalar("/", pa.large_string())
    frontier = np.flatnonzero(kind == 0)
    # children of each holder, found by one sort; each level is a vectorised gather of the frontier's ranges
    usable = np.flatnonzero(role > 0)
    usable = usable[np.argsort(holder[usable], kind="stable")]
    held_sorted = holder[usable]
    while len(frontier):
        lo, hi = np.searchsorted(held_sorted, frontier, "left"), np.searchsorted(held_sorted, frontier, "right")
        count = hi - lo
        child = usable[np.arange(count.sum()) + np.repeat(lo - np.r_[0, np.cumsum(count)[:-1]], count)]
        parent = np.repeat(frontier, count)
        new = np.zeros(len(child), np.int64)
        for (member, of), becomes in allowed.items():
            new[(role[child] == member) & (kind[parent] == of)] = becomes
        child, parent, new = child[new > 0], parent[new > 0], new[new > 0]
        if not len(child):
            break
        token = objects[child]
        kind[token] = new
        member = names.take(pa.array(role[child] - 1))
        index = pa.array(nth[child]).cast(pa.large_string())
        own = pc.if_else(pa.array(nth[child] >= 0), pc.binary_join_element_wise(member, index, slash), member)
        if paths:
            known = pa.chunked_array(paths)
            parent_path = known.take(pa.array(slot[parent]))
            path = pc.binary_join_element_wise(parent_path, own, slash).combine_chunks()
            parent_path = parent_path.combine_chunks()
        else:
            path, parent_path = own, pa.array([""] * len(own), pa.large_string())
        slot[token] = n_out + np.arange(len(token))
        n_out += len(token)
        paths.append(path)
        out.append((token, new, path, parent_path))
        frontier = token
    if not out:
        return {}
    token = np.concatenate([o[0] for o in out])
    scalars = x.named(SCALARS)
    result: dict[str, pa.Array | np.ndarray] = {
        "row": x.row[token],
        "node_kind": pa.array(KINDS).take(pa.array(np.concatenate([o[1] for o in out]) - 1)),
        "node_path": pa.concat_arrays([o[2] for o in out]),
        "parent_path": pa.concat_arrays([o[3] for o in out]),
    }
    plain = np.flatnonzero((scalars > 0) & ~np.isin(x.typ, (_OPEN_A,)))
    plain = plain[slot[x.container[plain]] >= 0]
    for i, name in enumerate(SCALARS, 1):
        at = plain[scalars[plain] == i]
        start, stop, valid = np.zeros(len(token), np.int64), np.zeros(len(token), np.int64), np.zeros(len(token), bool)
        to = slot[x.container[at]]
        start[to], stop[to], valid[to] = x.pos[at], np.where(x.close[at] >= 0, x.close[at], x.end[at]), True
        result[f"{name}_json"] = _slices(buf, start, stop, valid)
    return result


_FIELDS = ["node_kind", "node_path", "parent_path", *(f"{s}_json" for s in SCALARS)]


def _flatten_batches(scalars: bool):
    fields = _FIELDS if scalars else _FIELDS[:3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, text = batch.column(0), batch.column(1).cast(pa.large_binary())
            offs_all = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1 + text.offset)[text.offset :] if len(text) else np.zeros(1, np.int64)
            data = text.buffers()[2]
            if data is None or not len(text):
                continue
            buf_all = np.frombuffer(data, np.uint8)
            at = 0
            while at < len(text):
                upto = max(at + 1, int(np.searchsorted(offs_all, offs_all[at] + CHUNK_BYTES, "right")) - 1)
                offs = offs_all[at : upto + 1]
                nodes = flatten_buffer(buf_all[offs[0] : offs[-1]], offs - offs[0]) if offs[-1] > offs[0] else {}
                if nodes:
                    columns = [keys.take(pa.array(nodes["row"] + at))] + [nodes[f].cast(pa.string()) for f in fields]
                    yield pa.RecordBatch.from_arrays(columns, names=["k", *fields])
                at = upto

    return run


def flatten_nodes(df: DataFrame, key: str = "set_key", payload: str = "payload", scalars: bool = True) -> DataFrame:
    """One row per node: key, node_kind, node_path, parent_path and, with ``scalars``, raw JSON of its scalar members.

    Copies of a record give their nodes once. A null key is kept as null.
    """
    source = df.select(F.col(key).alias("k"), F.col(payload).cast("string").alias("p")).where(F.col("p").isNotNull())
    kind = dict(source.dtypes)["k"]
    fields = _FIELDS if scalars else _FIELDS[:3]
    schema = f"k {kind}, " + ", ".join(f"{f} string" for f in fields)
    out = source.mapInArrow(_flatten_batches(scalars), schema)
    return out.distinct().withColumnRenamed("k", key)


def _decoded(name: str) -> Column:
    """The string in a raw JSON member, or its JSON text where it is no string; a JSON null is null."""
    raw = F.nullif(F.col(f"{name}_json"), F.lit("null"))
    return F.when(raw.startswith('"'), F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")[0]).otherwise(raw).alias(name)


def annotation_tables(df: DataFrame, key: str = "set_key", payload: str = "payload") -> dict[str, DataFrame]:
    """Four related flat tables (annotation, target, body, selector); each row names its parent by (key, parent_path).

    A body's value is its text, also where it is an object with a text and a language.
    """
    nodes = flatten_nodes(df, key, payload)
    body = F.col("value_json")
    text = F.when(body.startswith("{"), F.get_json_object(body, "$.text")).otherwise(_decoded("value"))
    language = F.when(body.startswith("{"), F.get_json_object(body, "$.language"))
    nodes = nodes.withColumns({"body_text": text, "body_language": language})
    columns = {"annotation": ("id", "type", "created", "motivation"), "target": ("id", "type", "source"), "body": ("id", "type"), "selector": ("type", "value")}
    extra = {"body": (F.col("body_text").alias("value"), F.col("body_language").alias("language"))}
    return {k: nodes.where(F.col("node_kind") == k).select(key, "node_path", "parent_path", *(_decoded(c) for c in columns[k]), *extra.get(k, ())) for k in KINDS}
