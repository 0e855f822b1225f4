import random

from codexmill.operators.hierarchy import descendants, navigation_edges, resolve_hierarchy


def brute(parent):
    out = {}
    for n in parent:
        walk, at = [n], n
        while at in parent and parent[at] not in walk:
            at = parent[at]
            walk.append(at)
        if at not in parent:
            out[n] = ("none", at, len(walk) - 1, walk[::-1])
        else:
            first = parent[at]
            if first == n:
                out[n] = ("on", min(walk), 0, [n])
            else:
                k = walk.index(first)
                out[n] = ("leads", first, k, walk[: k + 1][::-1])
    return out


def resolved(spark, rows):
    df = resolve_hierarchy(spark.createDataFrame(rows, "tree string, node long, parent long"))
    return {(r.tree, r.node_key): (r.cycle_state, r.root_key, r.depth, list(r.path)) for r in df.collect()}, df


def test_chain_cycles_and_leads(spark):
    rng = random.Random(4)
    parent = {i: i + 1 for i in range(100, 140)}  # a long chain
    parent |= {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 6}  # a cycle with leads, a node of its own
    parent |= {i: rng.randrange(200, 260) for i in range(200, 260)}
    parent |= {i: 140 for i in range(300, 500)}  # one hot parent
    rows = [("t", n, p) for n, p in parent.items()]
    got, df = resolved(spark, rows + rows[:10] + [("t", None, 1), ("t", 9, None), ("u", 1, 2)])
    want = {("t", n): v for n, v in brute(parent).items()} | {("u", 1): ("none", 2, 1, [2, 1])}
    assert got == want
    below = {(r.tree, r.ancestor, r.node_key): r.distance for r in descendants(df).collect()}
    assert below == {(t, a, n): len(path) - 1 - i for (t, n), (state, _, _, path) in want.items() if state != "on" for i, a in enumerate(path[:-1])}


def test_several_parents_and_empty(spark):
    assert resolved(spark, [("t", 1, 2), ("t", 1, 3)])[0] == {}
    assert resolved(spark, [])[0] == {}
    assert list(resolved(spark, [("t", 1, 2), ("t", 2, 1)])[0].values()) == [("on", 1, 0, [1]), ("on", 1, 0, [2])]


def test_navigation_edges(spark):
    rows = [("p", 0, [0], 1), ("p", 0, [0, 1], 2), ("p", 0, [0, 1, 5], 3), ("p", 0, [4, 4], 4), ("p", 1, [0, 0], 5), ("p", 0, None, 6), ("p", 0, [0, 1], 2), ("p", 0, [], 7)]
    df = spark.createDataFrame(rows, "pub_id string, list_index int, point_path array<int>, nav_key long")
    assert {(r.node, r.parent) for r in navigation_edges(df).collect()} == {(2, 1), (3, 2)}
