from pyspark.sql import functions as F

from codexmill.operators import catalog, content, inventory


def test_extract(spark):
    rows = spark.createDataFrame([(1, "<p>One <b>two</b><p>three <a href='x'>go</a>", "e"), (2, "", "e"), (3, None, "e"), (4, "<script>x()</script>plain & text", "e")], "doc_id long, text string, stream string")
    facts = content.extract(rows, "doc_id", "text")
    got = {r.doc_id: (r.n_stream, r.n_links, r.executable) for r in content.stream_summary(facts, "doc_id").collect()}
    assert got == {1: (16, 1, False), 2: (0, 0, False), 4: (12, 0, True)}
    assert ("b", "two") in {(r.element, r.text) for r in content.span_texts(facts, "doc_id").collect()}
    assert content.executable_states(facts).first().asDict() == {"detected": 1, "absent": 2, "unknown": 0}
    assert content.extract(rows.limit(0), "doc_id", "text").count() == 0


def test_coverage_partitions_expected(spark):
    rows = spark.createDataFrame([("complete", None), ("partial", "malformed"), ("unavailable", "limit"), ("unavailable", "limit"), ("not_applicable", None)], "state string, issue string")
    r = catalog.coverage({"content": rows}).first()
    assert (r.expected, r.complete, r.partial, r.unavailable) == (4, 1, 1, 2)
    assert r.expected == r.complete + r.partial + r.unavailable
    assert {tuple(x) for x in catalog.issues({"content": rows}).collect()} == {("content", "partial", "malformed", 1), ("content", "unavailable", "limit", 2)}
    assert catalog.incomplete(rows).count() == 3
    assert [x[0] for x in rows.select(catalog.outcome(F.lit(1), F.col("state"))).collect()] == [1, 1, None, None, None]


def test_budgets(spark):
    rows = spark.createDataFrame([("p", 0, 5), ("p", 1, 5), ("p", 2, None), ("p", 3, 1), ("q", 0, 99)], "pub_id string, resource_ord long, size_bytes long")
    got = {(r.pub_id, r.resource_ord): r.state for r in catalog.running_budget(rows, 10, 3).collect()}
    assert got == {("p", 0): "complete", ("p", 1): "complete", ("p", 2): "complete", ("p", 3): "unavailable", ("q", 0): "unavailable"}


def test_fragments_are_three_valued(spark):
    refs = spark.createDataFrame([("p", "a", "x"), ("p", "a", "y"), ("p", "b", "x"), ("p", "a", None)], "pub_id string, target_address string, fragment string")
    fragments = spark.createDataFrame([("p", "a", "x"), ("p", "a", "x")], "pub_id string, path string, id string")
    contents = spark.createDataFrame([("p", "a", "complete"), ("p", "b", "partial")], "pub_id string, path string, content_state string")
    got = {(r.target_address, r.fragment): r.exists for r in catalog.fragment_existence(refs, fragments, contents).collect()}
    assert got == {("a", "x"): True, ("a", "y"): False, ("b", "x"): None, ("a", None): None}


def test_pairs_and_runs(spark):
    links = spark.createDataFrame([("s", 1), ("s", 2), ("t", 3)], "role string, ord long")
    refs = spark.createDataFrame([("s", 10), ("s", 11), ("s", 12)], "role string, ord long")
    assert {(r.link_ord, r.slot) for r in catalog.fifo_pairs(links, refs, "role").collect()} == {(1, 10), (2, 11), (3, None)}
    assert catalog.same_rows(links, links.repartition(3))
    assert not catalog.same_rows(links, links.union(links))


def test_move_impact_and_closure(spark):
    refs = spark.createDataFrame([("p", "a", "b", "b.x"), ("p", "b", "b", "#f"), ("p", "b", "c", "http://h/")], "pub_id string, source_address string, target_address string, declared string")
    typed = spark.createDataFrame([("p", "a", "local"), ("p", "b", "local")], "pub_id string, address string, address_kind string")
    assert {(r.address, r.incoming, r.outgoing) for r in catalog.move_impact(refs, typed).collect()} == {("a", 0, 1), ("b", 1, 1)}
    edges = [(i, i + 1) for i in range(1, 15)] + [(15, 1), (3, 20), (21, 21)]
    manifest = spark.createDataFrame([("p", a, "declaration", b) for a, b in edges], "pub_id string, decl_key long, target_state string, target_decl long")
    got = {(r.root, r.reached): r.distance for r in inventory.dependency_closure(manifest).collect()}
    cycle = {(a, b): (b - a) % 15 for a in range(1, 16) for b in range(1, 16) if a != b}
    assert got == cycle | {(a, 20): (3 - a) % 15 + 1 for a in range(1, 16)}
