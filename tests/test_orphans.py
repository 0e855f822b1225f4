from datetime import datetime

from codexmill.operators.orphans import orphan_report, publication_orphans

DECL = "decl_key long, pub_id string, id string, fallback string, media_overlay string, loaded_at timestamp, removed_at timestamp, space string"
ITEM = "itemref_key long, pub_id string, idref string, loaded_at timestamp"
META = "meta_key long, pub_id string, id string, refines string, loaded_at timestamp"
ELEM = "elem_key long, pub_id string, id string, loaded_at timestamp, removed_at timestamp"
T1, T2, T3 = (datetime(2024, m, 1) for m in (1, 2, 3))


def run(spark, decl=(), items=(), metas=(), elems=()):
    frames = [spark.createDataFrame(list(rows), schema) for rows, schema in ((decl, DECL), (items, ITEM), (metas, META), (elems, ELEM))]
    return publication_orphans(*frames)


def test_reasons_copies_and_trimming(spark):
    decl = [
        (1, "p", " a\n", None, "", T1, None, "x"),
        (2, "p", "gone", "a", "nowhere", T1, T2, "x"),
        (3, "p", "later", "gone", " ", T3, None, "x"),
        (4, "p", None, "later ", None, T1, None, "x"),
        (4, "p", None, "later ", None, T3, None, "x"),  # a copy that came later
        (5, "p", "A", "later", None, T3, None, "x"),
        (6, None, "n", "a", None, T1, None, "x"),
        (7, "q", "z", "a", None, T1, None, "x"),
    ]
    got = {(r.ref_table, r.ref_field, r.row_key, r.reason, r.period) for r in run(spark, decl).collect()}
    assert got == {
        ("declarations", "media_overlay", 2, "missing", "2024-01"),
        ("declarations", "fallback", 3, "deleted", "2024-03"),
        ("declarations", "fallback", 4, "late", "2024-01"),
        ("declarations", "fallback", 6, "missing", "2024-01"),
        ("declarations", "fallback", 7, "missing", "2024-01"),
    }


def test_refines_spaces(spark):
    metas = [(1, "p", "m", "##e", T1), (2, "p", None, "#", T1), (3, "p", None, "", T1), (4, "p", None, "#m", T2), (5, "p", None, " d", T2), (6, "p", None, "d", T2)]
    got = {(r.row_key, r.reason) for r in run(spark, [(1, "p", "d ", None, None, T1, None, "x")], [], metas, [(1, "p", "e", T1, T2)]).collect()}
    assert got == {(1, "deleted"), (2, "missing"), (5, "missing")}


def test_empty_tables_and_report(spark):
    assert run(spark).count() == 0
    report = orphan_report(run(spark, items=[(1, "p", "x", T1), (2, "p", "x", T1), (1, "p", "x", T2)])).collect()
    assert [(r.ref_field, r.reason, r.period, r.n_orphans) for r in report] == [("idref", "missing", "2024-01", 2)]
