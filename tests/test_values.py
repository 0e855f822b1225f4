import pytest
from pyspark.sql import functions as F

from codexmill.functions import values as V
from codexmill.operators import inventory as I


def one(spark, expression, *args):
    df = spark.createDataFrame([tuple(args)], ", ".join(f"c{i} string" for i in range(len(args))))
    return df.select(expression(*(F.col(f"c{i}") for i in range(len(args)))).alias("x")).first().x


HREFS = [
    ("", "empty", None),
    ("#a%20b", "same-document", "EPUB/text/c.xhtml"),
    ("?q", "local", "EPUB/text/c.xhtml"),
    ("../img/a b.png", "local", "EPUB/img/a b.png"),
    ("./x//y/../z", "local", "EPUB/text/x/z"),
    ("../../../x", "local", None),
    ("/x", "invalid", None),
    ("a:b/c", "external", "a:b/c"),
    ("1a:b", "invalid", None),
    ("x%2fy", "invalid", None),
    ("x%zz", "invalid", None),
    ("x%ff", "invalid", None),
    (" x", "invalid", None),
    ("a\\b", "invalid", None),
    ("a+b", "local", "EPUB/text/a+b"),
    ("HTTP://h/x", "remote", "HTTP://h/x"),
    ("//h/x", "remote", "//h/x"),
    ("http://", "invalid", None),
    ("data:x", "data", "data:x"),
    ("mailto:x@y", "external", "mailto:x@y"),
    (None, None, None),
]


def test_hrefs(spark):
    df = spark.createDataFrame([(i, h, "EPUB/text/c.xhtml") for i, (h, _, _) in enumerate(HREFS)], "i int, h string, s string")
    got = {r.i: (r.k, r.address) for r in V.with_target(df, "h", "s").select("i", V.href_class(F.col("h")).alias("k"), F.col("t_address").alias("address")).collect()}
    assert got == {i: (k, a) for i, (_, k, a) in enumerate(HREFS)}
    whole = {r.i: r.r.address for r in df.select("i", V.resolve_href(F.col("h"), F.col("s")).alias("r")).collect()}
    assert whole == {i: a for i, (_, _, a) in enumerate(HREFS)}


@pytest.mark.parametrize(
    ("path", "error"),
    [("a/b.c", None), ("", "empty"), ("/a", "absolute"), ("a\\b", "backslash"), ("a?b", "query-or-fragment"), ("a\x01", "control-character"), ("a//b", "empty-segment"), ("a/", "empty-segment"), ("a/../b", "dot-segment"), (".", "dot-segment"), ("a:b/c", "scheme-like-first-segment"), ("a/b:c", None)],
)
def test_paths(spark, path, error):
    assert one(spark, V.path_error, path) == error


def test_scalars(spark):
    assert [one(spark, V.extension, p) for p in ("a/b.tar.gz", "a/.hidden", "a.b/c", "x.")] == ["gz", None, None, None]
    assert [one(spark, V.parent_dir, p) for p in ("a/b/c", "c")] == ["a/b", ""]
    assert [one(spark, V.manifest_id, p) for p in (" a-1\n", "1a", "", "a:b", "é.x", None)] == ["a-1", None, None, None, "é.x", None]
    assert [one(spark, V.essence, p) for p in ("TEXT/css; charset=x", "textcss", " image/svg+xml ", None)] == ["text/css", None, "image/svg+xml", None]
    assert [one(spark, lambda c: V.media_class(V.essence(c)), p) for p in ("image/jpg", "x/y+xml", "text/zz", "x/y")] == ["raster:jpeg", "text", "text", None]
    assert [one(spark, V.clock_ms, p) for p in ("1:02:03.4567", "02:03", "5", "1.5h", "2min", "7ms", "1:60:00", "x", None)] == [3_723_456, 123_000, 5_000, 5_400_000, 120_000, 7, None, None, None]
    assert [one(spark, V.numeric, p) for p in ("1.5", "NaN", "Infinity", "x")] == [1.5, None, None, None]
    assert one(spark, V.compact, "a  b\n" + "x" * 200) == ("a b " + "x" * 200)[:97] + "..."
    assert one(spark, V.utf16_length, "a\U0001f600") == 3
    assert [one(spark, V.non_empty, p) for p in ("  x \n", " ")] == ["x", None]
    assert one(spark, V.strict_resource_path, "a/b", "E/x") == "E/a/b"
    assert [one(spark, V.strict_resource_path, p, "E/x") for p in ("a//b", "a#f", "a/..", "http://x")] == [None] * 4


def test_inventory_with_entries(spark):
    pubs = spark.createDataFrame([("p", "E/p.opf")], "pub_id string, package_path string")
    decl = spark.createDataFrame(
        [(1, "p", 0, "a", "x.xhtml", "application/xhtml+xml", ["nav"], None, None, "2024"), (2, "p", 1, "b", "x.xhtml", None, None, "a", "zz", "2024"), (3, "p", 2, "a", "gone.png", "image/png", [], " b ", None, "2024"), (4, "p", 3, "1", None, "x", None, "a", "1x", "2024"), (4, "p", 3, "1", None, "x", None, "a", "1x", "2025")],
        "decl_key long, pub_id string, manifest_ord int, id string, href string, media_type string, item_properties array<string>, fallback string, media_overlay string, loaded_at string",
    )
    entries = spark.createDataFrame([("p", "mimetype", 1), ("p", "E/x.xhtml", 5), ("p", "E/p.opf", 7), ("p", "E/extra", 9)], "pub_id string, path string, size_bytes long")
    typed = I.typed_declarations(decl, pubs)
    rows = I.resources(pubs, typed, entries).orderBy("resource_ord").collect()
    assert [(r.address, r.presence, r.n_declarations) for r in rows] == [("E/p.opf", "present", 0), ("E/x.xhtml", "present", 2), ("E/gone.png", "missing", 1), ("E/extra", "present", 0)]
    refs = {(r.decl_key, r.role, r.target_state, r.target_decl, r.candidates) for r in I.manifest_references(typed).collect()}
    assert refs == {(2, "fallback", "ambiguous", None, 2), (2, "media-overlay", "missing", None, 0), (3, "fallback", "declaration", 2, 1), (4, "fallback", "ambiguous", None, 2), (4, "media-overlay", "invalid", None, 0)}
    assert {(r.role, r.state) for r in I.selections(typed).collect()} == {("nav", "selected"), ("cover", "absent")}
    nav = spark.createDataFrame([("p", 1, 0, [0], "toc", "x.xhtml#f", "2024"), ("p", 2, 0, [1], "toc", "gone.png", "2024"), ("p", 3, 0, [2], "toc", "no", "2024"), ("p", 4, 0, [3], "toc", "http://a/b", "2024")], "pub_id string, nav_key long, list_index int, point_path array<int>, semantic string, authored_href string, loaded_at string")
    n = I.navigation_references(nav, pubs, typed)
    broken = {(r.kind, r.source_key, r.reason) for r in I.broken_references(I.manifest_references(typed), n, I.resources(pubs, typed, entries)).collect()}
    assert broken == {("manifest", 2, "ambiguous"), ("manifest", 2, "missing"), ("manifest", 4, "ambiguous"), ("manifest", 4, "invalid"), ("href", 2, "missing-resource"), ("href", 3, "missing-local")}


def test_small_operators(spark):
    assert [one(spark, V.related_role, s) for s in ("chapter", "page-list", "Chapter", "zz")] == ["doc-chapter", "doc-pagelist", None, None]
    assert [one(spark, V.is_deprecated_semantic, s) for s in ("note", "chapter")] == [True, False]
    pairs = [one(spark, V.viewport_pair, s) for s in ("width=100, height = 2.5", "HEIGHT=1,width=2", "width=1", "width=1,height=0", "width=1,width=2", "width=1,height=2,x=3", "width=a,height=1")]
    assert [p and tuple(p) for p in pairs] == [(100.0, 2.5), (2.0, 1.0), None, None, None, None, None]
    t = spark.sql("select timestamp '2024-02-03 04:05:06.789' as t, X'c3a9' as good, X'ff' as bad, array(1,2,3) as a")
    r = t.select(V.modified_text(t.t).alias("m"), V.utf8_text(t.good).alias("g"), V.utf8_text(t.bad).alias("b"), V.sample(t.a, 2).alias("s")).first()
    assert (r.m, r.g, r.b, tuple(r.s)) == ("2024-02-03T04:05:06Z", "é", None, ([1, 2], 1))
    s = spark.createDataFrame([("a/x.CSS", 0), ("a/x.css", 1), ("a", 0)], "p string, n int")
    assert [x[0] for x in s.select(V.is_style_candidate(s.p, s.n)).collect()] == [True, False, None]
