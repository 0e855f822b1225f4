import pytest

from codexmill.functions import values as V
from codexmill.operators.edit import EditError, NavigationEdit, landmark_points, rebase_href
from codexmill.parsers import annotations as A
from codexmill.parsers import cfi, css

SET = {"items": [{"id": "urn:a", "x": 1, "body": {"type": "Audio", "id": "av/a.mp3"}}, {"id": "urn:b"}, {"id": "urn:c"}, {"id": "urn:c"}]}


def test_sets_and_bundles():
    assert [a["id"] for a in A.add(SET, {"id": "urn:d"})["items"]][-1] == "urn:d"
    assert A.replace(SET, {"id": "urn:b", "y": 2})["items"][1] == {"id": "urn:b", "y": 2}
    assert len(A.remove(SET, "urn:a")["items"]) == 3
    for refused in (lambda: A.add(SET, {"id": "urn:a"}), lambda: A.add(SET, {"id": "a"}), lambda: A.remove(SET, "urn:c"), lambda: A.remove(SET, "urn:z"), lambda: A.parse_set("[]"), lambda: A.parse_set("{")):
        with pytest.raises(A.AnnotationError):
            refused()
    data = A.write_archive(SET, {"av/a.mp3": b"1"})
    assert A.read_archive(data) == (SET, {"av/a.mp3": b"1"})
    assert A.change(SET, {"av/a.mp3": b"1"}, A.remove(SET, "urn:a"), {})[1] == {}
    for resources in ({}, {"av/a.mp3": b"", "b": b""}, {"av/a.mp3": b"", A.JSON_NAME: b""}, {"../a": b""}):
        with pytest.raises(A.AnnotationError):
            A.validate_bundle(SET, resources)
    with pytest.raises(A.AnnotationError):
        A.read_archive(b"no")
    assert [A.resource_path(p) for p in ("a/./b", "a/../b", "../b", "/a", "a\\b", "a//b", "a%2fb", "http://x", "", None)] == ["a/b", "b", None, None, None, None, None, None, None, None]


@pytest.mark.parametrize(
    ("selector", "source", "need"),
    [
        ({"type": "FragmentSelector", "value": "a"}, "xhtml", "dom"),
        ({"type": "FragmentSelector", "value": "a", "conformsTo": "other"}, "xhtml", "unsupported"),
        ({"type": "FragmentSelector", "value": "a%zz"}, "xhtml", "invalid"),
        ({"type": "FragmentSelector", "value": "a"}, "raster", "unsupported"),
        ({"type": "FragmentSelector", "value": "a", "conformsTo": A.TEXT_FRAGMENT}, "xhtml", "rendered-text"),
        ({"type": "CssSelector", "value": " "}, "svg", "invalid"),
        ({"type": "TextPositionSelector", "start": 3, "end": 2}, "xhtml", "invalid"),
        ({"type": "X"}, "xhtml", "unsupported"),
        ({}, "xhtml", "invalid"),
        ({"type": "CssSelector", "value": "p", "refinedBy": [{"type": "X"}, {"type": "TextPositionSelector", "start": 1, "end": 2}]}, "xhtml", "rendered-text"),
        ({"type": "CssSelector", "value": "p", "refinedBy": [{"type": "CssSelector", "value": "b"}, {"type": "TextPositionSelector", "start": 1, "end": 2}]}, "xhtml", "dom"),
        ({"type": "CssSelector", "value": "p", "refinedBy": {"type": "X"}}, "xhtml", "unsupported"),
    ],
)
def test_requirements(selector, source, need):
    assert A.requirement(selector, source) == need


def test_prefixed_properties():
    sheet = "@media print { h2 { -epub-word-break: keep-all; margin: 0 } } td{-epub-text-combine-horizontal:all !important}/* -epub-line-break: x */ li{-epub-hyphens:all; text-transform: uppercase -epub-fullwidth}"
    out = css.rewrite_stylesheet(sheet)
    assert "-epub-word-break: keep-all;word-break: keep-all; margin" in out
    assert "-epub-text-combine-horizontal:all !important;text-combine-upright: all !important}" in out
    assert "text-transform: uppercase -epub-fullwidth;text-transform: uppercase full-width}" in out
    assert ";hyphens" not in out
    assert css.rewrite_stylesheet(out) == out
    assert css.rewrite_declarations("color: red") == "color: red"


def points(*paths):
    return [{"point_path": list(p), "label": "".join(map(str, p)), "authored_href": None, "semantic": None, "hidden": False} for p in paths]


def shape(edit):
    return [(tuple(p["point_path"]), p["label"]) for p in edit.points]


def test_navigation_edits():
    rows = points((0,), (0, 0), (0, 1), (0, 1, 0), (1,))
    e = NavigationEdit(rows).move([0, 1], [1], 0)
    assert shape(e) == [((0,), "0"), ((0, 0), "00"), ((1,), "1"), ((1, 0), "01"), ((1, 0, 0), "010")]
    e = NavigationEdit(rows).move([0], [1], 0)
    assert shape(e) == [((0,), "1"), ((0, 0), "0"), ((0, 0, 0), "00"), ((0, 0, 1), "01"), ((0, 0, 1, 0), "010")]
    e = NavigationEdit(rows).add([0], 0, "new", "x").set_label("L", label="1").set_href("h", label="L").remove(point_path=[0, 1])
    assert shape(e) == [((0,), "0"), ((0, 0), "new"), ((0, 1), "01"), ((0, 1, 0), "010"), ((1,), "L")]
    e = NavigationEdit(rows)
    for refused in (lambda: e.move([0], [0, 1], 0), lambda: e.move([0, 0], [1], 5), lambda: e.remove(label="zz"), lambda: e.add([9], 0, "", None), lambda: e.add([], 7, "", None)):
        with pytest.raises(EditError):
            refused()
        assert shape(e) == shape(NavigationEdit(rows))
    assert [p["semantic"] for p in landmark_points([{"type": "Text", "title": "T", "href": "a"}, {"type": "notes", "title": "", "href": "b"}, {"type": "cover", "title": None, "href": None}])] == ["bodymatter"]


def test_rebase():
    assert rebase_href("../img/a.png?x#y", "E/text/c.xhtml", "E/nav.xhtml") == "img/a.png?x#y"
    assert rebase_href("d.xhtml#z", "E/text/c.xhtml", "nav.xhtml") == "E/text/d.xhtml#z"
    assert rebase_href("http://x/", "a/b", "c") == "http://x/"
    with pytest.raises(EditError):
        rebase_href("#z", "E/c", "F/d")


def test_text_assertions_and_ranges():
    doc = "<html><head/><body><p>one  two <i>three</i> four</p></body></html>"
    x = cfi.parse_cfi("epubcfi(/6/2!/4/2/3:1[three,four])")
    steps = x.parent.steps[2:]
    cfi.check_text(doc, steps, 1, x.parent.text)
    with pytest.raises(cfi.LocatorError):
        cfi.check_text(doc, steps, 1, ("two", None))
    assert cfi.resolve_range(doc, cfi.parse_cfi("epubcfi(/6/2!/4/2,/1:0,/1:3)")) == (0, 3)
    with pytest.raises(cfi.LocatorError):
        cfi.resolve_range(doc, cfi.parse_cfi("epubcfi(/6/2!/4/2,/1:3,/1:1)"))


def test_accessibility_terms(spark):
    df = spark.createDataFrame([("schema:accessMode", None), ("s:accessMode", "s: http://schema.org/ x: y"), ("s:accessMode", "t: http://schema.org/"), ("page-source", None), ("a11y:nothing", None), ("Schema:accessMode", None)], "p string, x string")
    assert [r[0] for r in df.select(V.accessibility_term(df.p, df.x)).collect()] == ["schema:accessMode", "schema:accessMode", None, ":page-source", None, None]
    claims = spark.createDataFrame([("EPUB Accessibility 1.1 - WCAG 2.2 Level AA",), ("EPUB Accessibility 1.3 - WCAG 2.2 Level AA",)], "c string")
    assert [r[0] and tuple(r[0]) for r in claims.select(V.conformance(claims.c)).collect()] == [("1.1", "2.2", "AA"), None]
