"""Edits that touch files and package together, annotations inside books, and the sinks."""

import io
import json
import zipfile

import pytest

from codexmill.operators import accessibility, inventory, references, report
from codexmill.operators.edit import BookEdit, EditError, PackageEdit, edit_books
from codexmill.parsers import xmlparts
from codexmill.sources import books

SET = {"items": [{"id": "urn:a", "body": {"type": "Audio", "id": "av/a.mp3"}}]}


def archive(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path, data in entries.items():
            z.writestr(path, data)
    return held.getvalue()


def entries():
    return books.create("urn:x", "T", "en", "2024-01-01T00:00:00Z")


def package_of(edit):
    return xmlparts.parse_package(edit.changes()["EPUB/package.opf"])


def test_files_go_with_their_items():
    e = BookEdit(entries(), "EPUB/package.opf")
    e.add_spine_resource(b"<html/>", "c1", "text/c%201.xhtml", "application/xhtml+xml").add_resource(b"x", "i", "i.png", "image/png")
    assert e.changes()["EPUB/text/c 1.xhtml"] == b"<html/>"
    assert [r["idref"] for r in package_of(e)["itemrefs"]] == ["nav", "c1"]
    for refused in (lambda: e.remove_resource("c1"), lambda: e.remove_resource("nav"), lambda: e.add_resource(b"", "j", "i.png", "image/png"), lambda: e.add_resource(b"", "j", "../mimetype", "x/y"), lambda: e.remove_spine_resource("i")):
        before = dict(e.entries)
        with pytest.raises(EditError):
            refused()
        assert e.entries == before
    e.package.add_item("twin", "i.png", "image/png")
    with pytest.raises(EditError, match="shared"):
        e.remove_resource("i")
    e.package.remove_item("twin")
    e.remove_resource("i").remove_spine_resource("c1")
    assert e.changes()["EPUB/i.png"] is None
    assert [i["id"] for i in e.package.p["items"]] == ["nav"]
    assert e.unique_nav_href() == "nav-2.xhtml"


def test_package_parts():
    p = PackageEdit(xmlparts.parse_package(entries()["EPUB/package.opf"]))
    p.add_link("a.xml", "record").replace_link("b.xml", rel="record").replace_meta("2025", property="dcterms:modified").replace_itemref("nav", linear="no")
    again = xmlparts.parse_package(p.to_bytes())
    assert [x["href"] for x in again["links"]] == ["b.xml"]
    assert again["metas"][0]["content"] == "2025"
    assert again["itemrefs"][0]["linear"] == "no"
    assert p.remove_link(href="b.xml").p["links"] == []
    with pytest.raises(EditError):
        p.replace_itemref("nav", idref="nobody")


def test_migration_writes_navigation():
    ncx = b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>One</text></navLabel><content src="../text/a.xhtml#x"/></navPoint></navMap></ncx>'
    p = xmlparts.parse_package(entries()["EPUB/package.opf"]) | {"version": "2.0", "toc": "ncx"}
    p["items"] = [{"id": "ncx", "href": "toc/toc.ncx", "media_type": "application/x-dtbncx+xml", "properties": [], "fallback": None, "media_overlay": None}]
    p["itemrefs"], p["guide"] = [], [{"type": "text", "title": "Start", "href": "text/a.xhtml"}]
    e = BookEdit({"EPUB/package.opf": xmlparts.package_to_xml(p).encode(), "EPUB/toc/toc.ncx": ncx}, "EPUB/package.opf").migrate("2024-01-01T00:00:00Z")
    lists = {n["semantic"]: [q["authored_href"] for q in n["points"]] for n in xmlparts.parse_nav(e.changes()["EPUB/nav.xhtml"])}
    assert lists == {"toc": ["text/a.xhtml#x"], "landmarks": ["text/a.xhtml"]}
    assert package_of(e)["version"] == "3.0"
    bare = xmlparts.parse_package(entries()["EPUB/package.opf"]) | {"version": "2.0"}
    with pytest.raises(EditError, match="table of contents"):
        BookEdit({"EPUB/package.opf": xmlparts.package_to_xml(bare).encode()}, "EPUB/package.opf").migrate("2024")


def test_annotations_inside_a_book():
    e = BookEdit(entries(), "EPUB/package.opf")
    assert e.embedded_annotations() is None
    with pytest.raises(EditError):
        e.remove_embedded_annotations()
    e.set_embedded_annotations(SET, {"av/a.mp3": b"1"})
    assert e.embedded_annotations() == (SET, {"av/a.mp3": b"1"})
    e.set_embedded_annotations({"items": []}, {})
    assert e.changes()["META-INF/av/a.mp3"] is None
    assert json.loads(e.changes()["META-INF/annotations.json"]) == {"items": []}
    e.remove_embedded_annotations()
    assert e.embedded_annotations() is None
    with pytest.raises(EditError, match="protected"):
        e.set_embedded_annotations({"items": [{"id": "urn:a", "body": {"type": "Audio", "id": "rights.xml"}}]}, {"rights.xml": b""})


def test_edited_books_and_their_archives(spark, tmp_path):
    e = books.explode_entries(spark.createDataFrame([("a", archive(entries())), ("b", archive({"x": b""}))], "pub_id string, content binary"))
    out = edit_books(e, lambda b: b.add_resource(b"x", "i", "i.png", "image/png"))
    rows = {(r.pub_id, r.path): r.refusal for r in out.collect()}
    assert rows["a", "EPUB/i.png"] is None
    assert rows["b", "x"] is not None
    books.write_archives(books.export(out.where("pub_id = 'a'")), str(tmp_path / "out"))
    with zipfile.ZipFile(tmp_path / "out" / "a.epub") as z:
        assert z.read("EPUB/i.png") == b"x"
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.epub"]


def test_selections_observations_and_report(spark, tmp_path):
    typed = spark.createDataFrame([("p", 1, "ncx", ["x"]), ("p", 2, "pic", None), ("q", 3, "a", ["nav"]), ("q", 4, "b", ["nav", "cover-image"])], "pub_id string, decl_key long, manifest_id string, item_properties array<string>").selectExpr("*", "'x' as address")
    spine = spark.createDataFrame([("p", "ncx"), ("q", "gone"), ("r", None)], "pub_id string, toc string")
    legacy = spark.createDataFrame([("p", 0, "Cover", "pic"), ("q", 0, "cover", "a")], "pub_id string, ord int, name string, content string")
    got = {(r.pub_id, r.role): (r.state, r.source, r.decl_key) for r in inventory.resource_selections(typed, spine, legacy).collect()}
    assert got == {("p", "nav"): ("absent", "nav-property", None), ("p", "cover"): ("selected", "legacy-cover", 2), ("p", "ncx"): ("selected", "spine-toc", 1), ("q", "nav"): ("ambiguous", "nav-property", None), ("q", "cover"): ("selected", "cover-image-property", 4), ("q", "ncx"): ("unresolved", "spine-toc", None), ("r", "nav"): ("absent", None, None), ("r", "cover"): ("absent", None, None), ("r", "ncx"): ("absent", None, None)}
    tables = books.book_tables(books.analyse(spark.createDataFrame([("a", archive(entries() | {"EPUB/c.vtt": b"WEBVTT\n\n00:01.000 --> 00:02.000\nx\n"}))], "pub_id string, content binary")))
    seen = {(accessibility.BRANCHES[r.branch], r.kind) for r in accessibility.observations(tables).collect()}
    assert {("navigation", "toc"), ("structure", "navigation-list")} <= seen
    metas = spark.createDataFrame([("a", 0, "dcterms:conformsTo", None, "EPUB Accessibility 1.1 - WCAG 2.2 Level AA"), ("a", 1, "dcterms:conformsTo", None, "other"), ("a", 2, "media:narrator", None, " Ann "), ("a", 3, "media:active-class", None, " ")], "pub_id string, ord int, property string, refines string, content string")
    assert {(r.ord, r.level) for r in accessibility.claims(metas).collect()} == {(0, "AA"), (1, None)}
    assert [(r.kind, r.value) for r in inventory.overlay_metadata(metas).collect()] == [("narrator", "Ann")]
    summary = spark.createDataFrame([("a", "ok", 5, 1, 1, 1, 1, 0), ("b", "failed", None, 0, 0, 0, 0, 0)], "pub_id string, status string, archive_size_bytes long, resources long, declarations long, occurrences long, references long, broken_references long")
    report.write_report(summary, "mine", str(tmp_path / "report"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "report")).collect()]
    assert sorted("totals" in x for x in lines) == [False, False, True]
    assert next(x for x in lines if "totals" in x)["totals"]["failed"] == 1
    assert references.PRODUCERS[0] == "manifest"
