"""Books made here run through the analysis; their references are compared with what was authored."""

import io
import random
import zipfile

import pytest

from codexmill.operators import inventory, references
from codexmill.operators.edit import PackageEdit
from codexmill.parsers import xmlparts
from codexmill.session import Scratch
from codexmill.sources import books

XH = b'<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops">'
ONE = XH + b'<head><title>x</title><meta name="viewport" content="width=600 height=800"/><link rel="stylesheet" href="../s.css"/></head><body><h1 id="a">One</h1><a href="two.xhtml#b">go</a><a href="two.xhtml#gone">lost</a><a href="#a">up</a><img src="i.png"/><form action="http://h.example/"><input type="submit"/></form><script src="a.js"></script><a href="nowhere.xhtml">?</a></body></html>'
TWO = XH + b'<head><title>y</title><base href="../img/"/></head><body><p id="b">Two</p><img src="i.png"/><a href="//h.example/x#f">far</a></body></html>'
NAV = XH + b'<head><title>n</title></head><body><nav epub:type="toc"><ol><li><a href="text/one.xhtml">1</a></li><li><a href="text/two.xhtml#b">2</a></li></ol></nav><nav><ol><li><a href="text/two.xhtml">x</a></li></ol></nav></body></html>'
NCX = b'<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>1</text></navLabel><content src="text/one.xhtml#a"/></navPoint></navMap></ncx>'
SMIL = b'<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body><par><text src="text/one.xhtml#a"/><audio src="a.mp3" clipBegin="0s" clipEnd="1s"/></par></body></smil>'
SVG = b'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" xml:base="img/"><image xlink:href="i.png"/><use href="#s"/></svg>'


def archive(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path, data in entries.items():
            z.writestr(path, data)
    return held.getvalue()


def book():
    e = books.create("urn:x", "T", "en", "2024-01-01T00:00:00Z")
    p = PackageEdit(xmlparts.parse_package(e["EPUB/package.opf"]))
    for id_, href, kind in (("one", "text/one.xhtml", "application/xhtml+xml"), ("two", "text/two.xhtml", "application/xhtml+xml"), ("css", "s.css", "text/css"), ("ncx", "toc.ncx", "application/x-dtbncx+xml"), ("so", "o.smil", "application/smil+xml"), ("svg", "p.svg", "image/svg+xml"), ("lost", "lost.png", "image/png")):
        p.add_item(id_, href, kind)
    p.replace_item("one", media_overlay="so", fallback="nobody").add_itemref("one")
    p.p["links"].append({"ord": 0, "id": None, "href": "rec.xml", "rel": "a11y:certifierReport", "refines": None, "media_type": None, "properties": []})
    p.p["guide"].append({"ord": 0, "type": "text", "title": "t", "href": "text/one.xhtml"})
    return e | {"EPUB/package.opf": p.to_bytes(), "EPUB/nav.xhtml": NAV, "EPUB/text/one.xhtml": ONE, "EPUB/text/two.xhtml": TWO, "EPUB/s.css": b'@import "x.css"; p { background: url(lost.png) }', "EPUB/toc.ncx": NCX, "EPUB/o.smil": SMIL, "EPUB/p.svg": SVG, "EPUB/img/i.png": b"x", "EPUB/text/a.js": b""}


@pytest.fixture(scope="module")
def analysed(spark):
    tables = books.book_tables(books.analyse(spark.createDataFrame([("good", archive(book()))], "pub_id string, content binary")))
    typed = inventory.typed_declarations(references.book_declarations(tables), tables["publications"])
    found = Scratch(spark, "test").cut(references.all_references(tables, typed))
    return tables, found


def test_targets_of_all_producers(analysed):
    rows = {(references.PRODUCERS[r.producer], r.source_address, r.role, r.declared): r for r in analysed[1].collect()}
    target = lambda *k: (rows[k].target_kind, rows[k].target_address, rows[k].fragment, rows[k].fragment_exists)
    one, two, nav = "EPUB/text/one.xhtml", "EPUB/text/two.xhtml", "EPUB/nav.xhtml"
    assert target("manifest", one, "media-overlay", "so")[:2] == ("id-declaration", "EPUB/o.smil")
    assert target("manifest", one, "fallback", "nobody")[0] == "id-missing"
    assert target("package", "EPUB/package.opf", "guide", "text/one.xhtml")[0] == "resource"
    assert target("package", "EPUB/package.opf", "metadata", "rec.xml")[0] == "missing-local"
    assert target("navigation", nav, "toc", "text/two.xhtml#b") == ("fragment", two, "b", True)
    assert target("ncx", "EPUB/toc.ncx", "ncx", "text/one.xhtml#a") == ("fragment", one, "a", True)
    assert target("xhtml", one, "hyperlink", "two.xhtml#gone") == ("fragment", two, "gone", False)
    assert target("xhtml", one, "hyperlink", "#a") == ("fragment", one, "a", True)
    assert target("xhtml", one, "image", "i.png")[:2] == ("missing-local", "EPUB/text/i.png")
    assert target("xhtml", two, "image", "i.png")[:2] == ("resource", "EPUB/img/i.png")  # below its base
    assert target("xhtml", two, "hyperlink", "//h.example/x#f")[0] == "remote"
    assert target("css", "EPUB/s.css", "css", "lost.png")[0] == "resource"  # declared, though its bytes are missing
    assert target("svg", "EPUB/p.svg", "image", "i.png")[:2] == ("resource", "EPUB/img/i.png")
    assert target("smil", "EPUB/o.smil", "smil-audio", "a.mp3")[0] == "missing-local"


def test_slots(analysed):
    rows = analysed[1].collect()
    own = sorted((r.slot, r.producer) for r in rows if not r.shared)
    assert [s for s, _ in own] == list(range(len(own)))
    assert [p for _, p in own] == sorted(p for _, p in own)
    shared = [r for r in rows if r.shared]
    points = {r.declared: r.slot for r in rows if r.producer == 2}
    assert {(r.declared, r.slot) for r in shared} == set(points.items())  # links of the navigation document are its points


def test_broken(analysed):
    got = {(r.role, r.declared, r.reason) for r in references.broken(analysed[1]).collect()}
    assert got == {("fallback", "nobody", "id-missing"), ("metadata", "rec.xml", "missing-local"), ("hyperlink", "two.xhtml#gone", "missing-fragment"), ("image", "i.png", "missing-local"), ("hyperlink", "nowhere.xhtml", "missing-local"), ("import", "x.css", "missing-local"), ("css", "lost.png", "missing-resource"), ("smil-audio", "a.mp3", "missing-local"), ("svg", "#s", "missing-local")}  # below its base


def test_closure_follows_documents(analysed):
    tables, found = analysed
    got = {(r.reached, r.distance, r.unresolved) for r in references.closure(found, "declaration").where("start = 'EPUB/text/one.xhtml'").collect()}
    assert got == {("EPUB/s.css", 1, False), ("EPUB/text/i.png", 1, True), ("EPUB/text/a.js", 1, False), ("EPUB/o.smil", 1, False), ("EPUB/a.mp3", 2, True), ("EPUB/x.css", 2, True), ("EPUB/lost.png", 2, False)}
    alone = {r.reached for r in references.closure(found, "resource").where("start = 'EPUB/text/one.xhtml'").collect()}
    assert alone == {"EPUB/s.css", "EPUB/text/i.png", "EPUB/text/a.js", "EPUB/x.css", "EPUB/lost.png"}
    assert references.incomplete_sources(references.closure(found, "declaration"), tables["resources"]).count() == 0


def test_facts_and_their_slots(analysed):
    tables, found = analysed
    slot = {(r.source_address, r.role, r.declared): r.slot for r in found.collect()}
    media = {(r.path, r.kind): r.slots for r in references.occurrences(tables["media"], found).collect()}
    assert media["EPUB/text/one.xhtml", "image"] == [slot["EPUB/text/one.xhtml", "image", "i.png"]]
    forms = {r.element: r.slots for r in references.occurrences(tables["forms"], found).collect()}
    assert (len(forms["form"]), forms["input"]) == (1, [])
    scripts = {r.kind: r.slots for r in references.occurrences(tables["scripts"], found).collect()}
    assert scripts == {"external": [slot["EPUB/text/one.xhtml", "script", "a.js"]]}
    node = [r for r in references.overlay_nodes(tables["smil"], found).collect() if r.kind == "par"]
    assert [(r.text_slot, r.audio_slot) for r in node] == [(slot["EPUB/o.smil", "smil-text", "text/one.xhtml#a"], slot["EPUB/o.smil", "smil-audio", "a.mp3"])]
    report = references.certifier_reports(tables["metadata_links"], found).collect()
    assert [(r.href, r.slot) for r in report] == [("rec.xml", slot["EPUB/package.opf", "metadata", "rec.xml"])]
    universe = {(r.path, r.content_state) for r in references.fragment_universe(found, tables["resources"]).collect()}
    assert universe == {("EPUB/text/one.xhtml", "complete"), ("EPUB/text/two.xhtml", "complete")}
    assert {r.state for r in references.producer_coverage(tables).collect()} == {"complete"}


def test_impact_and_summary(analysed):
    tables, found = analysed
    typed = inventory.typed_declarations(references.book_declarations(tables), tables["publications"])
    into = {r.address: (r.n_incoming, r.n_from_others) for r in references.incoming(found).collect()}
    assert into["EPUB/text/one.xhtml"] == (5, 4)  # guide, navigation, NCX, overlay; one from itself
    hit = {r.address: r for r in references.removal_impact(found, typed, tables["itemrefs"], tables["publications"]).collect()}
    one = hit["EPUB/text/one.xhtml"]
    assert (one.declarations, one.occurrences, one.navigation, one.content, one.refused) == (1, 1, 2, 3, False)
    assert (hit["EPUB/o.smil"].overlays, hit["EPUB/img/i.png"].content, hit["EPUB/img/i.png"].declarations) == (1, 2, 0)
    total = references.book_summary(tables, typed, found).first()
    own = found.where("not shared").count()
    assert (total.references, total.broken_references, total.occurrences, total.scripts, total.executable) == (own, references.broken(found).count(), 2, 1, 1)


def test_tables_carry_all_facts(analysed):
    tables, _ = analysed
    assert {(r.name, r.value) for r in tables["viewports"].collect()} == {("width", "600"), ("height", "800")}
    assert {r.path: r.base for r in tables["resources"].collect()}["EPUB/text/two.xhtml"] == "../img/"
    assert [(r.nav_outcome, r.ncx_outcome) for r in tables["publications"].collect()] == [("loaded", "not-attempted")]
    assert {(r.document, r.source, r.selected) for r in tables["nav_lists"].collect()} == {("EPUB/nav.xhtml", "nav", True), ("EPUB/toc.ncx", "ncx", False)}
    assert [r.rel for r in tables["metadata_links"].collect()] == ["a11y:certifierReport"]


def test_fragment_selectors(spark, analysed):
    tables, _ = analysed
    s = spark.createDataFrame([("good", "EPUB/text/one.xhtml", "a"), ("good", "EPUB/text/one.xhtml", "#zz"), ("good", "EPUB/none", "a"), ("good", None, None)], "pub_id string, path string, value string")
    got = {(r.path, r.value): (r.state, r.n_elements) for r in references.fragment_selectors(s, tables["fragments"], tables["resources"]).collect()}
    assert got == {("EPUB/text/one.xhtml", "a"): ("one", 1), ("EPUB/text/one.xhtml", "#zz"): ("broken", 0), ("EPUB/none", "a"): ("unavailable", 0), (None, None): ("unavailable", 0)}


def test_empty_tables_and_books_without_content(spark):
    """No books, an unreadable one, and one without links: every view is there and empty, or has what there is."""
    bare = {"mimetype": b"", "META-INF/container.xml": xmlparts.rootfiles_to_xml([{"full_path": "p.opf", "media_type": None}]).encode(), "p.opf": b'<package xmlns="http://www.idpf.org/2007/opf" version="3.0"><metadata/><manifest/><spine/></package>'}
    for rows in ([], [("bad", b"no archive"), ("bare", archive(bare))]):
        tables = books.book_tables(books.analyse(spark.createDataFrame(rows, "pub_id string, content binary")))
        typed = inventory.typed_declarations(references.book_declarations(tables), tables["publications"])
        found = references.all_references(tables, typed)
        assert found.count() == 0
        assert references.broken(found).count() == references.closure(found, "declaration").count() == references.overlay_nodes(tables["smil"], found).count() == 0
        assert references.occurrences(tables["media"], found).count() == references.producer_coverage(tables).count() == 0
        assert inventory.numbered(found.select("pub_id", "role"), "pub_id", ["role"], "n", Scratch(spark, "none")).count() == 0
        assert tables["publications"].count() == len(rows)


def test_nulls_in_any_column(analysed, spark):
    """References with nulls reach nothing, break nothing and have no slots of facts."""
    _, found = analysed
    nothing = spark.createDataFrame([tuple(None if f.name != "shared" else False for f in found.schema)], found.schema)
    assert references.broken(nothing).count() == 0
    assert references.closure(nothing, "resource").count() == 0
    assert references.fragment_universe(nothing, spark.createDataFrame([], "pub_id string, path string, content_state string, content_issue string")).count() == 0


def test_limits_are_told():
    data = archive(book())
    assert books.analyse_book("b", data, books.Limits(entries=3))["failure"].endswith("limit")
    small = books.analyse_book("b", data, books.Limits(package_bytes=10))
    assert (small["failure_stage"], small["failure"]) == ("package", "FormatError: limit")
    assert books.analyse_book("b", data, books.Limits(navigation_bytes=10))["nav_outcome"] == "limit"
    cut = books.analyse_book("b", data, books.Limits(resource_bytes=60))
    assert {r["content_issue"] for r in cut["resources"] if r["size_bytes"] > 60} == {"limit"}
    late = b"<!-- " + b"x" * 100_000 + b" -->" + XH + b"<body><p>Hi</p></body></html>"
    assert books.analyse_resource("a.xml", late, "application/xml")["format"] == "xhtml"
    twice = archive({"A.txt": b"", "a.txt": b""})
    assert books.analyse_book("b", twice)["failure"] == "FormatError: alias-collision"


def test_numbered_splits_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{i % 50}", rng.randrange(10_000), i) for i in range(5000)] + [(None, 1, 1), (None, 0, 2)]
    df = spark.createDataFrame(rows, "k string, a int, b int").repartition(6)
    got = {}
    for r in inventory.numbered(df, "k", ["a", "b"], "n", Scratch(spark, "numbered")).collect():
        got.setdefault(r.k, []).append((r.n, r.a, r.b))
    for k, held in got.items():
        held.sort()
        assert [n for n, _, _ in held] == list(range(len(held)))
        assert [x[1:] for x in held] == sorted((a, b) for kk, a, b in rows if kk == k)
