import io
import zipfile

import pytest

from codexmill.operators.edit import CHANGES, EditError, PackageEdit, apply_changes, edit_packages, preview
from codexmill.parsers import xmlparts
from codexmill.sources import books
from codexmill.sources.datasource import BookSource
from codexmill.streaming.ingest import ingest

CHAPTER = b'<html xmlns="http://www.w3.org/1999/xhtml"><head><title>x</title><script src="a.js"></script></head><body><h1 id="a">One &amp; two</h1><p>Text <a href="b.xhtml#c">go</a><img src="i.png"/></p></body></html>'


def archive(entries):
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        for path, data in entries.items():
            z.writestr(path, data)
    return held.getvalue()


def sample():
    e = books.create("urn:uuid:0e1d7a52-7e3a-4b62-9c28-0123456789ab", "Tïtle", "en", "2024-01-01T00:00:00Z")
    p = PackageEdit(xmlparts.parse_package(e["EPUB/package.opf"]))
    p.add_item("c1", "text/c1.xhtml", "application/xhtml+xml").add_item("css", "s.css", "text/css").add_itemref("c1")
    return e | {"EPUB/package.opf": p.to_bytes(), "EPUB/text/c1.xhtml": CHAPTER, "EPUB/s.css": b'@import "x.css"; p { background: url(i.png) }'}


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([("good", archive(sample())), ("bad", b"no archive"), ("empty", archive({"a": b""}))], "pub_id string, content binary")


def test_tables(frame):
    tables = books.book_tables(books.analyse(frame))
    status = {r.pub_id: (r.status, r.failure_stage) for r in tables["publications"].collect()}
    assert status == {"good": ("ok", None), "bad": ("failed", "archive"), "empty": ("failed", "container")}
    res = {r.path: r for r in tables["resources"].collect()}
    assert res["EPUB/text/c1.xhtml"].text == "One & two\nText go"
    assert res["EPUB/text/c1.xhtml"].executable
    links = {(r.path, r.role, r.declared) for r in tables["links"].collect()}
    assert {("EPUB/text/c1.xhtml", "hyperlink", "b.xhtml#c"), ("EPUB/text/c1.xhtml", "image", "i.png"), ("EPUB/text/c1.xhtml", "script", "a.js"), ("EPUB/s.css", "import", "x.css"), ("EPUB/s.css", "css", "i.png")} <= links
    assert [r.label for r in tables["nav_points"].collect()] == ["Tïtle"]
    assert {(r.kind, r.content) for r in tables["elements"].collect()} >= {("title", "Tïtle"), ("language", "en")}


def test_round_trip_and_source(spark, frame, tmp_path):
    entries = books.explode_entries(frame).where("pub_id = 'good'")
    first = {r.path: bytes(r.bytes) for r in entries.collect()}
    assert first == sample()
    again = books.export(entries)
    data = bytes(again.first().content)
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.infolist()[0].filename == "mimetype"
        assert z.infolist()[0].compress_type == zipfile.ZIP_STORED
    assert {r.path: bytes(r.bytes) for r in books.explode_entries(again).collect()} == first
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Good.EPUB").write_bytes(data)
    (tmp_path / "in" / "note.txt").write_bytes(b"x")
    spark.dataSource.register(BookSource)
    assert spark.read.format("codexmill_books").load(str(tmp_path / "in")).count() == len(first)
    assert [r.pub_id for r in books.discover(spark, str(tmp_path / "in")).collect()] == ["Good"]
    query = ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert query.awaitTermination(120)
    assert [r.status for r in spark.read.parquet(str(tmp_path / "out" / "publications")).collect()] == ["ok"]
    assert spark.read.parquet(str(tmp_path / "out" / "links")).count() == 6


def test_staged_changes(spark, frame):
    entries = books.explode_entries(frame).where("pub_id = 'good'")
    rows = [("good", 1, "upsert", "EPUB/new.txt", b"1"), ("good", 2, "upsert", "EPUB/new.txt", b"2"), ("good", 3, "remove", "EPUB/s.css", None), ("good", 4, "remove", "EPUB/nothing", None), ("good", 5, "upsert", "mimetype", b"x"), ("good", 6, "upsert", "../x", b"x"), ("good", 7, "upsert", "EPUB/package.opf", b"x")]
    package = spark.createDataFrame([("good", "EPUB/package.opf")], "pub_id string, path string")
    seen = preview(entries, spark.createDataFrame(rows, CHANGES), package)
    assert {(r.path, r.kind) for r in seen.collect()} == {("EPUB/new.txt", "added"), ("EPUB/s.css", "removed"), ("EPUB/nothing", "none"), ("mimetype", "refused"), ("../x", "refused"), ("EPUB/package.opf", "refused")}
    after = {r.path: bytes(r.bytes) for r in apply_changes(entries, seen).collect()}
    assert after == {k: v for k, v in sample().items() if k != "EPUB/s.css"} | {"EPUB/new.txt": b"2"}


def test_package_edits(spark):
    data = sample()["EPUB/package.opf"]
    edit = PackageEdit(xmlparts.parse_package(data))
    for refused in (lambda: edit.remove_item("c1"), lambda: edit.add_item("c1", "x", "y"), lambda: edit.add_itemref("zz"), lambda: edit.move_itemref("c1", 9), lambda: edit.remove_element(kind="identifier"), lambda: edit.migrate("2024")):
        with pytest.raises(EditError):
            refused()
    edit.move_itemref("c1", 0).remove_item("css").add_element("creator", "A").replace_element("B", kind="title")
    again = xmlparts.parse_package(edit.to_bytes())
    assert [r["idref"] for r in again["itemrefs"]] == ["c1", "nav"]
    assert {e["content"] for e in again["elements"] if e["kind"] in ("title", "creator")} == {"A", "B"}
    assert edit.unique_id("c1") == "c1-2"
    df = spark.createDataFrame([("p", "x.opf", data), ("q", "x.opf", b"<no/>")], "pub_id string, path string, bytes binary")
    got = {r.pub_id: r.refusal for r in edit_packages(df, lambda e: e.add_meta("dcterms:issued", "2020")).collect()}
    assert got == {"p": None, "q": "package-root"}


def test_obfuscation_is_its_own_inverse():
    data = bytes(range(256)) * 8
    for algorithm, identifier in (("idpf", "urn:x y"), ("adobe", "urn:uuid:0e1d7a52-7e3a-4b62-9c28-0123456789ab")):
        hidden = xmlparts.deobfuscate(data, algorithm, identifier)
        assert hidden != data
        assert xmlparts.deobfuscate(hidden, algorithm, identifier) == data
