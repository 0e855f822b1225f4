"""Books in ZIP containers: discovery, entries, one-pass analysis into typed tables, and export.

One task owns a book: the archive is opened once and every document is read once; what leaves the Python stage is a row of
nested arrays, from which the fact tables are exploded. A failure is a row with its stage, never an abort.
"""

from __future__ import annotations

import hashlib
import io
import posixpath
import re
import struct
import unicodedata
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexmill.functions.values import is_control_path
from codexmill.parsers import css, inspection, svg, xhtml, xmlparts
from codexmill.session import Scratch


@dataclass(frozen=True)
class Limits:  # fixed values: the defaults
    """What one book may take; whatever is beyond is told as ``limit``, nothing is cut to fit."""

    entries: int = 65_536
    path_bytes: int = 8 << 20
    package_bytes: int = 16 << 20
    control_bytes: int = 4 << 20
    navigation_bytes: int = 16 << 20
    resource_bytes: int = 32 << 20
    book_bytes: int = 512 << 20
    resources: int = 10_000


DEFAULT_LIMITS = Limits()

ENTRIES = "pub_id string, path string, size_bytes bigint, compressed_size bigint, crc32 bigint, data_offset bigint, stored boolean, encrypted boolean, is_control boolean, bytes binary"
_LINK = "struct<ord:int,element_ord:int,element:string,attribute:string,role:string,declared:string,bases:array<string>>"
BOOK = f"""pub_id string, status string, failure_stage string, failure string, package_path string, version string, unique_identifier string, prefix string, toc string, progression string, nav_outcome string, ncx_outcome string,
 rootfiles array<struct<ord:int,full_path:string,media_type:string>>,
 opf2_metas array<struct<ord:int,name:string,content:string>>,
 metadata_links array<struct<ord:int,id:string,href:string,rel:string,refines:string,media_type:string,properties:array<string>>>,
 collections array<struct<path:array<int>,role:string,links:array<string>>>,
 nav_lists array<struct<document:string,source:string,selected:boolean,base:string,list_index:int,semantic:string,heading:string,hidden:boolean,points:int>>,
 elements array<struct<ord:int,kind:string,id:string,dir:string,xml_lang:string,content:string,scheme:string,role:string,file_as:string>>,
 metas array<struct<ord:int,id:string,dir:string,xml_lang:string,property:string,refines:string,scheme:string,content:string>>,
 items array<struct<ord:int,id:string,href:string,media_type:string,properties:array<string>,fallback:string,media_overlay:string>>,
 itemrefs array<struct<ord:int,id:string,idref:string,linear:string,properties:array<string>>>,
 guide array<struct<ord:int,type:string,title:string,href:string>>,
 nav_points array<struct<document:string,list_index:int,list_semantic:string,point_path:array<int>,semantic:string,label:string,authored_href:string,hidden:boolean>>,
 resources array<struct<path:string,size_bytes:bigint,format:string,content_state:string,content_issue:string,text:string,executable:boolean,activities:array<string>,fingerprint:string,base:string,
  viewports:array<struct<ord:int,name:string,value:string>>,
  supplementary:array<struct<ord:int,kind:string,text:string,position:int>>,
  svg_text:array<struct<ord:int,element:string,text:string>>,
  svg_foreign:array<struct<ord:int,text:string,bases:array<string>>>,
  svg_root:struct<width:string,height:string,view_box:string>,
  spans:array<struct<element:string,element_ord:int,role:string,start:int,end:int,lang:string,dir:string,fragment:string>>,
  fragments:array<struct<id:string,element:string>>,
  links:array<{_LINK}>,
  structure:array<struct<ord:int,role:string,label:string,fragment:string>>,
  media:array<struct<ord:int,element_ord:int,kind:string,element:string,alt:string,detail:string>>,
  forms:array<struct<ord:int,element_ord:int,kind:string,element:string,name:string>>,
  scripts:array<struct<ord:int,element_ord:int,kind:string,attribute:string,type:string,has_text:boolean>>,
  accessibility:array<struct<ord:int,kind:string,element:string,value:string,fragment:string>>,
  smil:array<struct<node_id:int,parent_id:int,kind:string,epub_types:array<string>,text_ref:string,audio_src:string,clip_begin:bigint,clip_end:bigint>>,
  inspection:struct<kind:string,state:string,issue:string,valid:boolean,width:int,height:int,animated:boolean,faces:int,glyphs:int,cues:int,duration_ms:bigint,tracks:array<string>,codecs:array<string>,family:string,style:string>>>"""


def discover(spark: SparkSession, directory: str, suffix: str = "epub") -> DataFrame:
    """Books of one directory by their suffix in any case: pub_id, source_path, archive_size_bytes, content."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(directory)
    return files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "").alias("pub_id"), F.col("path").alias("source_path"), F.col("length").alias("archive_size_bytes"), "content")


def archive_entries(data: bytes, limits: Limits = DEFAULT_LIMITS) -> list[dict]:
    """Entries of an archive; of a repeated name the last counts. Names that only differ in case or composition are aliases of one file on many systems and refused."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        found = {}
        for info in z.infolist():
            if info.is_dir():
                continue
            at = info.header_offset
            n, m = struct.unpack_from("<HH", data, at + 26)
            found[info.filename] = (info, at + 30 + n + m)
        if len(found) > limits.entries or sum(len(p.encode()) for p in found) > limits.path_bytes:
            raise xmlparts.FormatError("limit")
        if len({unicodedata.normalize("NFC", p).casefold() for p in found}) < len(found):
            raise xmlparts.FormatError("alias-collision")
        out = []
        for path, (info, offset) in sorted(found.items()):
            encrypted = bool(info.flag_bits & 1)
            out.append({"path": path, "size_bytes": info.file_size, "compressed_size": info.compress_size, "crc32": info.CRC, "data_offset": offset, "stored": info.compress_type == zipfile.ZIP_STORED, "encrypted": encrypted, "is_control": path == "mimetype" or path.startswith("META-INF/"), "bytes": None if encrypted else z.read(info)})
        return out


def explode_entries(books: DataFrame) -> DataFrame:
    """All entries of (pub_id, content); unreadable archives have none and are told by ``analyse``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for pub, content in zip(pdf.pub_id, pdf.content, strict=True):
                try:
                    rows = archive_entries(bytes(content))
                except (zipfile.BadZipFile, xmlparts.FormatError, struct.error, NotImplementedError):
                    continue
                if rows:
                    yield pd.DataFrame(rows).assign(pub_id=pub)[[c.split()[0] for c in ENTRIES.split(", ")]]

    return books.select("pub_id", "content").mapInPandas(run, ENTRIES)


def stored_ranges(entries: DataFrame) -> DataFrame:
    """Byte ranges that can be served as they lie: stored, not encrypted, equal sizes."""
    plain = F.col("stored") & ~F.col("encrypted") & (F.col("size_bytes") == F.col("compressed_size"))
    return entries.select("pub_id", "path", F.when(plain, F.struct(F.col("data_offset").alias("from"), (F.col("data_offset") + F.col("size_bytes")).alias("to"))).alias("range"))


_ROOT = re.compile(rb"<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>|<([A-Za-z_][\w:.-]*)", re.DOTALL)


def _format(essence: str | None, data: bytes) -> str | None:
    """Format of a document: its root element beats its declared type, however much stands before it."""
    text = data.replace(b"\0", b"") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else data
    root = next((m[1] for m in _ROOT.finditer(text) if m[1]), b"")
    name = root.rsplit(b":", 1)[-1].lower().decode()
    if name in ("html", "svg", "smil", "ncx") and (essence is None or essence.endswith("xml") or essence.startswith("text/")):
        return {"html": "xhtml"}.get(name, name)
    return {"application/xhtml+xml": "xhtml", "image/svg+xml": "svg", "text/css": "css", "application/smil+xml": "smil", "application/x-dtbncx+xml": "ncx"}.get(essence)


def analyse_resource(path: str, data: bytes, media_type: str | None, limits: Limits = DEFAULT_LIMITS) -> dict:
    """Facts, inspection and fingerprint of one resource from a single read."""
    essence = (media_type or "").split(";")[0].strip().lower() or None
    out = {"path": path, "size_bytes": len(data), "format": None, "content_state": "not_applicable", "content_issue": None, "text": None, "executable": None, "activities": None, "fingerprint": hashlib.sha256(data).hexdigest(), "spans": None, "fragments": None, "links": None, "structure": None, "media": None, "forms": None, "scripts": None, "accessibility": None, "smil": None}
    if len(data) > limits.resource_bytes:
        return out | {"content_state": "unavailable", "content_issue": "limit", "inspection": {"kind": None, "state": "unavailable", "issue": "limit"}}
    kind = out["format"] = _format(essence, data)
    try:
        if kind == "xhtml":
            f = xhtml.parse_xhtml(xmlparts.decode_xml(data))
            out |= {"content_state": "complete", "text": f.text, "spans": f.spans, "fragments": f.fragments, "links": [{**x, "bases": [f.base] if f.base else []} for x in f.links], "base": f.base, "viewports": f.viewports, "supplementary": f.supplementary, "structure": f.structure, "media": f.media, "forms": f.forms, "scripts": f.scripts, "accessibility": f.accessibility, "activities": sorted(f.activities), "executable": xhtml.has_executable_content(f)}
        elif kind == "svg":
            s = svg.parse_svg(data)
            runs = any(x["kind"] in ("external", "event-handler") or (x["kind"] == "inline" and x["has_text"]) for x in s["scripts"])
            out |= {"content_state": "complete", "text": "\n".join(t["text"] for t in s["text"]), "svg_text": s["text"], "svg_foreign": [{"ord": x["ord"], "text": x["text"], "bases": x["bases"]} for x in s["foreign"]], "svg_root": {k: s[k] for k in ("width", "height", "view_box")}, "fragments": s["fragments"], "links": s["links"] + [{**x, "bases": y["bases"]} for y in s["foreign"] for x in y["links"]], "scripts": s["scripts"], "activities": sorted(s["activities"]), "executable": runs}
        elif kind == "css":
            text = css.decode_css(data)
            refs, whole = css.parse_css(text) if text is not None else ([], False)
            links = [{"ord": r["ord"], "element": None, "attribute": r["property"], "role": r["role"], "declared": r["declared"]} for r in refs]
            out |= {"content_state": "complete" if whole else "partial", "content_issue": None if whole else "malformed", "links": links}
        elif kind == "smil":
            out |= {"content_state": "complete", "smil": xmlparts.parse_smil(data)}
    except (xmlparts.FormatError, RecursionError) as e:
        out |= {"content_state": "unavailable", "content_issue": f"malformed: {e}"[:200]}
    seen = inspection.inspect(data, {"image/svg+xml": "svg"}.get(essence))
    return out | {"inspection": {k: seen.get(k) for k in ("kind", "state", "issue", "valid", "width", "height", "animated", "faces", "glyphs", "cues", "duration_ms", "tracks", "codecs", "family", "style")}}


def _navigation(entries: dict, path: str | None, parse: Callable[[bytes], list[dict]], limits: Limits) -> tuple[list[dict], str]:
    """Lists of a navigation document and how its loading ended: loaded, not-attempted, missing, read-failed, limit, encoding or malformed."""
    if path is None:
        return [], "not-attempted"
    entry = entries.get(path)
    if entry is None:
        return [], "missing"
    if entry["bytes"] is None:
        return [], "read-failed"
    if len(entry["bytes"]) > limits.navigation_bytes:
        return [], "limit"
    try:
        return parse(entry["bytes"]), "loaded"
    except xmlparts.FormatError as e:
        return [], "encoding" if str(e) in ("encoding", "utf-32", "encoding-conflict") else "malformed"


def _document(entries: dict, path: str, limit: int) -> bytes:
    if len(entries[path]["bytes"]) > limit:
        raise xmlparts.FormatError("limit")
    return entries[path]["bytes"]


def analyse_book(pub_id: str, data: bytes, limits: Limits = DEFAULT_LIMITS) -> dict:
    """All facts of a book as one nested record; budgets are applied in path order and told where they end.

    Points of all navigation documents are kept: of the selected one (the document of the property, else the NCX that the
    spine names) and of every other declared NCX.
    """
    book: dict = dict.fromkeys(_COLUMNS) | {"pub_id": pub_id, "status": "failed"}
    stage = "archive"
    try:
        entries = {e["path"]: e for e in archive_entries(data, limits)}
        stage = "container"
        book["rootfiles"] = files = xmlparts.rootfiles(_document(entries, "META-INF/container.xml", limits.control_bytes))
        book["package_path"] = path = files[xmlparts.default_rootfile(files)]["full_path"]
        stage = "package"
        p = xmlparts.parse_package(_document(entries, path, limits.package_bytes))
        book |= {k: p[k] for k in ("version", "unique_identifier", "prefix", "toc", "progression", "elements", "metas", "opf2_metas", "collections", "items", "itemrefs", "guide")}
        book["metadata_links"] = p["links"]
        stage = "content"
        home = posixpath.dirname(path)
        where = lambda href: posixpath.normpath(posixpath.join(home, unquote((href or "").split("#")[0].split("?")[0]))) if href else None
        navs = [i for i in p["items"] if "nav" in i["properties"]]
        nav = where(navs[0]["href"]) if len(navs) == 1 else None
        ncx = where(next((i["href"] for i in p["items"] if i["id"] and i["id"] == p["toc"]), None))
        book["nav_lists"], book["nav_points"] = [], []
        lists, book["nav_outcome"] = _navigation(entries, nav, xmlparts.parse_nav, limits)
        second, book["ncx_outcome"] = _navigation(entries, ncx, xmlparts.parse_ncx, limits)
        chosen = nav if book["nav_outcome"] == "loaded" else ncx
        documents = [(nav, "nav", lists), (ncx, "ncx", second)]
        more = sorted({where(i["href"]) for i in p["items"] if (i["media_type"] or "").strip().lower() == "application/x-dtbncx+xml" and i["href"]} - {nav, ncx})
        documents += [(x, "ncx", _navigation(entries, x, xmlparts.parse_ncx, limits)[0]) for x in more]
        for document, source, found in documents:
            base = xhtml.parse_xhtml(xmlparts.decode_xml(entries[document]["bytes"])).base if found and source == "nav" else None
            for n in found:
                book["nav_lists"].append({"document": document, "source": source, "selected": document == chosen, "base": base, "list_index": n["list_index"], "semantic": n["semantic"], "heading": n["heading"], "hidden": n["hidden"], "points": len(n["points"])})
                book["nav_points"] += [{"document": document, "list_index": n["list_index"], "list_semantic": n["semantic"], **q} for q in n["points"]]
        identifier = next((e["content"] for e in p["elements"] if e["kind"] == "identifier" and e["id"] == p["unique_identifier"]), "") or ""
        hidden = {}
        if "META-INF/encryption.xml" in entries:
            hidden = {o["path"]: o["algorithm"] for o in xmlparts.obfuscations(_document(entries, "META-INF/encryption.xml", limits.control_bytes))}
        types: dict = {}
        for i in p["items"]:
            types.setdefault(where(i["href"]), i["media_type"])
        book["resources"], budget = [], limits.book_bytes
        for n, (name, e) in enumerate(x for x in entries.items() if not x[1]["is_control"]):
            if e["bytes"] is None or n >= limits.resources or budget < e["size_bytes"]:
                issue = "encrypted" if e["bytes"] is None else "limit"
                book["resources"].append({"path": name, "size_bytes": e["size_bytes"], "content_state": "unavailable", "content_issue": issue})
                continue
            budget -= e["size_bytes"]
            raw = xmlparts.deobfuscate(e["bytes"], hidden[name], identifier) if name in hidden else e["bytes"]
            book["resources"].append(analyse_resource(name, raw, types.get(name), limits))
        book["status"] = "ok"
    except (zipfile.BadZipFile, xmlparts.FormatError, KeyError, TypeError, IndexError, struct.error, NotImplementedError) as e:
        book |= {"failure_stage": stage, "failure": f"{type(e).__name__}: {e}"[:300]}
    return book


def analyse(books: DataFrame, limits: Limits = DEFAULT_LIMITS) -> DataFrame:
    """One nested row a book of (pub_id, content); ``book_tables`` makes the tables of it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for pub, content in zip(pdf.pub_id, pdf.content, strict=True):
                yield pd.DataFrame([_fit(analyse_book(pub, bytes(content), limits))])

    return books.select("pub_id", "content").mapInPandas(run, BOOK)


_SINGLE = ("status", "failure_stage", "failure", "package_path", "version", "unique_identifier", "prefix", "toc", "progression", "nav_outcome", "ncx_outcome")
_LISTS = {
    "rootfiles": ("ord", "full_path", "media_type"),
    "opf2_metas": ("ord", "name", "content"),
    "metadata_links": ("ord", "id", "href", "rel", "refines", "media_type", "properties"),
    "collections": ("path", "role", "links"),
    "nav_lists": ("document", "source", "selected", "base", "list_index", "semantic", "heading", "hidden", "points"),
    "elements": ("ord", "kind", "id", "dir", "xml_lang", "content", "scheme", "role", "file_as"),
    "metas": ("ord", "id", "dir", "xml_lang", "property", "refines", "scheme", "content"),
    "items": ("ord", "id", "href", "media_type", "properties", "fallback", "media_overlay"),
    "itemrefs": ("ord", "id", "idref", "linear", "properties"),
    "guide": ("ord", "type", "title", "href"),
    "nav_points": ("document", "list_index", "list_semantic", "point_path", "semantic", "label", "authored_href", "hidden"),
}
_COLUMNS = ["pub_id", *_SINGLE, *_LISTS, "resources"]
_PLAIN = ("path", "size_bytes", "format", "content_state", "content_issue", "text", "executable", "activities", "fingerprint", "base", "svg_root", "inspection")
_PARTS = {
    "viewports": ("ord", "name", "value"),
    "supplementary": ("ord", "kind", "text", "position"),
    "svg_text": ("ord", "element", "text"),
    "svg_foreign": ("ord", "text", "bases"),
    "spans": ("element", "element_ord", "role", "start", "end", "lang", "dir", "fragment"),
    "fragments": ("id", "element"),
    "links": ("ord", "element_ord", "element", "attribute", "role", "declared", "bases"),
    "structure": ("ord", "role", "label", "fragment"),
    "media": ("ord", "element_ord", "kind", "element", "alt", "detail"),
    "forms": ("ord", "element_ord", "kind", "element", "name"),
    "scripts": ("ord", "element_ord", "kind", "attribute", "type", "has_text"),
    "accessibility": ("ord", "kind", "element", "value", "fragment"),
    "smil": ("node_id", "parent_id", "kind", "epub_types", "text_ref", "audio_src", "clip_begin", "clip_end"),
}


def _fit(book: dict) -> dict:
    """The record with exactly the fields of the schema."""
    for name, fields in _LISTS.items():
        if book[name] is not None:
            book[name] = [{f: x.get(f) for f in fields} for x in book[name]]
    for r in book["resources"] or []:
        for name, fields in _PARTS.items():
            if r.get(name) is not None:
                r[name] = [{f: x.get(f) for f in fields} for x in r[name]]
    if book["resources"]:
        book["resources"] = [{f: r.get(f) for f in (*_PLAIN, *_PARTS)} for r in book["resources"]]
    return {c: book[c] for c in _COLUMNS}


def book_tables(analysed: DataFrame) -> dict[str, DataFrame]:
    """The fact tables of analysed books, keyed by book and, for content facts, resource path. The analysis is written once; each table reads its own columns of that."""
    kept = Scratch(analysed.sparkSession, "books").cut(analysed)
    out = {"publications": kept.select("pub_id", *_SINGLE)}
    for name in _LISTS:
        out[name] = kept.select("pub_id", F.explode(name).alias("x")).select("pub_id", "x.*")
    resources = kept.select("pub_id", F.explode("resources").alias("r")).select("pub_id", "r.*")
    out["resources"] = resources.select("pub_id", *_PLAIN)
    for name in _PARTS:
        out[name] = resources.select("pub_id", "path", F.posexplode(name).alias("place", "x")).select("pub_id", "path", "place", "x.*")
    return out


def export(entries: DataFrame) -> DataFrame:
    """Archives of (pub_id, path, bytes): the type entry first and stored, the rest deflated in path order."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            rows = {p: bytes(b) for p, b in zip(pdf.path, pdf.bytes, strict=True) if b is not None}
            z.writestr(zipfile.ZipInfo("mimetype"), rows.pop("mimetype", b"application/epub+zip"), zipfile.ZIP_STORED)
            for path in sorted(rows):
                z.writestr(zipfile.ZipInfo(path), rows[path], zipfile.ZIP_DEFLATED)
        return pd.DataFrame([{"pub_id": key[0], "content": held.getvalue()}])

    return entries.select("pub_id", "path", "bytes").groupBy("pub_id").applyInPandas(run, "pub_id string, content binary")


def write_archives(archives: DataFrame, directory: str) -> None:
    """Sink of exported archives (pub_id, content): one file a book, ``directory``/``pub_id``.epub, in any file system of the cluster; written where the task runs, under its own name last."""

    def run(rows: Iterator) -> None:
        import pyarrow.fs as pafs

        fs, root = pafs.FileSystem.from_uri(directory) if "://" in directory else (pafs.LocalFileSystem(), directory)
        fs.create_dir(root)
        for r in rows:
            part = f"{root}/.{r.pub_id}.part"
            with fs.open_output_stream(part) as out:
                out.write(bytes(r.content))
            fs.move(part, f"{root}/{r.pub_id}.epub")

    archives.select("pub_id", "content").foreachPartition(run)


def publication_entries(entries: DataFrame) -> DataFrame:
    """Entries that are resources of the publication."""
    return entries.where(~is_control_path(F.col("path")))


def create(identifier: str, title: str, language: str, modified: str) -> dict[str, bytes]:
    """Entries of a minimal publication."""
    blank = {"id": None, "dir": None, "xml_lang": None}
    element = lambda kind, content, id_=None: {"kind": kind, **blank, "id": id_, "content": content}
    package = {
        "version": "3.0",
        "unique_identifier": "pub-id",
        "prefix": None,
        "toc": None,
        "progression": None,
        "elements": [element("identifier", identifier, "pub-id"), element("title", title), element("language", language)],
        "metas": [{"id": None, "property": "dcterms:modified", "refines": None, "scheme": None, "content": modified}],
        "opf2_metas": [],
        "links": [],
        "items": [{"id": "nav", "href": "nav.xhtml", "media_type": "application/xhtml+xml", "properties": ["nav"], "fallback": None, "media_overlay": None}],
        "itemrefs": [{"id": None, "idref": "nav", "linear": None, "properties": []}],
        "guide": [],
    }
    nav = xmlparts.nav_to_xhtml([{"semantic": "toc", "hidden": False, "heading": title, "points": [{"point_path": [0], "label": title, "authored_href": "nav.xhtml"}]}], title)
    return {
        "mimetype": b"application/epub+zip",
        "META-INF/container.xml": xmlparts.rootfiles_to_xml([{"full_path": "EPUB/package.opf", "media_type": xmlparts.PACKAGE_TYPE}]).encode(),
        "EPUB/package.opf": xmlparts.package_to_xml(package).encode(),
        "EPUB/nav.xhtml": nav.encode(),
    }
