"""Staged edits: change rows over container entries, previewed as a plan, committed as a new table; and package edits.

A change is (pub_id, seq, op, path, bytes) with op upsert or remove. The last change of a path counts; a removal of what
is not there is no change; control files and the package document are refused.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexmill.functions.values import PROTECTED_ANNOTATION_PATHS, is_control_path, path_error
from codexmill.parsers import annotations
from codexmill.parsers.xmlparts import FormatError, default_rootfile, nav_to_xhtml, package_to_xml, parse_nav, parse_ncx, parse_package, rootfiles

CHANGES = "pub_id string, seq bigint, op string, path string, bytes binary"


class EditError(ValueError):
    """An edit is refused; nothing was changed."""


def preview(entries: DataFrame, changes: DataFrame, structural: DataFrame | None = None) -> DataFrame:
    """Effective changes with their verdict: kind added, replaced, removed, none or refused, and the reason of a refusal.

    ``structural`` (pub_id, path) names paths that only package edits may touch.
    """
    last = changes.withColumn("rank", F.row_number().over(Window.partitionBy("pub_id", "path").orderBy(F.desc("seq")))).where(F.col("rank") == 1).drop("rank")
    have = entries.select(F.col("pub_id").alias("h_pub"), F.col("path").alias("h_path")).distinct()
    j = last.join(have, (F.col("pub_id") == F.col("h_pub")) & (F.col("path") == F.col("h_path")), "left")
    reason = F.when(path_error(F.col("path")).isNotNull(), F.concat(F.lit("path: "), path_error(F.col("path")))).when(is_control_path(F.col("path")), "control-file")
    if structural is not None:
        s = structural.select(F.col("pub_id").alias("s_pub"), F.col("path").alias("s_path")).distinct()
        j = j.join(s, (F.col("pub_id") == F.col("s_pub")) & (F.col("path") == F.col("s_path")), "left")
        reason = reason.when(F.col("s_pub").isNotNull(), "structural")
    there = F.col("h_pub").isNotNull()
    kind = F.when(reason.isNotNull(), "refused").when(F.col("op") == "upsert", F.when(there, "replaced").otherwise("added")).when(there, "removed").otherwise("none")
    return j.select("pub_id", "seq", "op", "path", "bytes", kind.alias("kind"), reason.alias("reason")).orderBy("pub_id", "path")


def apply_changes(entries: DataFrame, effective: DataFrame) -> DataFrame:
    """Entries (pub_id, path, bytes) with a preview's changes applied: base without touched paths, plus upserts."""
    real = effective.where(F.col("kind").isin("added", "replaced", "removed"))
    kept = entries.select("pub_id", "path", "bytes").join(real.select("pub_id", "path"), ["pub_id", "path"], "left_anti")
    return kept.unionByName(real.where(F.col("kind") != "removed").select("pub_id", "path", "bytes"))


class PackageEdit:
    """Edits of one parsed package; every method checks first and leaves the package as it was when it refuses."""

    def __init__(self, package: dict):
        self.p = package

    def _one(self, rows: list[dict], what: str, **selector) -> int:
        hits = [i for i, r in enumerate(rows) if all(r.get(k) == v for k, v in selector.items())]
        if len(hits) != 1:
            raise EditError(f"{what}: {'none' if not hits else 'ambiguous'}")
        return hits[0]

    def unique_id(self, base: str) -> str:
        taken, n = {i["id"] for i in self.p["items"]}, 1
        while (name := base if n == 1 else f"{base}-{n}") in taken:
            n += 1
        return name

    def add_item(self, id: str, href: str, media_type: str, **more) -> PackageEdit:
        if any(i["id"] == id for i in self.p["items"]):
            raise EditError("manifest id is taken")
        self.p["items"].append({"id": id, "href": href, "media_type": media_type, "properties": [], "fallback": None, "media_overlay": None} | more)
        return self

    def remove_item(self, id: str) -> PackageEdit:
        at = self._one(self.p["items"], "item", id=id)
        if any(r["idref"] == id for r in self.p["itemrefs"]):
            raise EditError("the spine uses the item")
        del self.p["items"][at]
        return self

    def replace_item(self, id: str, **new) -> PackageEdit:
        at = self._one(self.p["items"], "item", id=id)
        if new.get("id", id) != id and any(i["id"] == new["id"] for i in self.p["items"]):
            raise EditError("manifest id is taken")
        self.p["items"][at] |= new
        return self

    def add_itemref(self, idref: str, linear: str | None = None, properties: list[str] | None = None) -> PackageEdit:
        self._one(self.p["items"], "item", id=idref)
        self.p["itemrefs"].append({"id": None, "idref": idref, "linear": linear, "properties": properties or []})
        return self

    def remove_itemref(self, idref: str) -> PackageEdit:
        del self.p["itemrefs"][self._one(self.p["itemrefs"], "itemref", idref=idref)]
        return self

    def move_itemref(self, idref: str, to: int) -> PackageEdit:
        """``to`` is the final position."""
        at = self._one(self.p["itemrefs"], "itemref", idref=idref)
        if not 0 <= to < len(self.p["itemrefs"]):
            raise EditError("position")
        self.p["itemrefs"].insert(to, self.p["itemrefs"].pop(at))
        return self

    def add_element(self, kind: str, content: str, **more) -> PackageEdit:
        self.p["elements"].append({"kind": kind, "id": None, "dir": None, "xml_lang": None, "content": content} | more)
        return self

    def remove_element(self, **selector) -> PackageEdit:
        at = self._one(self.p["elements"], "element", **selector)
        if self.p["elements"][at]["id"] and self.p["elements"][at]["id"] == self.p["unique_identifier"]:
            raise EditError("the unique identifier")
        del self.p["elements"][at]
        return self

    def replace_element(self, content: str, /, **selector) -> PackageEdit:
        self.p["elements"][self._one(self.p["elements"], "element", **selector)]["content"] = content
        return self

    def add_meta(self, property: str, content: str, refines: str | None = None) -> PackageEdit:
        self.p["metas"].append({"id": None, "property": property, "refines": refines, "scheme": None, "content": content})
        return self

    def remove_meta(self, **selector) -> PackageEdit:
        del self.p["metas"][self._one(self.p["metas"], "meta", **selector)]
        return self

    def replace_meta(self, content: str, /, **selector) -> PackageEdit:
        self.p["metas"][self._one(self.p["metas"], "meta", **selector)]["content"] = content
        return self

    def replace_itemref(self, idref: str, /, **new) -> PackageEdit:
        at = self._one(self.p["itemrefs"], "itemref", idref=idref)
        if new.get("idref", idref) != idref:
            self._one(self.p["items"], "item", id=new["idref"])
        self.p["itemrefs"][at] |= new
        return self

    def add_link(self, href: str, rel: str | None = None, **more) -> PackageEdit:
        self.p["links"].append({"id": None, "href": href, "rel": rel, "refines": None, "media_type": None, "properties": []} | more)
        return self

    def remove_link(self, **selector) -> PackageEdit:
        del self.p["links"][self._one(self.p["links"], "link", **selector)]
        return self

    def replace_link(self, href: str, /, **selector) -> PackageEdit:
        self.p["links"][self._one(self.p["links"], "link", **selector)]["href"] = href
        return self

    def migrate(self, modified: str) -> PackageEdit:
        """A version 2 package to version 3: legacy cover, roles and sort names become properties and refinements."""
        if (self.p["version"] or "").startswith("3"):
            raise EditError("already version 3")
        self.p["version"] = "3.0"
        cover = next((m["content"] for m in self.p["opf2_metas"] if (m["name"] or "").lower() == "cover"), None)
        for i in self.p["items"]:
            if cover and i["id"] == cover and "cover-image" not in i["properties"]:
                i["properties"].append("cover-image")
        for n, e in enumerate(self.p["elements"], 1):
            for key, prop in (("role", "role"), ("file_as", "file-as")):
                if e.get(key):
                    e["id"] = e["id"] or f"{e['kind']}-{n}"
                    self.add_meta(prop, e[key], refines=f"#{e['id']}")
        self.p["metas"] = [m for m in self.p["metas"] if m["property"] != "dcterms:modified"]
        return self.add_meta("dcterms:modified", modified)

    def to_bytes(self) -> bytes:
        return package_to_xml(self.p).encode()


# Guide types and the landmark semantic that each becomes.
LANDMARKS = {
    "cover": "cover",
    "title-page": "titlepage",
    "toc": "toc",
    "index": "index",
    "glossary": "glossary",
    "acknowledgements": "acknowledgments",
    "bibliography": "bibliography",
    "colophon": "colophon",
    "copyright-page": "copyright-page",
    "epigraph": "epigraph",
    "foreword": "foreword",
    "preface": "preface",
    "dedication": "dedication",
    "loi": "loi",
    "lot": "lot",
    "text": "bodymatter",
}


def landmark_points(guide: list[dict]) -> list[dict]:
    """Landmark points of a guide; types without a semantic are left out."""
    kept = [g for g in guide if (g["type"] or "").lower() in LANDMARKS and g["href"]]
    return [{"point_path": [i], "label": g["title"] or g["type"], "authored_href": g["href"], "semantic": LANDMARKS[g["type"].lower()], "hidden": False} for i, g in enumerate(kept)]


class NavigationEdit:
    """Edits of one navigation list given as points with paths; a refused edit leaves the list as it was."""

    def __init__(self, points: list[dict]):
        self.points = [dict(p, point_path=list(p["point_path"])) for p in sorted(points, key=lambda p: p["point_path"])]

    def find(self, **selector) -> list[int]:
        """The path of the one point that the selector (point_path, label, authored_href) names."""
        hits = [p["point_path"] for p in self.points if all(p.get(k) == v for k, v in selector.items())]
        if len(hits) != 1:
            raise EditError(f"navigation point: {'none' if not hits else 'ambiguous'}")
        return list(hits[0])

    def _at(self, path: list[int]) -> dict:
        return next(p for p in self.points if p["point_path"] == path)

    def _children(self, parent: list[int]) -> int:
        return sum(len(p["point_path"]) == len(parent) + 1 and p["point_path"][:-1] == parent for p in self.points)

    def _shift(self, parent: list[int], start: int, by: int) -> None:
        d = len(parent)
        for p in self.points:
            path = p["point_path"]
            if len(path) > d and path[:d] == parent and path[d] >= start:
                path[d] += by

    def set_label(self, label: str, /, **selector) -> NavigationEdit:
        self._at(self.find(**selector))["label"] = label
        return self

    def set_href(self, href: str, /, **selector) -> NavigationEdit:
        self._at(self.find(**selector))["authored_href"] = href
        return self

    def add(self, parent: list[int], position: int, label: str, href: str | None) -> NavigationEdit:
        if parent and not any(p["point_path"] == parent for p in self.points):
            raise EditError("navigation point: none")
        if not 0 <= position <= self._children(parent):
            raise EditError("position")
        self._shift(parent, position, 1)
        self.points.append({"point_path": [*parent, position], "label": label, "authored_href": href, "semantic": None, "hidden": False})
        self.points.sort(key=lambda p: p["point_path"])
        return self

    def remove(self, **selector) -> NavigationEdit:
        self._take(self.find(**selector))
        return self

    def _take(self, path: list[int]) -> list[dict]:
        n = len(path)
        taken = [p for p in self.points if p["point_path"][:n] == path]
        self.points = [p for p in self.points if p["point_path"][:n] != path]
        self._shift(path[:-1], path[-1] + 1, -1)
        return taken

    def move(self, path: list[int], parent: list[int], position: int) -> NavigationEdit:
        """Moves a subtree below ``parent`` (a path before the move); a subtree cannot go into itself."""
        path = self.find(point_path=path)
        if parent[: len(path)] == path:
            raise EditError("a subtree cannot move into itself")
        goal = self._at(self.find(point_path=parent)) if parent else None
        before = [dict(p, point_path=list(p["point_path"])) for p in self.points]
        taken = self._take(path)
        home = list(goal["point_path"]) if goal else []
        if not 0 <= position <= self._children(home):
            self.points = before
            raise EditError("position")
        self._shift(home, position, 1)
        for p in taken:
            p["point_path"] = [*home, position, *p["point_path"][len(path) :]]
        self.points = sorted(self.points + taken, key=lambda p: p["point_path"])
        return self


def rebase_href(href: str, source: str, output: str) -> str:
    """A relative href of the document ``source`` as the document ``output`` must write it; other hrefs stay."""
    if source == output or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//", href):
        return href
    m = re.match(r"([^?#]*)(.*)", href, re.S)
    target = posixpath.normpath(posixpath.join(posixpath.dirname(source), m[1])) if m[1] else source
    if target == source:
        raise EditError("a reference into the document itself cannot move")
    new = posixpath.relpath(target, posixpath.dirname(output) or ".")
    return new + ("/" if m[1].endswith("/") else "") + m[2]


class BookEdit:
    """Edits of one book that touch files and package together; a refused edit leaves both as they were.

    ``changed`` holds what is staged: bytes to write, null to remove.
    """

    def __init__(self, entries: dict[str, bytes], package_path: str):
        self.entries, self.path = dict(entries), package_path
        self.package = PackageEdit(parse_package(entries[package_path]))
        self.changed: dict[str, bytes | None] = {}

    def file_of(self, href: str | None) -> str | None:
        """The file that a manifest href names from the package document."""
        if not href or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|/", href):
            return None
        return posixpath.normpath(posixpath.join(posixpath.dirname(self.path), unquote(re.split(r"[?#]", href)[0])))

    def _write(self, path: str, data: bytes | None) -> None:
        self.changed[path] = data
        if data is None:
            self.entries.pop(path, None)
        else:
            self.entries[path] = data

    def _new_file(self, path: str | None) -> str:
        if path is None or path == "mimetype" or path.startswith(("META-INF/", "../")):
            raise EditError("path")
        if path in self.entries:
            raise EditError("the file exists")
        return path

    def _own_file(self, id: str) -> str | None:
        """The file of an item, refused where another item names it too or where the book stands on it."""
        item = self.package.p["items"][self.package._one(self.package.p["items"], "item", id=id)]
        path = self.file_of(item["href"])
        if sum(self.file_of(i["href"]) == path for i in self.package.p["items"]) > 1:
            raise EditError("the file is shared")
        if path == self.path or "nav" in item["properties"] or (item["id"] and item["id"] == self.package.p["toc"]):
            raise EditError("structural file")
        return path

    def add_resource(self, data: bytes, id: str, href: str, media_type: str, **more) -> BookEdit:
        path = self._new_file(self.file_of(href))
        self.package.add_item(id, href, media_type, **more)
        self._write(path, data)
        return self

    def remove_resource(self, id: str) -> BookEdit:
        path = self._own_file(id)
        self.package.remove_item(id)
        if path in self.entries:
            self._write(path, None)
        return self

    def add_spine_resource(self, data: bytes, id: str, href: str, media_type: str, linear: str | None = None) -> BookEdit:
        self.add_resource(data, id, href, media_type)
        self.package.add_itemref(id, linear)
        return self

    def remove_spine_resource(self, id: str) -> BookEdit:
        """Takes the one occurrence, the item and its file out."""
        path = self._own_file(id)
        self.package.remove_itemref(id)
        self.package.remove_item(id)
        if path in self.entries:
            self._write(path, None)
        return self

    def unique_nav_href(self, base: str = "nav", suffix: str = ".xhtml") -> str:
        """An href for a new navigation document that neither a file nor an item has."""
        taken, n = {i["href"] for i in self.package.p["items"]}, 1
        while (href := f"{base}{'' if n == 1 else f'-{n}'}{suffix}") in taken or self.file_of(href) in self.entries:
            n += 1
        return href

    def migrate(self, modified: str) -> BookEdit:
        """A version 2 book to version 3: the package, and a navigation document with the lists of the NCX and landmarks of the guide."""
        p = self.package.p
        ncx = next((self.file_of(i["href"]) for i in p["items"] if i["id"] and i["id"] == p["toc"]), None)
        lists = parse_ncx(self.entries[ncx]) if ncx in self.entries else []
        self.package.migrate(modified)
        principal = [{**n, "semantic": n["semantic"] or "toc"} for n in lists if n["semantic"] in ("toc", "page-list")]
        marks = landmark_points(p["guide"])
        href = self.unique_nav_href()
        here = lambda q: dict(q, authored_href=q["authored_href"] and rebase_href(q["authored_href"], ncx, self.file_of(href)) if ncx else q["authored_href"])
        principal = [{**n, "points": [here(q) for q in n["points"]]} for n in principal]
        if marks:
            principal.append({"semantic": "landmarks", "hidden": True, "heading": None, "points": marks})
        if not any(n["semantic"] == "toc" for n in principal):
            raise EditError("no table of contents")
        title = next((e["content"] for e in p["elements"] if e["kind"] == "title"), "") or "Contents"
        self.add_resource(nav_to_xhtml(principal, title).encode(), self.package.unique_id("nav"), href, "application/xhtml+xml", properties=["nav"])
        parse_nav(self.entries[self.file_of(href)])  # what was written must read again
        return self

    # --- annotations inside the book

    def embedded_annotations(self) -> tuple[dict, dict[str, bytes]] | None:
        """The set in the container and its audiovisual resources that are there."""
        text = self.entries.get(f"META-INF/{annotations.JSON_NAME}")
        if text is None:
            return None
        s = annotations.parse_set(text)
        return s, {p: self.entries[f"META-INF/{p}"] for p in sorted(annotations.referenced_paths(s)) if f"META-INF/{p}" in self.entries}

    def set_embedded_annotations(self, s: dict, resources: dict[str, bytes]) -> BookEdit:
        """Writes the set and its resources; resources of the set before that it does not name go."""
        annotations.validate_bundle(s, resources)
        if bad := [p for p in resources if p in PROTECTED_ANNOTATION_PATHS]:
            raise EditError(f"protected path: {min(bad)}")
        before = self.embedded_annotations()
        for path in sorted(set(before[1]) - set(resources)) if before else ():
            self._write(f"META-INF/{path}", None)
        self._write(f"META-INF/{annotations.JSON_NAME}", json.dumps(s, ensure_ascii=False).encode())
        for path, data in sorted(resources.items()):
            self._write(f"META-INF/{path}", data)
        return self

    def remove_embedded_annotations(self) -> BookEdit:
        before = self.embedded_annotations()
        if before is None:
            raise EditError("no annotations")
        for path in (annotations.JSON_NAME, *before[1]):
            self._write(f"META-INF/{path}", None)
        return self

    def changes(self) -> dict[str, bytes | None]:
        """All that is staged, the package document included where it differs."""
        data = self.package.to_bytes()
        parse_package(data)
        return self.changed | ({self.path: data} if parse_package(data) != parse_package(self.entries[self.path]) else {})


def edit_books(entries: DataFrame, edit: Callable[[BookEdit], BookEdit]) -> DataFrame:
    """Entries (pub_id, path, bytes) of books after ``edit``: those columns and refusal; a refused book keeps its entries and tells why on each.

    One task holds one book, which the limits of its analysis bound.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        held = {p: bytes(b) for p, b in zip(pdf.path, pdf.bytes, strict=True) if b is not None}
        refusal = None
        try:
            files = rootfiles(held["META-INF/container.xml"])
            new = edit(BookEdit(held, files[default_rootfile(files)]["full_path"])).changes()
            held = {p: b for p, b in (held | new).items() if b is not None}
        except (EditError, FormatError, annotations.AnnotationError, KeyError, TypeError) as e:
            refusal = str(e)
        return pd.DataFrame({"pub_id": key[0], "path": list(held), "bytes": list(held.values()), "refusal": refusal})

    return entries.select("pub_id", "path", "bytes").groupBy("pub_id").applyInPandas(run, "pub_id string, path string, bytes binary, refusal string")


def edit_packages(packages: DataFrame, edit: Callable[[PackageEdit], PackageEdit]) -> DataFrame:
    """Rewrites (pub_id, path, bytes) package documents; a refused or unreadable one keeps its bytes and tells why."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for pub, path, data in zip(pdf.pub_id, pdf.path, pdf.bytes, strict=True):
                try:
                    new = edit(PackageEdit(parse_package(bytes(data)))).to_bytes()
                    parse_package(new)  # what was written must read again
                    rows.append((pub, path, new, None))
                except (EditError, FormatError) as e:
                    rows.append((pub, path, data, str(e)))
            yield pd.DataFrame(rows, columns=["pub_id", "path", "bytes", "refusal"])

    return packages.select("pub_id", "path", "bytes").mapInPandas(run, "pub_id string, path string, bytes binary, refusal string")
