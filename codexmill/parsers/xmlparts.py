"""XML documents of a publication: container, encryption, package, navigation (XHTML and NCX) and media overlays."""

from __future__ import annotations

import hashlib
import re
import xml.etree.ElementTree as ET

# Namespaces, types and limits of the formats.
CONTAINER = "{urn:oasis:names:tc:opendocument:xmlns:container}"
OPF = "{http://www.idpf.org/2007/opf}"
DC = "{http://purl.org/dc/elements/1.1/}"
XHTML = "{http://www.w3.org/1999/xhtml}"
OPS = "{http://www.idpf.org/2007/ops}"
NCX = "{http://www.daisy.org/z3986/2005/ncx/}"
SMIL = "{http://www.w3.org/ns/SMIL}"
XML = "{http://www.w3.org/XML/1998/namespace}"
ENC = "{http://www.w3.org/2001/04/xmlenc#}"
PACKAGE_TYPE = "application/oebps-package+xml"
DEPTH = 128
OBFUSCATION = {"http://www.idpf.org/2008/embedding": ("idpf", 1040), "http://ns.adobe.com/pdf/enc#RC": ("adobe", 1024)}


class FormatError(ValueError):
    """A document breaks its format; the message names the rule."""


def decode_xml(data: bytes) -> str:
    """Text of an XML document by byte order mark or declaration; UTF-32 and conflicts are refused."""
    if data.startswith((b"\xff\xfe\x00\x00", b"\x00\x00\xfe\xff")):
        raise FormatError("utf-32")
    mark = next(((m, e) for m, e in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")) if data.startswith(m)), None)
    told = re.match(rb"<\?xml[^>]*?encoding\s*=\s*[\"']([A-Za-z0-9._-]+)", data[len(mark[0]) if mark else 0 :])
    name = told[1].decode().lower() if told else None
    if mark and name and not name.startswith(mark[1][:6]):
        raise FormatError("encoding-conflict")
    try:
        return data[len(mark[0]) :].decode(mark[1]) if mark else data.decode(name or "utf-8")
    except (UnicodeDecodeError, LookupError) as e:
        raise FormatError("encoding") from e


def root_of(data: bytes | str) -> ET.Element:
    text = decode_xml(data) if isinstance(data, bytes) else data
    try:
        return ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", text))
    except ET.ParseError as e:
        raise FormatError(f"xml: {e}") from e


def rootfiles(data: bytes) -> list[dict]:
    """Rootfiles of the container document, in order."""
    root = root_of(data)
    if root.tag != f"{CONTAINER}container":
        raise FormatError("container-root")
    return [{"ord": i, "full_path": r.get("full-path"), "media_type": r.get("media-type")} for i, r in enumerate(root.iter(f"{CONTAINER}rootfile"))]


def rootfiles_to_xml(files: list[dict]) -> str:
    root = ET.Element("container", {"version": "1.0", "xmlns": CONTAINER[1:-1]})
    held = ET.SubElement(root, "rootfiles")
    for f in files:
        ET.SubElement(held, "rootfile", {"full-path": f["full_path"] or "", "media-type": f["media_type"] or PACKAGE_TYPE})
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def default_rootfile(files: list[dict]) -> int | None:
    """The first of the package type, else the first."""
    return next((f["ord"] for f in files if (f["media_type"] or "").strip() == PACKAGE_TYPE), 0 if files else None)


def _text(e: ET.Element) -> str | None:
    return "".join(e.itertext()).strip() or None


def parse_package(data: bytes) -> dict:
    """Metadata, manifest, spine, guide and collections of a package document."""
    root = root_of(data)
    if root.tag != f"{OPF}package":
        raise FormatError("package-root")
    if len(root.findall(f"{OPF}spine")) > 1:
        raise FormatError("repeated-spine")
    elements, metas, legacy, links = [], [], [], []
    for block in root.findall(f"{OPF}metadata"):
        inner = [c for x in block for c in (x if x.tag in (f"{OPF}dc-metadata", f"{OPF}x-metadata") else [x])]
        for e in inner:
            common = {"id": e.get("id"), "dir": e.get("dir"), "xml_lang": e.get(f"{XML}lang")}
            if e.tag.startswith(DC):
                kind = e.tag[len(DC) :].lower()
                elements.append({"ord": len(elements), "kind": kind, **common, "content": _text(e), "scheme": e.get(f"{OPF}scheme"), "role": e.get(f"{OPF}role"), "file_as": e.get(f"{OPF}file-as")})
            elif e.tag == f"{OPF}meta" and e.get("property") is not None:
                metas.append({"ord": len(metas), **common, "property": e.get("property"), "refines": e.get("refines"), "scheme": e.get("scheme"), "content": _text(e)})
            elif e.tag == f"{OPF}meta":
                legacy.append({"ord": len(legacy), "name": e.get("name"), "content": e.get("content")})
            elif e.tag == f"{OPF}link":
                links.append({"ord": len(links), "id": e.get("id"), "href": e.get("href"), "rel": e.get("rel"), "refines": e.get("refines"), "media_type": e.get("media-type"), "properties": (e.get("properties") or "").split()})
    items = [
        {"ord": i, "id": e.get("id"), "href": e.get("href"), "media_type": e.get("media-type"), "properties": (e.get("properties") or "").split(), "fallback": e.get("fallback"), "media_overlay": e.get("media-overlay")}
        for i, e in enumerate(x for m in root.findall(f"{OPF}manifest") for x in m.findall(f"{OPF}item"))
    ]
    spine = root.find(f"{OPF}spine")
    refs = [{"ord": i, "id": e.get("id"), "idref": e.get("idref"), "linear": e.get("linear"), "properties": (e.get("properties") or "").split()} for i, e in enumerate(spine.findall(f"{OPF}itemref") if spine is not None else [])]
    guide = [{"ord": i, "type": e.get("type"), "title": e.get("title"), "href": e.get("href")} for i, e in enumerate(x for g in root.findall(f"{OPF}guide") for x in g.findall(f"{OPF}reference"))]
    collections, stack = [], [(e, (i,)) for i, e in reversed(list(enumerate(root.findall(f"{OPF}collection"))))]
    while stack:
        e, path = stack.pop()
        if len(path) > DEPTH:
            raise FormatError("collection-depth")
        collections.append({"path": list(path), "role": e.get("role"), "links": [x.get("href") for x in [*e.findall(f"{OPF}link"), *e.findall(f"{OPF}metadata/{OPF}link")]]})
        stack += [(c, (*path, i)) for i, c in reversed(list(enumerate(e.findall(f"{OPF}collection"))))]
    return {
        "version": root.get("version"),
        "unique_identifier": root.get("unique-identifier"),
        "prefix": root.get("prefix"),
        "toc": spine.get("toc") if spine is not None else None,
        "progression": spine.get("page-progression-direction") if spine is not None else None,
        "elements": elements,
        "metas": metas,
        "opf2_metas": legacy,
        "links": links,
        "items": items,
        "itemrefs": refs,
        "guide": guide,
        "collections": collections,
    }


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1] if isinstance(e.tag, str) else ""


def parse_nav(data: bytes) -> list[dict]:
    """Lists of a navigation document; points as flat rows with their path."""
    out = []
    for nav in (e for e in root_of(data).iter() if _local(e) == "nav"):
        heading = next((_text(e) for e in nav if re.fullmatch("h[1-6]|hgroup", _local(e))), None)
        types = (nav.get(f"{OPS}type") or "").split()
        semantic = next((t for t in types if t in ("toc", "page-list", "landmarks")), types[0] if types else None)
        points: list[dict] = []
        top = next((e for e in nav if _local(e) == "ol"), None)
        stack = [(top, ())] if top is not None else []
        while stack:
            ol, path = stack.pop()
            if len(path) >= DEPTH:
                raise FormatError("navigation-depth")
            for i, li in enumerate(e for e in ol if _local(e) == "li"):
                anchor = next((e for e in li if _local(e) in ("a", "span")), None)
                points.append({"point_path": [*path, i], "label": " ".join("".join(anchor.itertext()).split()) if anchor is not None else None, "authored_href": anchor.get("href") if anchor is not None else None, "semantic": next(iter((anchor.get(f"{OPS}type") or "").split()), None) if anchor is not None else None, "hidden": li.get("hidden") is not None})
                stack += [(e, (*path, i)) for e in li if _local(e) == "ol"]
        out.append({"list_index": len(out), "semantic": semantic, "heading": heading, "hidden": nav.get("hidden") is not None, "points": sorted(points, key=lambda p: p["point_path"])})
    return out


def parse_ncx(data: bytes) -> list[dict]:
    """Map, page list and lists of an NCX document in the shape of ``parse_nav``."""
    root, out = root_of(data), []
    for holder, child, semantic in (("navMap", "navPoint", "toc"), ("pageList", "pageTarget", "page-list"), ("navList", "navTarget", None)):
        for top in root.findall(f"{NCX}{holder}"):
            points: list[dict] = []
            stack = [(top, ())]
            while stack:
                e, path = stack.pop()
                if len(path) > DEPTH:
                    raise FormatError("navigation-depth")
                for i, p in enumerate(e.findall(f"{NCX}{child}")):
                    label, content = p.find(f"{NCX}navLabel/{NCX}text"), p.find(f"{NCX}content")
                    points.append({"point_path": [*path, i], "label": " ".join((label.text or "").split()) if label is not None else None, "authored_href": content.get("src") if content is not None else None, "semantic": p.get("class"), "hidden": False})
                    stack.append((p, (*path, i)))
            out.append({"list_index": len(out), "semantic": semantic or top.get("class"), "heading": None, "hidden": False, "points": sorted(points, key=lambda p: p["point_path"])})
    return out


def clock_ms(value: str | None) -> int | None:
    """Milliseconds of a media clock value; digits beyond three are dropped."""
    v = (value or "").strip()
    if m := re.fullmatch(r"(?:(\d+):)?([0-5]\d):([0-5]\d)(?:\.(\d+))?", v):
        return (int(m[1] or 0) * 60 + int(m[2])) * 60_000 + int(m[3]) * 1000 + int(((m[4] or "") + "000")[:3])
    if m := re.fullmatch(r"(\d+)(?:\.(\d+))?(h|min|s|ms)?", v):
        return (int(m[1]) * 1000 + int(((m[2] or "") + "000")[:3])) * {"h": 3_600_000, "min": 60_000, "ms": 1, "s": 1000, None: 1000}[m[3]] // 1000
    return None


def parse_smil(data: bytes, max_nodes: int = 100_000, max_depth: int = 256) -> list[dict]:
    """Nodes of a media overlay in document order with their parents."""
    root = root_of(data)
    body = root.find(f"{SMIL}body")
    if root.tag != f"{SMIL}smil" or body is None:
        raise FormatError("smil-root")
    out: list[dict] = []
    stack: list[tuple[ET.Element, int | None, int]] = [(body, None, 1)]
    while stack:
        e, parent, depth = stack.pop()
        if len(out) >= max_nodes or depth > max_depth:
            raise FormatError("smil-nodes" if len(out) >= max_nodes else "smil-depth")
        kind = _local(e)
        if kind not in ("body", "seq", "par"):
            raise FormatError(f"smil-element: {kind}")
        text, audio = e.find(f"{SMIL}text"), e.find(f"{SMIL}audio")
        if kind == "par" and text is None:
            raise FormatError("par-without-text")
        clip = lambda x, n: clock_ms(x.get(n)) if x is not None else None
        out.append({"node_id": len(out), "parent_id": parent, "kind": kind, "epub_types": (e.get(f"{OPS}type") or "").split(), "text_ref": e.get(f"{OPS}textref") if kind != "par" else text.get("src"), "audio_src": audio.get("src") if audio is not None else None, "clip_begin": clip(audio, "clipBegin"), "clip_end": clip(audio, "clipEnd")})
        me = out[-1]["node_id"]
        stack += [(c, me, depth + 1) for c in reversed(list(e)) if _local(c) in ("seq", "par")]
    return out


def obfuscations(data: bytes) -> list[dict]:
    """Entries of the encryption document that use a known font obfuscation: path and algorithm."""
    out = []
    for e in root_of(data).iter(f"{ENC}EncryptedData"):
        method, uri = e.find(f"{ENC}EncryptionMethod"), e.find(f".//{ENC}CipherReference")
        known = OBFUSCATION.get(method.get("Algorithm") if method is not None else None)
        if known and uri is not None:
            out.append({"path": uri.get("URI"), "algorithm": known[0], "length": known[1]})
    return out


def deobfuscate(data: bytes, algorithm: str, identifier: str) -> bytes:
    """Exclusive or of the first bytes with the key of the identifier; the operation is its own inverse."""
    if algorithm == "idpf":
        key, length = hashlib.sha1(re.sub(r"[ \t\r\n]", "", identifier).encode()).digest(), 1040
    else:
        digits = re.sub(r"[^0-9a-fA-F]", "", identifier.removeprefix("urn:uuid:"))
        if len(digits) != 32:
            raise FormatError("obfuscation-key")
        key, length = bytes.fromhex(digits), 1024
    head = data[:length]
    return bytes(b ^ key[i % len(key)] for i, b in enumerate(head)) + data[length:]


def package_to_xml(p: dict) -> str:
    """A package document from its parts, normalised."""
    ET.register_namespace("dc", DC[1:-1])
    ET.register_namespace("", OPF[1:-1])
    kept = lambda d: {k: v for k, v in d.items() if v is not None}
    root = ET.Element(f"{OPF}package", kept({"version": p["version"], "unique-identifier": p["unique_identifier"], "prefix": p["prefix"]}))
    meta = ET.SubElement(root, f"{OPF}metadata")
    for e in p["elements"]:
        ET.SubElement(meta, f"{DC}{e['kind']}", kept({"id": e["id"], "dir": e["dir"], f"{XML}lang": e["xml_lang"]})).text = e["content"]
    for m in p["metas"]:
        ET.SubElement(meta, f"{OPF}meta", kept({"id": m["id"], "property": m["property"], "refines": m["refines"], "scheme": m["scheme"]})).text = m["content"]
    for m in p["opf2_metas"]:
        ET.SubElement(meta, f"{OPF}meta", kept(dict(m, ord=None)))
    for x in p["links"]:
        ET.SubElement(meta, f"{OPF}link", kept({"id": x["id"], "href": x["href"], "rel": x["rel"], "refines": x["refines"], "media-type": x["media_type"], "properties": " ".join(x["properties"]) or None}))
    manifest = ET.SubElement(root, f"{OPF}manifest")
    for i in p["items"]:
        ET.SubElement(manifest, f"{OPF}item", kept({"id": i["id"], "href": i["href"], "media-type": i["media_type"], "properties": " ".join(i["properties"]) or None, "fallback": i["fallback"], "media-overlay": i["media_overlay"]}))
    spine = ET.SubElement(root, f"{OPF}spine", kept({"toc": p["toc"], "page-progression-direction": p["progression"]}))
    for r in p["itemrefs"]:
        ET.SubElement(spine, f"{OPF}itemref", kept({"id": r["id"], "idref": r["idref"], "linear": r["linear"], "properties": " ".join(r["properties"]) or None}))
    if p["guide"]:
        guide = ET.SubElement(root, f"{OPF}guide")
        for g in p["guide"]:
            ET.SubElement(guide, f"{OPF}reference", kept({"type": g["type"], "title": g["title"], "href": g["href"]}))
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")


def nav_to_xhtml(lists: list[dict], title: str) -> str:
    """A navigation document from lists in the shape of ``parse_nav``."""
    ET.register_namespace("epub", OPS[1:-1])
    html = ET.Element("html", {"xmlns": XHTML[1:-1]})
    ET.SubElement(ET.SubElement(html, "head"), "title").text = title
    body = ET.SubElement(html, "body")
    for n in lists:
        nav = ET.SubElement(body, "nav", ({f"{OPS}type": n["semantic"]} if n["semantic"] else {}) | ({"hidden": "hidden"} if n["hidden"] else {}))
        if n["heading"]:
            ET.SubElement(nav, "h2").text = n["heading"]
        held: dict[tuple, ET.Element] = {(): nav}
        lists_: dict[tuple, ET.Element] = {}
        for p in sorted(n["points"], key=lambda p: p["point_path"]):
            path = tuple(p["point_path"])
            parent = path[:-1]
            if parent not in lists_:
                lists_[parent] = ET.SubElement(held[parent], "ol")
            held[path] = ET.SubElement(lists_[parent], "li")
            label = ET.SubElement(held[path], "a" if p["authored_href"] is not None else "span", {"href": p["authored_href"]} if p["authored_href"] is not None else {})
            label.text = p["label"]
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(html, encoding="unicode")


def rendition(files: list[dict], index: int) -> tuple[str | None, str]:
    """(path, verdict) of a rootfile: none, out of bounds, missing, invalid or canonical."""
    if not files:
        return None, "none"
    if not 0 <= index < len(files):
        return None, "out-of-bounds"
    path = files[index]["full_path"]
    if path is None:
        return None, "missing"
    bad = not path or path.startswith("/") or re.search(r"[\\?#\x00-\x1f\x7f]|//|/$|(^|/)\.\.?(/|$)", path) or ":" in path.split("/")[0]
    return (None, "invalid") if bad else (path, "canonical")


def smil_to_xml(nodes: list[dict]) -> str:
    """A media overlay from nodes in the shape of ``parse_smil``."""
    ET.register_namespace("epub", OPS[1:-1])
    root = ET.Element(f"{SMIL}smil", {"version": "3.0"})
    held: dict[int | None, ET.Element] = {None: root}
    clock = lambda ms: f"{ms // 1000}.{ms % 1000:03}s"
    for n in nodes:
        attrs = {f"{OPS}type": " ".join(n["epub_types"])} if n["epub_types"] else {}
        if n["kind"] != "par" and n["text_ref"]:
            attrs[f"{OPS}textref"] = n["text_ref"]
        e = held[n["node_id"]] = ET.SubElement(held[n["parent_id"]], f"{SMIL}{n['kind']}", attrs)
        if n["kind"] == "par":
            ET.SubElement(e, f"{SMIL}text", {"src": n["text_ref"]})
            if n["audio_src"] is not None:
                clips = {k: clock(n[f]) for k, f in (("clipBegin", "clip_begin"), ("clipEnd", "clip_end")) if n[f] is not None}
                ET.SubElement(e, f"{SMIL}audio", {"src": n["audio_src"]} | clips)
    return '<?xml version="1.0" encoding="UTF-8"?>\n' + ET.tostring(root, encoding="unicode")
