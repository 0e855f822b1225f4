"""Facts of an SVG document: text, fragments, links, scripts, animation and embedded style, namespace-aware."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from codexmill.parsers.css import functional_iris, parse_css
from codexmill.parsers.xhtml import ANIMATIONS, EVENT_HANDLERS, executable_type, parse_xhtml
from codexmill.parsers.xmlparts import FormatError, decode_xml

# Namespaces, elements that may carry an address, attributes scanned for functional addresses.
SVG = "{http://www.w3.org/2000/svg}"
XLINK = "{http://www.w3.org/1999/xlink}"
XHTML = "{http://www.w3.org/1999/xhtml}"
XML_BASE = "{http://www.w3.org/XML/1998/namespace}base"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"
HREF_ELEMENTS = frozenset(("a", "animate", "animateMotion", "animateTransform", "discard", "feImage", "image", "linearGradient", "mpath", "pattern", "radialGradient", "script", "set", "textPath", "use"))
IRI_ATTRIBUTES = frozenset(("clip-path", "color-profile", "cursor", "fill", "filter", "marker", "marker-end", "marker-mid", "marker-start", "mask", "stroke"))
ROLES = {"a": "hyperlink", "image": "image", "feImage": "image", "script": "script"}


def parse_svg(data: bytes) -> dict:
    try:
        root = ET.fromstring(re.sub(r"^\s*<\?xml[^>]*\?>", "", decode_xml(data)))
    except ET.ParseError as e:
        raise FormatError(f"xml: {e}") from e
    if root.tag != f"{SVG}svg":
        raise FormatError("svg-root")
    out: dict = {"width": root.get("width"), "height": root.get("height"), "view_box": root.get("viewBox"), "text": [], "fragments": [], "links": [], "scripts": [], "foreign": [], "activities": set()}
    stack: list[tuple[ET.Element, tuple[str, ...]]] = [(root, ())]
    while stack:
        e, bases = stack.pop()
        if not isinstance(e.tag, str):
            continue
        if e.get(XML_BASE):
            bases = (*bases, e.get(XML_BASE))
        if e.tag.startswith(XHTML):
            facts = parse_xhtml("<body>" + re.sub(r"(</?)html:", r"\1", ET.tostring(e, encoding="unicode")) + "</body>")
            out["foreign"].append({"ord": len(out["foreign"]), "text": facts.text, "links": facts.links, "bases": list(bases)})
            continue
        if not e.tag.startswith(SVG):
            continue
        name = e.tag[len(SVG) :]
        link = lambda attr, role, value, bases=bases, name=name: out["links"].append({"ord": len(out["links"]), "element": name, "attribute": attr, "role": role, "declared": value, "bases": list(bases)})
        for key in ("id", XML_ID):
            if e.get(key):
                out["fragments"].append({"ord": len(out["fragments"]), "id": e.get(key), "element": name})
        href = e.get("href", e.get(f"{XLINK}href"))
        if href is not None and name in HREF_ELEMENTS and not (name == "script" and not executable_type(e.get("type"))):
            link("href", ROLES.get(name, "svg"), href)
        for key, value in e.attrib.items():
            if key in IRI_ATTRIBUTES or key == "style":
                for iri in functional_iris(value):
                    link(key, "svg" if key != "style" else "css", iri)
            if key in EVENT_HANDLERS:
                out["activities"].add("event-attribute")
                out["scripts"].append({"ord": len(out["scripts"]), "kind": "event-handler", "attribute": key, "has_text": bool(value)})
        if name == "script":
            out["activities"].add("script-element")
            kind = "data-block" if not executable_type(e.get("type")) else "external" if href is not None else "inline"
            out["scripts"].append({"ord": len(out["scripts"]), "kind": kind, "attribute": None, "has_text": bool((e.text or "").strip())})
        if name == "style":
            for r in parse_css("".join(e.itertext()))[0]:
                link("style", r["role"], r["declared"])
        if name.lower() in ANIMATIONS:
            out["activities"].add("animation")
        if name in ("text", "title", "desc"):
            out["text"].append({"ord": len(out["text"]), "element": name, "text": " ".join("".join(e.itertext()).split())})
        stack += [(c, bases) for c in reversed(list(e))]
    return out
