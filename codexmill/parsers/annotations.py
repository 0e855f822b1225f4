"""Annotation sets and bundles: tolerant reading, edits by identifier, archives, and what a selector needs of its host."""

from __future__ import annotations

import copy
import io
import json
import re
import zipfile
from urllib.parse import unquote_to_bytes

# Names, limits and types of the format.
JSON_NAME = "annotations.json"
MAX_ENTRIES, MAX_JSON, MAX_RESOURCE, MAX_TOTAL, MAX_DEPTH = 65_536, 64 << 20, 256 << 20, 1 << 30, 128
AUDIOVISUAL = ("Audio", "Video")
HTML_FRAGMENT = "http://tools.ietf.org/rfc/rfc3236"
TEXT_FRAGMENT = "https://wicg.github.io/scroll-to-text-fragment/"
#: What a host must offer, from less to more.
NEEDS = ("dom", "rendered-text")


class AnnotationError(ValueError):
    """An annotation or bundle is refused; the message names the rule."""


def _list(value) -> list:
    return value if isinstance(value, list) else [] if value is None else [value]


def parse_set(text: str | bytes) -> dict:
    """An annotation set; unknown members stay as they are."""
    try:
        root = json.loads(text)
    except ValueError as e:
        raise AnnotationError("json") from e
    if not isinstance(root, dict):
        raise AnnotationError("root")
    return root


def valid_id(value) -> bool:
    """An absolute address."""
    return isinstance(value, str) and re.match(r"[A-Za-z][A-Za-z0-9+.-]*:\S", value) is not None


def _position(s: dict, id_: str) -> int:
    hits = [i for i, a in enumerate(_list(s.get("items"))) if isinstance(a, dict) and a.get("id") == id_]
    if len(hits) != 1:
        raise AnnotationError("no such annotation" if not hits else "ambiguous annotation")
    return hits[0]


def add(s: dict, annotation: dict) -> dict:
    """The set with the annotation; its identifier must be absolute and new."""
    if not valid_id(annotation.get("id")):
        raise AnnotationError("id")
    out = copy.deepcopy(s)
    out["items"] = _list(out.get("items"))
    if any(isinstance(a, dict) and a.get("id") == annotation["id"] for a in out["items"]):
        raise AnnotationError("id is taken")
    out["items"].append(annotation)
    return out


def replace(s: dict, annotation: dict) -> dict:
    out = copy.deepcopy(s)
    out["items"] = _list(out.get("items"))
    out["items"][_position(s, annotation.get("id"))] = annotation
    return out


def remove(s: dict, id_: str) -> dict:
    out = copy.deepcopy(s)
    out["items"] = _list(out.get("items"))
    del out["items"][_position(s, id_)]
    return out


def resource_path(path) -> str | None:
    """The canonical path of a bundled resource, null where it is not safe."""
    if not isinstance(path, str) or not path or path.startswith("/") or "\\" in path or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|//|#|\?", path):
        return None
    out: list[str] = []
    for raw in re.split(r"[?#]", path)[0].split("/"):
        try:
            segment = unquote_to_bytes(raw).decode()
        except UnicodeDecodeError:
            return None
        if segment == "" or re.search(r"[/\\\x00-\x1f]", segment):
            return None
        if segment == "..":
            if not out:
                return None
            out.pop()
        elif segment != ".":
            out.append(segment)
    return "/".join(out) or None


def referenced_paths(s: dict) -> set[str]:
    """Resources that audiovisual bodies name."""
    bodies = (b for a in _list(s.get("items")) if isinstance(a, dict) for b in _list(a.get("body")) if isinstance(b, dict))
    return {p for b in bodies if b.get("type") in AUDIOVISUAL and (p := resource_path(b.get("id") or b.get("source")))}


def validate_bundle(s: dict, resources: dict[str, bytes]) -> None:
    """Limits, reserved and unsafe paths, and that exactly the referenced resources are there."""
    if len(resources) + 1 > MAX_ENTRIES:
        raise AnnotationError("entries")
    text = json.dumps(s).encode()
    if len(text) > MAX_JSON or any(len(b) > MAX_RESOURCE for b in resources.values()) or len(text) + sum(map(len, resources.values())) > MAX_TOTAL:
        raise AnnotationError("size")
    for path in resources:
        if path == JSON_NAME:
            raise AnnotationError("reserved path")
        if resource_path(path) != path:
            raise AnnotationError("unsafe path")
    wanted = referenced_paths(s)
    for what, missing in (("missing resource", wanted - set(resources)), ("unreferenced resource", set(resources) - wanted)):
        if missing:
            raise AnnotationError(f"{what}: {min(missing)}")


def change(s: dict, resources: dict[str, bytes], new: dict, supplied: dict[str, bytes]) -> tuple[dict, dict[str, bytes]]:
    """The bundle with the set ``new``: resources that it no longer names go, supplied ones replace."""
    wanted = referenced_paths(new)
    if loose := set(supplied) - wanted:
        raise AnnotationError(f"unreferenced resource: {min(loose)}")
    kept = {p: b for p, b in resources.items() if p in wanted} | supplied
    validate_bundle(new, kept)
    return new, kept


def read_archive(data: bytes) -> tuple[dict, dict[str, bytes]]:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            infos = [i for i in z.infolist() if not i.is_dir()]
            names = [i.filename for i in infos]
            if len(infos) > MAX_ENTRIES or sum(i.file_size for i in infos) > MAX_TOTAL or any(i.file_size > MAX_RESOURCE for i in infos):
                raise AnnotationError("size")
            if len(set(names)) < len(names):
                raise AnnotationError("duplicate path")
            if JSON_NAME not in names:
                raise AnnotationError("no annotations")
            s, resources = parse_set(z.read(JSON_NAME)), {n: z.read(n) for n in names if n != JSON_NAME}
    except zipfile.BadZipFile as e:
        raise AnnotationError("archive") from e
    validate_bundle(s, resources)
    return s, resources


def write_archive(s: dict, resources: dict[str, bytes]) -> bytes:
    validate_bundle(s, resources)
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in [(JSON_NAME, json.dumps(s, ensure_ascii=False).encode()), *sorted(resources.items())]:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED)
    return held.getvalue()


def decoded_fragment(value) -> str | None:
    """The element id that a fragment value names, null where it is malformed."""
    if not isinstance(value, str) or not value.strip() or "#" in value or re.search(r"[\s\\\x00-\x1f]", value) or "%" in re.sub(r"%[0-9A-Fa-f]{2}", "", value):
        return None
    try:
        return unquote_to_bytes(value).decode()
    except UnicodeDecodeError:
        return None


def requirement(selector: dict, source_is: str, depth: int = 0) -> str:
    """What resolving a selector in a source of format ``source_is`` needs: dom, rendered-text, invalid or unsupported.

    Along a branch the greater need counts; of several refinements the branch with the least need is enough.
    """
    if depth > MAX_DEPTH:
        return "invalid"
    kind, value = selector.get("type"), selector.get("value")
    if kind == "FragmentSelector":
        form = selector.get("conformsTo")
        if form not in (None, HTML_FRAGMENT, TEXT_FRAGMENT):
            return "unsupported"
        own = "invalid" if decoded_fragment(value) is None else "unsupported" if source_is != "xhtml" else "rendered-text" if form == TEXT_FRAGMENT else "dom"
    elif kind == "CssSelector":
        own = "invalid" if not isinstance(value, str) or not value.strip() else "dom" if source_is in ("xhtml", "svg") else "unsupported"
    elif kind == "TextPositionSelector":
        start, end = selector.get("start"), selector.get("end")
        fits = all(isinstance(x, int) and not isinstance(x, bool) and x >= 0 for x in (start, end)) and start <= end
        own = "invalid" if not fits else "rendered-text" if source_is == "xhtml" else "unsupported"
    else:
        return "unsupported" if isinstance(kind, str) else "invalid"
    refinements = [r for r in _list(selector.get("refinedBy")) if isinstance(r, dict)]
    if own not in NEEDS or not refinements:
        return own
    found = [requirement(r, source_is, depth + 1) for r in refinements]
    ways = [max(NEEDS.index(own), NEEDS.index(f)) for f in found if f in NEEDS]
    return NEEDS[min(ways)] if ways else "invalid" if "invalid" in found else "unsupported"
