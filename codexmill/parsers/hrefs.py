"""Hrefs below chains of authored bases, which a column expression cannot follow to any length."""

from __future__ import annotations

import re
from urllib.parse import unquote_to_bytes


def _onto(path: str, href: str) -> str | None:
    """The local path that a relative href means in the document ``path``; null if it is not local or leaves the root."""
    href = href.replace(" ", "%20") if href.strip() == href else href
    if href == "" or re.search(r"[\s\\\x00-\x1f]", href) or "%" in re.sub(r"%[0-9A-Fa-f]{2}", "", href) or re.match(r"[A-Za-z][A-Za-z0-9+.-]*:|/", href) or re.search(r"(?i)%2f|%5c", href):
        return None
    own = re.split(r"[?#]", href)[0]
    try:
        own = unquote_to_bytes(own).decode()
    except UnicodeDecodeError:
        return None
    if own == "":
        return path
    out = path.split("/")[:-1]
    for segment in own.split("/"):
        if segment == "..":
            if not out:
                return None
            out.pop()
        elif segment not in ("", "."):
            out.append(segment)
    return "/".join(out) + ("/" if own.endswith("/") else "")


def below_bases(source: str, bases: list[str]) -> str | None:
    """What relative hrefs stand on in the document ``source``; null if a base is not local."""
    at: str | None = source
    for base in bases:
        at = _onto(at, base) if at is not None else None
    return at


def resolve_with_bases(source: str, bases: list[str], href: str) -> str | None:
    """Path of an href below relative bases, outermost first; a base that ends in a slash names a directory."""
    at = below_bases(source, bases)
    found = _onto(at, href) if at is not None else None
    return found.rstrip("/") or None if found is not None else None
