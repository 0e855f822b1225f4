"""Fragment locators: parsing, display and resolution in one document."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

_SPECIAL = "^[](),;="


class LocatorError(ValueError):
    """A locator breaks its grammar or names nothing."""


@dataclass
class Step:
    number: int
    assertion: str | None = None
    indirect: bool = False  # reached through "!"


@dataclass
class Path:
    steps: list[Step] = field(default_factory=list)
    offset: int | None = None
    temporal: float | None = None
    spatial: tuple[float, float] | None = None
    text: tuple[str | None, str | None] | None = None
    side: str | None = None


@dataclass
class Locator:
    parent: Path
    start: Path | None = None
    end: Path | None = None


def escape(text: str) -> str:
    return "".join("^" + c if c in _SPECIAL else c for c in text)


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def take(self, pattern: str) -> str | None:
        m = re.compile(pattern).match(self.text, self.at)
        if not m:
            return None
        self.at = m.end()
        return m[0]

    def bracket(self) -> str | None:
        """The raw text of an assertion in brackets."""
        if self.peek() != "[":
            return None
        out, self.at = "", self.at + 1
        while True:
            c = self.peek()
            if not c:
                raise LocatorError("open assertion")
            if c == "]":
                self.at += 1
                return out
            if c == "^":
                out += self.text[self.at : self.at + 2]
                self.at += 2
                continue
            out += c
            self.at += 1

    def path(self) -> Path:
        p, indirect = Path(), False
        while self.peek() in ("/", "!") and self.peek():
            if self.take("!"):
                indirect = True
                continue
            self.at += 1
            number = self.take(r"0|[1-9]\d*")
            if number is None:
                raise LocatorError("step")
            raw = self.bracket()
            p.steps.append(Step(int(number), _unescape(raw) if raw is not None else None, indirect))
            indirect = False
        number = r"(?:0|[1-9]\d*)(?:\.\d*[1-9])?"
        if self.take(":"):
            digits = self.take(r"0|[1-9]\d*")
            if digits is None:
                raise LocatorError("offset")
            p.offset = int(digits)
        if self.take("~"):
            p.temporal = self._number(number)
        if self.take("@"):
            x = self._number(number)
            if not self.take(":"):
                raise LocatorError("spatial")
            p.spatial = (x, self._number(number))
        raw = self.bracket()
        if raw is not None:
            body, *params = re.split(r"(?<!\^);", raw)
            for q in params:
                key, _, value = q.partition("=")
                if key == "s" and value in ("a", "b"):
                    p.side = value
            parts = [(_unescape(x) or None) for x in re.split(r"(?<!\^),", body)]
            if len(parts) > 2:
                raise LocatorError("assertion")
            p.text = (parts[0], parts[1] if len(parts) > 1 else None)
        return p

    def _number(self, pattern: str) -> float:
        n = self.take(pattern)
        if n is None:
            raise LocatorError("number")
        return float(n)


def _unescape(text: str) -> str:
    return re.sub(r"\^(.)", r"\1", text)


def parse_cfi(text: str) -> Locator:
    """A point or range locator."""
    m = re.fullmatch(r"epubcfi\((.*)\)", text, re.S)
    if not m:
        raise LocatorError("envelope")
    r = _Reader(m[1])
    parent = r.path()
    if not parent.steps:
        raise LocatorError("empty")
    if r.take(","):
        start = r.path()
        if not r.take(","):
            raise LocatorError("range")
        end = r.path()
        if start.side or end.side or parent.side:
            raise LocatorError("side bias in a range")
        out = Locator(parent, start, end)
    else:
        out = Locator(parent)
    if r.at != len(r.text):
        raise LocatorError(f"unread: {r.text[r.at :]}")
    return out


def _show(p: Path) -> str:
    out = "".join(("!" if s.indirect else "") + f"/{s.number}" + (f"[{escape(s.assertion)}]" if s.assertion is not None else "") for s in p.steps)
    out += f":{p.offset}" if p.offset is not None else ""
    out += f"~{p.temporal:g}" if p.temporal is not None else ""
    out += f"@{p.spatial[0]:g}:{p.spatial[1]:g}" if p.spatial else ""
    if p.text or p.side:
        before, after = p.text or (None, None)
        out += "[" + escape(before or "") + ("," + escape(after) if after else "") + (f";s={p.side}" if p.side else "") + "]"
    return out


def show_cfi(x: Locator) -> str:
    return "epubcfi(" + _show(x.parent) + (f",{_show(x.start)},{_show(x.end)}" if x.start else "") + ")"


def spine_index(x: Locator) -> int:
    """Zero-based occurrence that the package steps name."""
    s = x.parent.steps
    if len(s) < 2 or s[0].number != 6 or s[1].number % 2 or s[1].number < 2:
        raise LocatorError("package steps")
    return s[1].number // 2 - 1


def _chunks(e: ET.Element) -> list[str]:
    """Text chunks before, between and behind the element children."""
    return [e.text or "", *(c.tail or "" for c in e)]


def resolve(document: str, steps: list[Step], offset: int | None) -> tuple[str, int]:
    """(element name, UTF-16 position in all text of the document) of document steps."""
    node = ET.fromstring(document)
    total = 0
    units = lambda t: len(t.encode("utf-16-le")) // 2
    for i, s in enumerate(steps):
        chunks = _chunks(node)
        if s.number % 2:
            k = s.number // 2
            if i != len(steps) - 1 or k >= len(chunks):
                raise LocatorError("text step")
            total += sum(units(chunks[j]) + (units("".join(node[j].itertext())) if j < len(node) else 0) for j in range(k))
            if offset is not None and offset > units(chunks[k]):
                raise LocatorError("offset beyond the text")
            return node.tag.rsplit("}", 1)[-1], total + (offset or 0)
        k = s.number // 2 - 1
        if not 0 <= k < len(node):
            raise LocatorError("element step")
        total += sum(units(chunks[j]) + units("".join(node[j].itertext())) for j in range(k)) + units(chunks[k])
        node = node[k]
        if s.assertion is not None and s.assertion not in (node.get("id"), node.get("{http://www.w3.org/XML/1998/namespace}id")):
            raise LocatorError("id assertion")
    return node.tag.rsplit("}", 1)[-1], total + (offset or 0)


def check_text(document: str, steps: list[Step], offset: int, expected: tuple[str | None, str | None]) -> None:
    """The text assertion of a locator: what stands before and behind its place, white space collapsed."""
    _, at = resolve(document, steps, offset)
    whole = "".join(ET.fromstring(document).itertext()).encode("utf-16-le")
    try:
        before, after = whole[: at * 2].decode("utf-16-le"), whole[at * 2 :].decode("utf-16-le")
    except UnicodeDecodeError as e:
        raise LocatorError("offset splits a character") from e
    flat = lambda t: " ".join(t.split())
    if (expected[0] and not flat(before).endswith(flat(expected[0]))) or (expected[1] and not flat(after).startswith(flat(expected[1]))):
        raise LocatorError("text assertion")


def resolve_range(document: str, x: Locator) -> tuple[int, int]:
    """UTF-16 positions of a range; a reversed one is refused."""
    inside = next((i for i, s in enumerate(x.parent.steps) if s.indirect), len(x.parent.steps))
    base = x.parent.steps[inside:]
    a, b = (resolve(document, base + p.steps, p.offset)[1] for p in (x.start, x.end))
    if a > b:
        raise LocatorError("reversed range")
    return a, b
