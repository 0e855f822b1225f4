"""References of a style sheet by a token scan: imports, ``url()`` values and font sources."""

from __future__ import annotations

import re

DEPTH = 256
_TOKEN = re.compile(
    r"""(?P<comment>/\*.*?\*/)|(?P<openc>/\*)|(?P<url>url\(\s*(?:"(?P<u1>(?:[^"\\\n]|\\.)*)"|'(?P<u2>(?:[^'\\\n]|\\.)*)'|(?P<u3>[^"'()\s\\]*(?:\\.[^"'()\s\\]*)*))\s*\))
    |(?P<string>"(?P<s1>(?:[^"\\\n]|\\.)*)"|'(?P<s2>(?:[^'\\\n]|\\.)*)')|(?P<badstr>["'])|(?P<at>@[A-Za-z-]+)|(?P<word>-{0,2}[A-Za-z_][\w-]*)|(?P<punct>[{}()\[\];:,])|(?P<other>.)""",
    re.S | re.X,
)


def _plain(text: str) -> str:
    return re.sub(r"\\([0-9A-Fa-f]{1,6}\s?|.)", lambda m: chr(int(m[1], 16)) if re.match(r"[0-9A-Fa-f]", m[1]) else m[1], text)


def decode_css(data: bytes) -> str | None:
    """UTF-8, or UTF-16 with a byte order mark; null where that fails."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            data, encoding = data[len(mark) :], name
            break
    else:
        encoding = "utf-8"
    try:
        return data.decode(encoding)
    except UnicodeDecodeError:
        return None


def parse_css(text: str) -> tuple[list[dict], bool]:
    """References (ord, role, at_rule, property, declared) and whether the sheet is well formed; a malformed one gives what was read."""
    out: list[dict] = []
    whole, at_rule, prop = True, None, None
    blocks: list[str | None] = []
    depth, pending_import, fresh = 0, False, True
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup not in ("u1", "u2", "u3", "s1", "s2") else None
        kind = kind or ("url" if m["url"] else "string")
        if kind in ("openc", "badstr"):
            return out, False
        if kind == "at":
            at_rule, prop, pending_import = m["at"][1:].lower(), None, m["at"].lower() == "@import"
        elif kind == "url" or (kind == "string" and pending_import):
            value = next(g for g in (m["u1"], m["u2"], m["u3"], m["s1"], m["s2"]) if g is not None)
            holder = blocks[-1] if blocks else at_rule
            role = "import" if pending_import else "font" if holder == "font-face" and prop == "src" else "css"
            out.append({"ord": len(out), "role": role, "at_rule": "import" if pending_import else holder, "property": prop, "declared": _plain(value)})
            pending_import = False
        elif kind == "punct":
            c = m["punct"]
            if c == "{":
                blocks.append(at_rule)
                if len(blocks) > DEPTH:
                    return out, False
                at_rule, prop = None, None
            elif c == "}":
                if not blocks:
                    whole = False
                else:
                    blocks.pop()
                at_rule, prop = None, None
            elif c == ";":
                at_rule, prop, pending_import = None, None, False
            elif c in "([":
                depth += 1
            elif c in ")]":
                depth -= 1
        elif kind == "word" and blocks and prop is None and re.match(r"\s*:", text[m.end() :]):
            prop = m["word"].lower()
        fresh = False
    return out, whole and not blocks and depth == 0 and not fresh or (whole and not text.strip())


def functional_iris(value: str) -> list[str]:
    """All addresses in ``url()`` of an attribute value."""
    return [_plain(next(g for g in m.group("u1", "u2", "u3") if g is not None)) for m in _TOKEN.finditer(value) if m["url"]]


# Prefixed properties with their standard name and keywords; a keyword without a match is left out.
PREFIXED = {
    "-epub-hyphens": ("hyphens", {"all": None}, False),
    "-epub-line-break": ("line-break", {}, False),
    "-epub-text-align-last": ("text-align-last", {}, False),
    "-epub-text-combine": ("text-combine-upright", {"none": "none", "horizontal": "all"}, True),
    "-epub-text-combine-horizontal": ("text-combine-upright", {"none": "none", "all": "all"}, True),
    "-epub-text-emphasis-color": ("text-emphasis-color", {}, False),
    "-epub-text-emphasis-position": ("text-emphasis-position", {}, False),
    "-epub-text-emphasis-style": ("text-emphasis-style", {}, False),
    "-epub-text-orientation": ("text-orientation", {"vertical-right": "mixed", "rotate-right": "sideways", "rotate-normal": "sideways"}, False),
    "-epub-text-underline-position": ("text-underline-position", {"alphabetic": "auto"}, False),
    "-epub-word-break": ("word-break", {}, False),
    "-epub-writing-mode": ("writing-mode", {}, False),
}


def _restated(name: str, value: str) -> str | None:
    """The standard declaration of a prefixed one."""
    body = re.sub(r"\s*!\s*important\s*$", "", value, flags=re.I)
    tail, body = " !important" if body != value else "", body.strip()
    if name == "text-transform":
        changed = re.sub(r"(?i)(?<!\S)-epub-fullwidth(?!\S)", "full-width", body)
        return f"text-transform: {changed}{tail}" if changed != body else None
    if name not in PREFIXED or not body:
        return None
    target, keywords, closed = PREFIXED[name]
    mapped = keywords.get(body.lower(), None if closed else body)
    return f"{target}: {mapped}{tail}" if mapped is not None else None


def rewrite_declarations(block: str) -> str:
    """Each prefixed declaration followed by its standard one; what cannot be read for certain stays as authored."""
    out, at, depth, name, value_at = [], 0, 0, None, 0

    def end(stop: int) -> None:
        nonlocal at
        if name is None:
            return
        value = block[value_at:stop].rstrip()
        new = _restated(name, value)
        if new and not block[value_at + len(value) :].startswith(f";{new}"):
            out.append(block[at : value_at + len(value)] + ";" + new)
            at = value_at + len(value)

    for m in _TOKEN.finditer(block):
        c = m["punct"]
        depth += (c is not None and c in "([") - (c is not None and c in ")]") + (m["other"] == "(") - (m["other"] == ")")
        if depth == 0 and c == ";":
            end(m.start())
            name = None
        elif name is None and m["word"] and re.match(r"\s*:", block[m.end() :]):
            name, value_at = m["word"].lower(), m.end() + re.match(r"\s*:", block[m.end() :]).end()
    end(len(block))
    return "".join(out) + block[at:]


def rewrite_stylesheet(text: str) -> str:
    """``rewrite_declarations`` on every innermost block of a sheet."""
    out, at, opened = [], 0, None
    for m in _TOKEN.finditer(text):
        if m["punct"] == "{":
            opened = m.end()
        elif m["punct"] == "}" and opened is not None:
            out.append(text[at:opened] + rewrite_declarations(text[opened : m.start()]))
            at, opened = m.start(), None
    return "".join(out) + text[at:]
