"""Facts of one XHTML document in a single pass under HTML tokenizing rules (raw text in scripts, entities in text).

The scanner keeps a stack of open elements; every fact carries an ordinal in document order, spans carry code point
offsets into the normalised text stream at the time they open and close, so nothing is searched for afterwards.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Element and attribute vocabularies.
BLOCKS = frozenset(("address", "article", "aside", "blockquote", "br", "caption", "dd", "div", "dl", "dt", "figcaption", "figure", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
SUPPRESSED = frozenset(("head", "script", "style", "template"))
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
CLOSES_P = BLOCKS - {"br", "caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr"}
BODY_ROLES = frozenset(("p", "li", "blockquote", "dt", "dd", "td", "th", "text"))
SECTION_SEMANTICS = frozenset(("chapter", "cover", "division", "part", "volume", "frontmatter", "bodymatter", "backmatter", "appendix", "bibliography", "glossary", "index", "endnotes", "footnotes", "preamble", "abstract", "acknowledgments", "afterword", "colophon", "conclusion", "copyright-page", "credits", "dedication", "epigraph", "epilogue", "errata", "foreword", "introduction", "preface", "prologue", "titlepage")
)
SECTION_ROLES = frozenset(
    f"doc-{x}" for x in ("chapter", "cover", "part", "appendix", "bibliography", "glossary", "index", "endnotes", "abstract", "acknowledgments", "afterword", "colophon", "conclusion", "credits", "dedication", "epigraph", "epilogue", "errata", "foreword", "introduction", "preface", "prologue")
)
SCRIPT_TYPES = frozenset(("text/javascript", "application/javascript", "application/x-javascript", "text/ecmascript", "application/ecmascript", "application/x-ecmascript", "text/x-javascript", "text/x-ecmascript", "text/livescript", "text/jscript", "text/javascript1.0", "text/javascript1.1", "text/javascript1.2", "text/javascript1.3", "text/javascript1.4", "text/javascript1.5")
)
# Attributes whose text runs as a script.
EVENT_HANDLERS = frozenset(
    (
        "onabort",
        "onactivate",
        "onafterprint",
        "onanimationcancel",
        "onanimationend",
        "onanimationiteration",
        "onanimationstart",
        "onauxclick",
        "onbeforeinput",
        "onbeforematch",
        "onbeforeprint",
        "onbeforetoggle",
        "onbeforeunload",
        "onbegin",
        "onblur",
        "oncancel",
        "oncanplay",
        "oncanplaythrough",
        "onchange",
        "onclick",
        "onclose",
        "oncommand",
        "oncontentvisibilityautostatechange",
        "oncontextlost",
        "oncontextmenu",
        "oncontextrestored",
        "oncopy",
        "oncuechange",
        "oncut",
        "ondblclick",
        "ondrag",
        "ondragend",
        "ondragenter",
        "ondragleave",
        "ondragover",
        "ondragstart",
        "ondrop",
        "ondurationchange",
        "onemptied",
        "onend",
        "onended",
        "onerror",
        "onfocus",
        "onfocusin",
        "onfocusout",
        "onformdata",
        "onfullscreenchange",
        "onfullscreenerror",
        "ongotpointercapture",
        "onhashchange",
        "oninput",
        "oninvalid",
        "onkeydown",
        "onkeypress",
        "onkeyup",
        "onlanguagechange",
        "onload",
        "onloadeddata",
        "onloadedmetadata",
        "onloadstart",
        "onlostpointercapture",
        "onmessage",
        "onmessageerror",
        "onmousedown",
        "onmouseenter",
        "onmouseleave",
        "onmousemove",
        "onmouseout",
        "onmouseover",
        "onmouseup",
        "onoffline",
        "ononline",
        "onpagehide",
        "onpagereveal",
        "onpageshow",
        "onpageswap",
        "onpaste",
        "onpause",
        "onplay",
        "onplaying",
        "onpointercancel",
        "onpointerdown",
        "onpointerenter",
        "onpointerleave",
        "onpointermove",
        "onpointerout",
        "onpointerover",
        "onpointerrawupdate",
        "onpointerup",
        "onpopstate",
        "onprogress",
        "onratechange",
        "onrejectionhandled",
        "onrepeat",
        "onreset",
        "onresize",
        "onscroll",
        "onscrollend",
        "onsecuritypolicyviolation",
        "onseeked",
        "onseeking",
        "onselect",
        "onselectionchange",
        "onselectstart",
        "onslotchange",
        "onstalled",
        "onstorage",
        "onsubmit",
        "onsuspend",
        "ontimeupdate",
        "ontoggle",
        "ontransitioncancel",
        "ontransitionend",
        "ontransitionrun",
        "ontransitionstart",
        "onunhandledrejection",
        "onunload",
        "onvolumechange",
        "onwaiting",
        "onwheel",
        "onzoom",
    )
)
ANIMATIONS = frozenset(("animate", "animatecolor", "animatemotion", "animatetransform", "discard", "set"))
HINTS = frozenset(("dns-prefetch", "preconnect", "preload", "prefetch", "modulepreload", "prerender"))
NAV_KINDS = {"toc": "toc", "page-list": "page-list", "landmarks": "landmark"}
#: element: (attribute, link role); what depends on other attributes is decided in ``_links``
LINK_RULES = {
    "a": (("href", "hyperlink"),),
    "area": (("href", "hyperlink"),),
    "form": (("action", "form-action"),),
    "img": (("src", "image"), ("srcset", "image")),
    "script": (("src", "script"),),
    "audio": (("src", "audio"),),
    "video": (("src", "video"), ("poster", "poster")),
    "track": (("src", "track"),),
    "iframe": (("src", "iframe"),),
    "object": (("data", "object"),),
    "embed": (("src", "embed"),),
}
_SPACES = " \t\n\f\r"
_FLOAT = re.compile(r"^-?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?$")


def executable_type(value: str | None) -> bool:
    """Whether a script of this type runs."""
    bare = (value or "").strip().lower()
    return bare in ("", "module") or bare.split(";")[0].strip() in SCRIPT_TYPES


def srcset(value: str) -> list[str]:
    """The addresses of a source set whose descriptors are valid."""
    out, rest = [], value
    while rest := rest.lstrip(_SPACES + ","):
        url = re.match(rf"[^{_SPACES}]+", rest)[0]
        rest = rest[len(url) :]
        if url.endswith(","):
            if url.rstrip(","):
                out.append(url.rstrip(","))
            continue
        depth = at = 0
        while at < len(rest) and (rest[at] != "," or depth):
            depth = max(0, depth + (rest[at] == "(") - (rest[at] == ")"))
            at += 1
        if _descriptors_ok(rest[:at].split()):
            out.append(url)
        rest = rest[at + 1 :]
    return out


def _descriptors_ok(words: list[str]) -> bool:
    seen = set()
    for word in words:
        number, unit = word[:-1], word[-1]
        if unit in seen or unit not in "wxh":
            return False
        if unit == "x":
            ok = not seen and bool(_FLOAT.match(number)) and float(number) > 0
        else:
            ok = "x" not in seen and number.isascii() and number.isdigit() and int(number) > 0
        if not ok:
            return False
        seen.add(unit)
    return "h" not in seen or "w" in seen


def viewport(content: str) -> list[tuple[str, str]]:
    """Directives (name, value) of a viewport meta as authored; white space, commas and semicolons part them, and an equals sign takes space around it."""
    return [(m[1], m[2] or "") for m in re.finditer(r"([^\s,;=]+)(?:\s*=\s*([^\s,;=]*))?", content)]


@dataclass
class Facts:
    text: str = ""
    base: str | None = None
    spans: list[dict] = field(default_factory=list)
    fragments: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    structure: list[dict] = field(default_factory=list)
    media: list[dict] = field(default_factory=list)
    forms: list[dict] = field(default_factory=list)
    scripts: list[dict] = field(default_factory=list)
    viewports: list[dict] = field(default_factory=list)
    accessibility: list[dict] = field(default_factory=list)
    supplementary: list[dict] = field(default_factory=list)
    activities: set[str] = field(default_factory=set)


@dataclass
class _Open:
    name: str
    ordinal: int
    span: dict | None
    lang: str | None
    dir: str | None
    nav: str | None = None
    links_seen: int = 0
    structure: list[dict] = field(default_factory=list)
    script: dict | None = None


class Scanner(HTMLParser):
    """Collects ``Facts``; feed the text, then call ``finish``."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.facts = Facts()
        self.open: list[_Open] = []
        self.ordinal = 0
        self.chars: list[str] = []
        self.space = self.boundary = False

    # --- elements

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("script", "style") and self.open and self.open[-1].name == tag:
            self.handle_endtag(tag)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = {}
        for k, v in attrs:
            a.setdefault(k, v if v is not None else "")
        if tag in CLOSES_P and any(o.name == "p" for o in self.open):
            self.handle_endtag("p")
        f, parent, here = self.facts, self.open[-1] if self.open else None, self.ordinal
        self.ordinal += 1
        in_svg = tag == "svg" or any(o.name == "svg" for o in self.open)
        if tag in BLOCKS and not self._suppressed():
            self._break()
        lang, direction = a.get("xml:lang", a.get("lang", parent.lang if parent else None)), (a.get("dir") or "").strip().lower()
        direction = direction if direction in ("ltr", "rtl", "auto") else parent.dir if parent else None
        me = _Open(tag, here, None, lang, direction)
        semantics, roles = (a.get("epub:type") or "").split(), [r.lower() for r in (a.get("role") or "").split()]
        pagebreak = "pagebreak" in semantics or "doc-pagebreak" in roles
        for attr in ("id", "xml:id"):
            if a.get(attr):
                f.fragments.append({"ord": len(f.fragments), "id": a[attr], "attribute": attr, "element": tag, "element_ord": here})
        fragment = a.get("id") or a.get("xml:id")
        if tag == "base" and f.base is None and not in_svg and "href" in a:
            f.base = a["href"]
        if tag == "meta" and (a.get("name") or "").strip().lower() == "viewport" and any(o.name == "head" for o in self.open):
            f.viewports += [{"ord": len(f.viewports) + i, "name": k, "value": v} for i, (k, v) in enumerate(viewport(a.get("content", "")))]
        lists = (f.links, f.media, f.forms, f.scripts)
        had = [len(x) for x in lists]
        self._activity(tag, a, in_svg)
        self._structure(me, tag, a, semantics, roles, pagebreak, fragment)
        self._links(me, tag, a, in_svg, parent.name if parent else None)
        self._media_and_forms(tag, a, parent.name if parent else None)
        self._scripts(me, tag, a)
        for x, n in zip(lists, had, strict=True):  # facts of one element share its ordinal
            for fact in x[n:]:
                fact["element_ord"] = here
        self._accessibility(tag, a, fragment)
        if pagebreak and not self._suppressed():
            label = " ".join((a.get("title") or a.get("aria-label") or "").split())
            if label:
                f.supplementary.append({"ord": len(f.supplementary), "kind": "page-break-label", "text": label, "position": len(self.chars)})
        if self._in_body() and not self._suppressed() and tag not in SUPPRESSED:
            role = f"heading-{tag[1]}" if re.fullmatch("h[1-6]", tag) else {"figcaption": "figure-caption", "caption": "table-caption"}.get(tag) or ("page-break" if pagebreak else "body" if tag in BODY_ROLES else "element")
            me.span = {"element": tag, "element_ord": here, "role": role, "start": None, "end": None, "lang": lang, "dir": direction, "fragment": fragment}
        if tag == "nav":
            me.nav = next((NAV_KINDS[s] for s in semantics if s in NAV_KINDS), None)
        if tag in VOID:
            self._close(me)
        else:
            self.open.append(me)

    def handle_endtag(self, tag: str) -> None:
        if any(o.name == tag for o in self.open):
            while self.open:
                top = self.open.pop()
                self._close(top)
                if top.name == tag:
                    break

    def _close(self, me: _Open) -> None:
        if me.span and me.span["start"] is not None:
            self.facts.spans.append(me.span)
        if me.span:
            label = "".join(self.chars[me.span["start"] : me.span["end"]]) if me.span["start"] is not None else None
            for s in me.structure:
                if s["role"].startswith("heading") and s["label"] is None:
                    s["label"] = label
            if me.name in ("figcaption", "caption") and label:
                owner = next((o for o in reversed(self.open) if o.name == {"figcaption": "figure", "caption": "table"}[me.name]), None)
                for s in owner.structure if owner else []:
                    if s["role"] in ("figure", "table") and s["label"] is None:
                        s["label"] = label
        if me.name in BLOCKS and not self._suppressed() and me.name not in SUPPRESSED:
            self._break()

    # --- text

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].script is not None and data.strip():
            self.open[-1].script["has_text"] = True
        if not self._in_body() or self._suppressed():
            return
        for ch in data:
            if ch in _SPACES:
                self.space = True
                continue
            if self.chars and (self.boundary or self.space):
                self.chars.append("\n" if self.boundary else " ")
            self.space = self.boundary = False
            at = len(self.chars)
            self.chars.append(ch)
            for o in self.open:
                if o.span:
                    if o.span["start"] is None:
                        o.span["start"] = at
                    o.span["end"] = at + 1

    def _break(self) -> None:
        self.boundary, self.space = True, False

    def _in_body(self) -> bool:
        return any(o.name == "body" for o in self.open)

    def _suppressed(self) -> bool:
        return any(o.name in SUPPRESSED for o in self.open)

    # --- facts

    def _activity(self, tag: str, a: dict, in_svg: bool) -> None:
        out, local = self.facts.activities, tag.rsplit(":", 1)[-1]
        for name in (k.rsplit(":", 1)[-1] for k in a):
            if name == "autofocus":
                out.add("autofocus")
            if name.startswith("on"):
                out.add("event-attribute")
        if not in_svg and local in ("audio", "video", "source", "track"):
            out.add("media")
        if not in_svg and local in ("iframe", "object", "embed"):
            out.add("embedded-content")
        if local == "script":
            out.add("script-element")
        if local in ANIMATIONS:
            out.add("animation")
        if local == "meta" and (a.get("http-equiv") or "").strip().lower() == "refresh":
            out.add("refresh")
        if local == "link" and HINTS & set((a.get("rel") or "").lower().split()):
            out.add("resource-hint")

    def _structure(self, me: _Open, tag: str, a: dict, semantics: list, roles: list, pagebreak: bool, fragment: str | None) -> None:
        found = [f"heading-{tag[1]}"] if re.fullmatch("h[1-6]", tag) else []
        found += ["page-break"] if pagebreak else []
        found += [tag] if tag in ("figure", "table") else []
        for name in ("footnote", "endnote"):
            found += [name] if name in semantics or f"doc-{name}" in roles else []
        found += ["note"] if "note" in semantics or "note" in roles else []
        found += ["navigation-list"] if tag == "nav" else []
        found += ["publication-section"] if SECTION_SEMANTICS & set(semantics) or SECTION_ROLES & set(roles) else []
        label = " ".join((a.get("title") or a.get("aria-label") or "").split()) or None if pagebreak else None
        for role in found:
            fact = {"ord": len(self.facts.structure), "role": role, "label": label if role == "page-break" else None, "fragment": fragment, "semantics": semantics + roles}
            self.facts.structure.append(fact)
            me.structure.append(fact)

    def _links(self, me: _Open, tag: str, a: dict, in_svg: bool, parent: str | None) -> None:
        rules = list(LINK_RULES.get(tag, ()))
        if in_svg and tag in ("a", "script", "image", "use"):
            attr = "href" if "href" in a else "xlink:href"
            rules = [(attr, {"a": "hyperlink", "script": "script", "image": "image", "use": "svg"}[tag])]
        kind = (a.get("type") or "").lower()
        if tag == "link" and "stylesheet" in (a.get("rel") or "").lower().split():
            rules = [("href", "stylesheet")]
        if tag == "source":
            rules = {"picture": [("srcset", "image")], "audio": [("src", "audio")], "video": [("src", "video")]}.get(parent, [])
        if tag == "input":
            rules = [("src", "image")] * (kind == "image") + [("formaction", "form-action")] * (kind in ("submit", "image"))
        if tag == "button" and kind not in ("reset", "button"):
            rules = [("formaction", "form-action")]
        nav = next((o for o in reversed(self.open) if o.name == "nav"), None)
        for attr, role in rules:
            if attr not in a:
                continue
            for value in srcset(a[attr]) if attr == "srcset" else [a[attr]]:
                shown = role
                if role == "hyperlink" and nav is not None and nav.nav:
                    item = next((o for o in reversed(self.open) if o.name == "li"), None)
                    if item is not None:
                        item.links_seen += 1
                        shown = nav.nav if item.links_seen == 1 else role
                self.facts.links.append({"ord": len(self.facts.links), "element": tag, "attribute": attr, "role": shown, "declared": value})

    def _media_and_forms(self, tag: str, a: dict, parent: str | None) -> None:
        out, kind = self.facts.media, (a.get("type") or "").lower()
        add = lambda k, **x: out.append({"ord": len(out), "kind": k, "element": tag, "alt": x.get("alt"), "detail": x.get("detail")})
        if tag in ("img", "image") or (tag == "input" and kind == "image"):
            add("image", alt=a.get("alt"))
            if a.get("alt") and not self._suppressed():
                self.facts.supplementary.append({"ord": len(self.facts.supplementary), "kind": "alt", "text": " ".join(a["alt"].split()), "position": len(self.chars)})
        elif tag in ("audio", "video"):
            add(tag)
            if tag == "video" and "poster" in a:
                add("poster")
        elif tag == "source":
            add("source", detail=parent if parent in ("picture", "audio", "video") else None)
        elif tag == "track":
            add("track", detail=(a.get("kind") or "").lower() or None)
        if tag in ("form", "input", "button", "select", "textarea", "output", "fieldset", "label"):
            self.facts.forms.append({"ord": len(self.facts.forms), "kind": "form" if tag == "form" else "control", "element": tag, "name": a.get("name")})

    def _scripts(self, me: _Open, tag: str, a: dict) -> None:
        out = self.facts.scripts
        if tag.rsplit(":", 1)[-1] == "script":
            runs = executable_type(a.get("type"))
            kind = "data-block" if not runs else "external" if "src" in a or "href" in a or "xlink:href" in a else "inline"
            me.script = {"ord": len(out), "kind": kind, "attribute": None, "type": a.get("type"), "has_text": False}
            out.append(me.script)
        out += [{"ord": len(out) + i, "kind": "event-handler", "attribute": k, "type": None, "has_text": bool(a[k])} for i, k in enumerate(k for k in a if k in EVENT_HANDLERS)]

    def _accessibility(self, tag: str, a: dict, fragment: str | None) -> None:
        out = self.facts.accessibility
        add = lambda k, v: out.append({"ord": len(out), "kind": k, "element": tag, "value": v, "fragment": fragment})
        if tag in ("img", "image", "area") or (tag == "input" and (a.get("type") or "").lower() == "image"):
            add("missing-alt" if "alt" not in a else "alt" if a["alt"].strip() else "empty-alt", a.get("alt"))
        for k, v in a.items():
            if k.startswith("aria-") or k == "role":
                add("aria" if k != "role" else "role", f"{k}={v}")
            elif k in ("lang", "xml:lang", "dir"):
                add(k.removeprefix("xml:"), v)
        if re.fullmatch("h[1-6]", tag):
            add("heading", tag[1])

    def finish(self) -> Facts:
        self.close()
        while self.open:
            self._close(self.open.pop())
        self.facts.text = "".join(self.chars)
        self.facts.spans.sort(key=lambda s: s["element_ord"])
        return self.facts


def parse_xhtml(text: str) -> Facts:
    """All facts of a document; a truncated document still closes its spans."""
    scanner = Scanner()
    scanner.feed(text)
    return scanner.finish()


def has_executable_content(facts: Facts) -> bool:
    """Scripts that run: external or inline with text, and event handlers; data blocks do not."""
    return any(s["kind"] in ("external", "event-handler") or (s["kind"] == "inline" and s["has_text"]) for s in facts.scripts)
