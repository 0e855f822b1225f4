"""Scalar functions on authored values, as JVM-side column expressions.

Authored text is never repaired: a value that does not fit stays visible, with a state or a null beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# White space of HTML and XML.
HTML_SPACE = " \t\n\f\r"
XML_SPACE = " \t\r\n"
# Name characters of XML without the colon.
_NC_START = r"A-Z_a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2FF}\x{370}-\x{37D}\x{37F}-\x{1FFF}\x{200C}\x{200D}\x{2070}-\x{218F}\x{2C00}-\x{2FEF}\x{3001}-\x{D7FF}\x{F900}-\x{FDCF}\x{FDF0}-\x{FFFD}\x{10000}-\x{EFFFF}"
NCNAME = rf"^[{_NC_START}][{_NC_START}.0-9\x{{B7}}\x{{300}}-\x{{36F}}\x{{203F}}\x{{2040}}-]*$"
# Media type essences by what they hold.
MEDIA_CLASSES = {
    "webvtt": ("text/vtt",),
    "svg": ("image/svg+xml",),
    "raster:jpeg": ("image/jpeg", "image/jpg", "image/pjpeg"),
    "raster:png": ("image/png", "image/x-png"),
    "raster:gif": ("image/gif",),
    "raster:webp": ("image/webp",),
    "raster:avif": ("image/avif",),
    "raster:jxl": ("image/jxl",),
    "font:ttf": ("font/ttf", "application/x-font-ttf"),
    "font:otf": ("font/otf", "application/x-font-opentype", "application/vnd.ms-opentype"),
    "font:ttc": ("font/collection", "application/x-font-ttc"),
    "font:woff": ("font/woff", "application/font-woff", "application/x-font-woff"),
    "font:woff2": ("font/woff2", "application/font-woff2", "application/x-font-woff2"),
    "media:mp3": ("audio/mpeg", "audio/mp3", "audio/x-mp3"),
    "media:aac": ("audio/aac", "audio/aacp", "audio/x-aac"),
    "media:ogg": ("application/ogg", "audio/ogg", "video/ogg"),
    "media:mp4": ("application/mp4", "audio/mp4", "video/mp4"),
    "media:webm": ("audio/webm", "video/webm"),
    "text": ("application/xml", "application/javascript", "application/ecmascript", "application/json"),
}


def non_empty(c: Column) -> Column:
    """Unicode-trimmed text, null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""), F.lit(""))


def collapse_html(c: Column) -> Column:
    """HTML white space collapsed to single spaces and trimmed."""
    return F.btrim(F.regexp_replace(c, r"[\t\n\f\r ]+", " "))


def collapse_unicode(c: Column) -> Column:
    """Unicode white space collapsed to single spaces and trimmed."""
    return F.btrim(F.regexp_replace(c, r"(?U)\s+", " "))


def compact(c: Column, most: int = 100) -> Column:
    """White space collapsed and cut to ``most`` code points, with an ellipsis of three dots."""
    one = collapse_unicode(c)
    return F.when(F.length(one) > most, F.concat(F.substring(one, 1, most - 3), F.lit("..."))).otherwise(one)


def percent_decoded(c: Column) -> Column:
    """Percent escapes decoded as UTF-8, null where they are malformed; a plus sign stays."""
    decoded = F.try_url_decode(F.regexp_replace(c, r"\+", "%2B"))
    # bytes that are no UTF-8 come out as replacement characters; one that was meant stays
    spoilt = decoded.contains("\ufffd") & ~c.rlike(r"(?i)%EF%BF%BD") & ~c.contains("\ufffd")
    return F.when(~spoilt, decoded)


def path_error(c: Column) -> Column:
    """Why a text is no canonical path inside a publication, null if it is one."""
    first = F.substring_index(c, "/", 1)
    return (
        F.when(c == "", "empty")
        .when(c.startswith("/"), "absolute")
        .when(c.contains("\\"), "backslash")
        .when(c.rlike(r"[?#]"), "query-or-fragment")
        .when(c.rlike(r"[\x{00}-\x{1F}\x{7F}-\x{9F}]"), "control-character")
        .when(c.rlike(r"//|/$"), "empty-segment")
        .when(c.rlike(r"(^|/)\.\.?(/|$)"), "dot-segment")
        .when(first.contains(":"), "scheme-like-first-segment")
    )


def extension(c: Column) -> Column:
    """What follows the last dot of the last segment; a name that only begins with a dot has none."""
    return F.nullif(F.regexp_extract(c, r"(?:^|/)[^/]+\.([^./]*)$", 1), F.lit(""))


def parent_dir(c: Column) -> Column:
    return F.regexp_replace(c, r"/?[^/]*$", "")


def file_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def _repaired(c: Column) -> Column:
    """Interior spaces, which tools leave in place, are escaped; nothing else is repaired."""
    return F.when(c.contains(" ") & ~c.rlike(r"(?U)^\s|\s$"), F.replace(c, F.lit(" "), F.lit("%20"))).otherwise(c)


def _syntax_ok(v: Column) -> Column:
    return ~v.rlike(r"(?U)[\s\x{00}-\x{1F}\x{7F}-\x{9F}\\]") & ~F.regexp_replace(v, r"%[0-9A-Fa-f]{2}", "").contains("%")


def href_fragment(c: Column) -> Column:
    """The decoded fragment, null where there is none or it is empty."""
    v = _repaired(c)
    raw = F.when(v.contains("#"), F.regexp_replace(v, r"^[^#]*#", ""))
    return F.when(_syntax_ok(v), F.nullif(percent_decoded(raw), F.lit("")))


def href_class(c: Column) -> Column:
    """empty, invalid, same-document, local, remote, data or external; null for null."""
    v = _repaired(c)
    target = F.substring_index(v, "#", 1)
    path = F.substring_index(target, "?", 1)
    fragment = F.when(v.contains("#"), F.regexp_replace(v, r"^[^#]*#", ""))
    low = F.lower(target)
    host = F.try_parse_url(F.when(target.startswith("//"), F.concat(F.lit("https:"), target)).otherwise(target), F.lit("HOST"))
    bad_local = path.startswith("/") | F.substring_index(path, "/", 1).contains(":") | path.rlike(r"(?i)%2f|%5c") | percent_decoded(path).isNull()
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c == "", "empty")
        .when(~_syntax_ok(v) | (fragment.isNotNull() & percent_decoded(fragment).isNull()), "invalid")
        .when(v.startswith("#"), "same-document")
        .when(target.startswith("?"), "local")
        .when(target.startswith("//") | low.startswith("http://") | low.startswith("https://"), F.when(host.isNotNull(), "remote").otherwise("invalid"))
        .when(low.startswith("data:"), "data")
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external")
        .when(bad_local, "invalid")
        .otherwise("local")
    )


def join_path(authored: Column, source: Column) -> Column:
    """A decoded relative path from the document ``source``: dot and empty segments go, null where it leaves the root."""
    whole = fold_path(authored, source)
    return F.when(authored == "", source).otherwise(F.when(path_error(whole).isNull(), whole))


def fold_path(authored: Column, source: Column) -> Column:
    """The segments of ``authored`` laid onto the directory of ``source``, null where they leave the root."""

    def step(acc: Column, x: Column) -> Column:
        up = F.when(acc == "", F.lit(None).cast("string")).otherwise(parent_dir(acc))
        return F.when(acc.isNull() | x.isin("", "."), acc).when(x == "..", up).otherwise(F.when(acc == "", x).otherwise(F.concat(acc, F.lit("/"), x)))

    return F.aggregate(F.split(authored, "/"), parent_dir(source).cast("string"), step)


def resolve_href(c: Column, source: Column) -> Column:
    """(kind, address, fragment) of an authored href in the document ``source``: kind local, remote, data, external or invalid."""
    kind = href_class(c)
    v = _repaired(c)
    path = F.substring_index(F.substring_index(v, "#", 1), "?", 1)
    local = F.when(kind == "same-document", source).when(kind == "local", join_path(percent_decoded(path), source))
    address = F.coalesce(local, F.when(kind.isin("remote", "external"), F.substring_index(v, "#", 1)).when(kind == "data", c))
    state = F.when(local.isNotNull(), "local").when(address.isNotNull(), kind).when(c.isNotNull(), "invalid")
    return F.struct(state.alias("kind"), address.alias("address"), F.when(state.isin("local", "remote"), href_fragment(c)).alias("fragment"))


def with_target(df: DataFrame, href: str, source: str) -> DataFrame:
    """Adds t_kind, t_address and t_fragment: ``resolve_href`` in steps, each a projection whose results are computed once."""
    h, src = F.col(href), F.col(source)
    df = df.withColumn("_v", _repaired(h))
    df = df.withColumns({"_target": F.substring_index("_v", "#", 1), "_raw": F.when(F.col("_v").contains("#"), F.regexp_replace("_v", r"^[^#]*#", "")), "_ok": _syntax_ok(F.col("_v"))})
    df = df.withColumns({"_path": F.substring_index("_target", "?", 1), "_fragment": percent_decoded(F.col("_raw")), "_low": F.lower("_target")})
    df = df.withColumn("_decoded", percent_decoded(F.col("_path")))
    t, path = F.col("_target"), F.col("_path")
    remote = t.startswith("//") | F.col("_low").startswith("http://") | F.col("_low").startswith("https://")
    host = F.try_parse_url(F.when(t.startswith("//"), F.concat(F.lit("https:"), t)).otherwise(t), F.lit("HOST"))
    bad_local = path.startswith("/") | F.substring_index(path, "/", 1).contains(":") | path.rlike(r"(?i)%2f|%5c") | F.col("_decoded").isNull()
    kind = (
        F.when(h.isNull(), F.lit(None).cast("string"))
        .when((h == "") | ~F.col("_ok") | (F.col("_raw").isNotNull() & F.col("_fragment").isNull()), "invalid")
        .when(F.col("_v").startswith("#"), "same-document")
        .when(t.startswith("?"), "local")
        .when(remote, F.when(host.isNotNull(), "remote").otherwise("invalid"))
        .when(F.col("_low").startswith("data:"), "data")
        .when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), "external")
        .when(bad_local, "invalid")
        .otherwise("local")
    )
    df = df.withColumn("_kind", kind)
    df = df.withColumn("_folded", F.when((F.col("_kind") == "local") & (F.col("_decoded") != ""), fold_path(F.col("_decoded"), src)))
    df = df.withColumn("_local", F.when((F.col("_kind") == "same-document") | ((F.col("_kind") == "local") & (F.col("_decoded") == "")), src).when(path_error(F.col("_folded")).isNull(), F.col("_folded")))
    address = F.coalesce("_local", F.when(F.col("_kind").isin("remote", "external"), t).when(F.col("_kind") == "data", h))
    df = df.withColumn("t_address", address)
    state = F.when(F.col("_local").isNotNull(), "local").when(F.col("t_address").isNotNull(), F.col("_kind")).when(h.isNotNull(), "invalid")
    df = df.withColumn("t_kind", state)
    df = df.withColumn("t_fragment", F.when(F.col("t_kind").isin("local", "remote"), F.nullif("_fragment", F.lit(""))))
    return df.drop("_v", "_target", "_raw", "_ok", "_path", "_fragment", "_low", "_decoded", "_kind", "_folded", "_local")


def strict_resource_path(c: Column, source: Column) -> Column:
    """The path an href names exactly: local, no fragment, no empty segment, no trailing dot segment; else null."""
    decoded = percent_decoded(F.substring_index(F.substring_index(c, "#", 1), "?", 1))
    loose = decoded.rlike(r"^/|//|/$|(^|/)\.\.?$")
    found = resolve_href(c, source)
    return F.when((href_class(c) == "local") & ~loose & found["fragment"].isNull(), found["address"])


def manifest_id(c: Column) -> Column:
    """The id without surrounding XML space, null where it is no name."""
    bare = F.btrim(c, F.lit(XML_SPACE))
    return F.when(bare.rlike(NCNAME), bare)


def id_state(c: Column) -> Column:
    return F.when(c.isNull(), "missing").when(manifest_id(c).isNull(), "invalid").otherwise("valid")


def essence(c: Column) -> Column:
    """Type and subtype in lower case without parameters, null for malformed values."""
    token = r"[A-Za-z0-9!#$&^_.+-]+"
    return F.lower(F.nullif(F.regexp_extract(F.btrim(c), rf"^({token}/{token})\s*(?:;.*)?$", 1), F.lit("")))


def media_class(ess: Column) -> Column:
    """What an essence holds, null where that is not known."""
    known = F.create_map(*(F.lit(x) for k, es in MEDIA_CLASSES.items() for e in es for x in (e, k)))
    return F.coalesce(F.try_element_at(known, ess), F.when(ess.endswith("+xml") | ess.startswith("text/"), "text"))


def clock_ms(c: Column) -> Column:
    """Milliseconds of a media clock value: h:mm:ss.f, mm:ss.f or a count with h, min, s or ms; digits beyond three are dropped."""
    v = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    full = r"^(?:(\d+):)?(\d{2}):(\d{2})(?:\.(\d+))?$"
    count = r"^(\d+)(?:\.(\d+))?(h|min|s|ms)?$"
    n = lambda p, i: F.coalesce(F.regexp_extract(v, p, i).try_cast("bigint"), F.lit(0).cast("bigint"))
    thousandths = lambda p, i: F.rpad(F.substring(F.regexp_extract(v, p, i), 1, 3), 3, "0").cast("bigint")
    clock = n(full, 1) * 3_600_000 + n(full, 2) * 60_000 + n(full, 3) * 1_000 + thousandths(full, 4)
    unit = F.regexp_extract(v, count, 3)
    factor = F.when(unit == "h", 3_600_000).when(unit == "min", 60_000).when(unit == "ms", 1).otherwise(1_000)
    counted = F.floor((n(count, 1) * 1_000 + thousandths(count, 2)) * factor / 1_000).cast("bigint")
    return F.when(v.rlike(full) & (n(full, 2) < 60) & (n(full, 3) < 60), clock).when(v.rlike(count), counted)


def numeric(c: Column) -> Column:
    """A finite number, else null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def text_direction(c: Column) -> Column:
    low = F.lower(F.btrim(c, F.lit(HTML_SPACE)))
    return F.when(low.isin("ltr", "rtl", "auto"), low)


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("bigint")


def is_control_path(c: Column) -> Column:
    """Container files that are no resources of the publication."""
    return (c == "mimetype") | c.startswith("META-INF/")


# Accessibility terms by vocabulary.
ACCESSIBILITY_TERMS = {
    "schema": ("accessMode", "accessModeSufficient", "accessibilityFeature", "accessibilityHazard", "accessibilitySummary"),
    "a11y": ("contactEmail", "certifiedBy", "certifierCredential", "certifierReport"),
    "dcterms": ("conformsTo",),
    "": ("pageBreakSource", "page-source"),
}


def accessibility_term(prop: Column, prefixes: Column) -> Column:
    """vocabulary:term of an accessibility property, its prefix being reserved or declared in ``prefixes``; else null."""
    prefix = F.when(prop.contains(":"), F.substring_index(prop, ":", 1)).otherwise("")
    local = F.when(prop.contains(":"), F.regexp_replace(prop, "^[^:]*:", "")).otherwise(prop)
    declared = tokens(F.coalesce(prefixes, F.lit("")))
    uri = F.try_element_at(declared, (F.array_position(declared, F.concat(prefix, F.lit(":"))) + 1).cast("int"))
    known = F.when(F.array_position(declared, F.concat(prefix, F.lit(":"))) > 0, F.when(uri.rlike("^https?://schema.org/"), "schema").when(uri.rlike("/a11y/?#?$"), "a11y").when(uri.rlike("^http://purl.org/dc/terms/"), "dcterms"))
    vocabulary = F.when(prefix.isin("", "schema", "a11y", "dcterms"), prefix).otherwise(known)
    ok = F.lit(False)
    for v, names in ACCESSIBILITY_TERMS.items():
        ok = ok | ((vocabulary == v) & local.isin(*names))
    return F.when(ok, F.concat(vocabulary, F.lit(":"), local))


def conformance(c: Column) -> Column:
    """(accessibility version, guideline version, level) of a conformance claim, null for any other text."""
    p = r"^EPUB Accessibility (1\.[012]) - WCAG (2\.[012]) Level (A{1,3})$"
    part = lambda i, n: F.regexp_extract(c, p, i).alias(n)
    return F.when(c.rlike(p), F.struct(part(1, "accessibility"), part(2, "guidelines"), part(3, "level")))


# Structural semantics that name the document role of the same name, and deprecated semantics.
ROLE_SEMANTICS = ("abstract", "acknowledgments", "afterword", "appendix", "backlink", "biblioentry", "bibliography", "biblioref", "chapter", "colophon", "conclusion", "cover", "credit", "credits", "dedication", "endnote", "endnotes", "epigraph", "epilogue", "errata", "footnote", "foreword", "glossary", "glossref", "index", "introduction", "noteref", "notice", "pagebreak", "part", "preface", "prologue", "pullquote", "qna", "subtitle", "tip", "toc")
DEPRECATED_SEMANTICS = ("annoref", "annotation", "biblioentry", "bridgehead", "endnote", "help", "marginalia", "note", "rearnote", "rearnotes", "sidebar", "subchapter", "warning")
# Container files that embedded annotations must not touch.
PROTECTED_ANNOTATION_PATHS = ("annotations.json", "container.xml", "encryption.xml", "manifest.xml", "metadata.xml", "rights.xml", "signatures.xml")


def related_role(semantic: Column) -> Column:
    """The document role that a structural semantic stands for, null where none is defined."""
    return F.when(semantic == "page-list", "doc-pagelist").when(semantic.isin(*ROLE_SEMANTICS), F.concat(F.lit("doc-"), semantic))


def is_deprecated_semantic(semantic: Column) -> Column:
    return semantic.isin(*DEPRECATED_SEMANTICS)


def is_protected_annotation_path(path: Column) -> Column:
    return path.isin(*PROTECTED_ANNOTATION_PATHS)


def is_style_candidate(address: Column, n_declarations: Column) -> Column:
    """An undeclared local file that by its name is a style sheet."""
    return (n_declarations == 0) & (F.lower(extension(address)) == "css")


def viewport_pair(c: Column) -> Column:
    """(width, height) of a legacy viewport: both once, positive and finite, in either order; else null."""
    parts = F.split(c, ",")
    named = F.transform(parts, lambda p: F.struct(F.lower(F.trim(F.substring_index(p, "=", 1))).alias("k"), numeric(F.trim(F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")))).alias("v")))
    of = lambda k: F.filter(named, lambda x: (x["k"] == k) & (x["v"] > 0))
    ok = (F.size(parts) == 2) & (F.size(of("width")) == 1) & (F.size(of("height")) == 1)
    return F.when(ok, F.struct(F.get(of("width"), F.lit(0))["v"].alias("width"), F.get(of("height"), F.lit(0))["v"].alias("height")))


def modified_text(c: Column) -> Column:
    """A time as whole seconds in UTC, as package documents write it."""
    return F.date_format(F.to_utc_timestamp(F.date_trunc("second", c), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utf8_text(c: Column) -> Column:
    """Text of bytes that are UTF-8, else null."""
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string"))


def sample(items: Column, most: int = 8) -> Column:
    """The first of many and how many more there are."""
    return F.struct(F.slice(items, 1, most).alias("first"), F.greatest(F.size(items) - most, F.lit(0)).alias("more"))


def href_scheme(c: Column) -> Column:
    """The scheme that an href begins with, in lower case, null where it has none."""
    return F.nullif(F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.lit(""))


def href_syntax_ok(c: Column) -> Column:
    """Whether an href has neither space, control character nor backslash, and only whole percent escapes."""
    return _syntax_ok(_repaired(c))


def has_encoded_separator(c: Column) -> Column:
    return F.substring_index(F.substring_index(c, "#", 1), "?", 1).rlike(r"(?i)%2f|%5c")


def is_relative_href(c: Column) -> Column:
    """An href whose meaning depends on the document it stands in."""
    return href_class(c).isin("local", "same-document", "empty")


def clock_kind(c: Column) -> Column:
    """How a media clock value is written: full (h:mm:ss), partial (mm:ss), count (with or without a unit) or invalid."""
    v = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(clock_ms(c).isNull(), "invalid").when(v.rlike(r"^\d+:\d+:"), "full").when(v.contains(":"), "partial").otherwise("count")


def text_range(c: Column, start: int, end: int) -> Column:
    """The code points from ``start`` to before ``end``, null where the text does not reach that far."""
    return F.when(F.length(c) >= end, F.substring(c, start + 1, end - start))
