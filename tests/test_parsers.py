import struct
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from codexmill.parsers import cfi, css, hrefs, inspection, svg, xhtml, xmlparts
from codexmill.parsers.xmlparts import FormatError

DOC = """<html><head><title>t</title><base href="x/"/><meta name="viewport" content="width=100, height=200"/><script>var a="</p>";</script></head>
<body onload="x()"><h1 id="a">Hello  <b>big</b> w&amp;ld</h1><p>One<p>Two <img src="a.png" srcset="b.png 2x, c.png 3w, d.png 2q" alt="pic"/>
<nav epub:type="toc"><ol><li><a href="c1">One</a><a href="c2">x</a></li></ol></nav><section epub:type="chapter"><span epub:type="pagebreak" title=" 7 "/></section>
<figure><figcaption>Cap</figcaption></figure><video src="v" poster="p"><source src="s"/></video><script type="text/plain">1</script><style>p</style>"""


def test_xhtml_facts():
    f = xhtml.parse_xhtml(DOC)
    assert f.text == "Hello big w&ld\nOne\nTwo\nOnex\nCap"
    assert all(f.text[s["start"] : s["end"]].strip() == f.text[s["start"] : s["end"]] for s in f.spans)
    assert [(s["role"], f.text[s["start"] : s["end"]]) for s in f.spans if s["role"].startswith(("head", "fig"))] == [("heading-1", "Hello big w&ld"), ("figure-caption", "Cap")]
    assert [(x["role"], x["declared"]) for x in f.links] == [("image", "a.png"), ("image", "b.png"), ("image", "c.png"), ("toc", "c1"), ("hyperlink", "c2"), ("video", "v"), ("poster", "p"), ("video", "s")]
    assert {(x["role"], x["label"]) for x in f.structure} == {("heading-1", "Hello big w&ld"), ("navigation-list", None), ("publication-section", None), ("page-break", "7"), ("figure", "Cap")}
    assert [x["kind"] for x in f.scripts] == ["inline", "event-handler", "data-block"]
    assert f.activities == {"event-attribute", "script-element", "media"}
    assert [(v["name"], v["value"]) for v in f.viewports] == [("width", "100"), ("height", "200")]
    assert f.base == "x/"
    assert xhtml.has_executable_content(f)
    assert not xhtml.has_executable_content(xhtml.parse_xhtml("<body><script></script><p>x</p></body>"))


@given(st.text('<>/="&; abp\né', max_size=60))
def test_xhtml_never_fails(text):
    f = xhtml.parse_xhtml("<body>" + text)
    assert all(0 <= s["start"] < s["end"] <= len(f.text) for s in f.spans)


def test_xhtml_edges():
    assert xhtml.parse_xhtml("").text == ""
    assert xhtml.parse_xhtml("<body>" + "word " * 50_000).text.count(" ") == 49_999
    assert xhtml.srcset("a.png 1x, , b.png, c.png 100w 50h, d.png 5h, e.png 0w, f(1,2).png 2x") == ["a.png", "b.png", "c.png", "f(1,2).png"]
    assert [xhtml.executable_type(t) for t in (None, "", "module", "Text/JavaScript; x=1", "text/plain")] == [True, True, True, True, False]


def test_css():
    refs, whole = css.parse_css('@import "a.css"; @import url(b.css) screen; @font-face{src:url(f.woff) format("woff")} p{background:url("b\\"c.png");color:red} /* url(x) */')
    assert whole
    assert [(r["role"], r["declared"]) for r in refs] == [("import", "a.css"), ("import", "b.css"), ("font", "f.woff"), ("css", 'b"c.png')]
    assert [css.parse_css(t)[1] for t in ("", " ", "p{}", "p{", "p}", 'a{b:"x', "/* open", "{" * 300)] == [True, True, True, False, False, False, False, False]
    assert css.functional_iris("url(#a) x url('b')") == ["#a", "b"]
    assert css.decode_css("é".encode("utf-16")) == "é"
    assert css.decode_css(b"\xff\xfa") is None


def test_svg():
    s = svg.parse_svg(b'<svg xmlns="http://www.w3.org/2000/svg" xmlns:xlink="http://www.w3.org/1999/xlink" xml:base="d/"><style>@import url(s.css);</style><a xlink:href="p.html"><text id="t">Hi <tspan>you</tspan></text></a><rect fill="url(#g)" onclick="x"/><set/><foreignObject><div xmlns="http://www.w3.org/1999/xhtml"><a href="q">w</a></div></foreignObject></svg>')
    assert [(x["role"], x["declared"], x["bases"]) for x in s["links"]] == [("import", "s.css", ["d/"]), ("hyperlink", "p.html", ["d/"]), ("svg", "#g", ["d/"])]
    assert s["text"][0]["text"] == "Hi you"
    assert s["foreign"][0]["links"][0]["declared"] == "q"
    assert s["activities"] == {"animation", "event-attribute"}
    for bad in (b"<svg", b"<x/>"):
        with pytest.raises(FormatError):
            svg.parse_svg(bad)


SMIL = b'<smil xmlns="http://www.w3.org/ns/SMIL" xmlns:epub="http://www.idpf.org/2007/ops"><body><seq epub:textref="c.xhtml"><par><text src="c.xhtml#a"/><audio src="a.mp3" clipBegin="0:00:01.5" clipEnd="3s"/></par></seq></body></smil>'


def test_smil_and_limits():
    nodes = xmlparts.parse_smil(SMIL)
    assert [(n["kind"], n["parent_id"]) for n in nodes] == [("body", None), ("seq", 0), ("par", 1)]
    assert (nodes[2]["clip_begin"], nodes[2]["clip_end"]) == (1500, 3000)
    for bad, limits in ((SMIL, {"max_nodes": 2}), (SMIL, {"max_depth": 2}), (b"<x/>", {}), (SMIL.replace(b"<text", b"<no"), {})):
        with pytest.raises(FormatError):
            xmlparts.parse_smil(bad, **limits)
    assert [xmlparts.clock_ms(v) for v in ("1:02:03.4567", "02:03", "5", "1.5h", "2min", "7ms", "1:60:00", "P1D", "", None)] == [3_723_456, 123_000, 5_000, 5_400_000, 120_000, 7, None, None, None, None]


def test_xml_decoding_and_navigation():
    assert xmlparts.decode_xml(b"\xef\xbb\xbf<a/>") == "<a/>"
    assert xmlparts.decode_xml('<?xml version="1.0" encoding="ISO-8859-1"?><a>é</a>'.encode("latin-1")).endswith("é</a>")
    for bad in (b"\xff\xfe\x00\x00<", b'\xef\xbb\xbf<?xml version="1.0" encoding="utf-16"?><a/>', b"\xff\xff<a/>"):
        with pytest.raises(FormatError):
            xmlparts.decode_xml(bad)
    lists = [{"list_index": 0, "semantic": "toc", "heading": "H", "hidden": False, "points": [{"point_path": p, "label": str(p), "authored_href": h, "semantic": None, "hidden": False} for p, h in (([0], "a"), ([0, 0], "b"), ([1], None))]}]
    assert xmlparts.parse_nav(xmlparts.nav_to_xhtml(lists, "T").encode()) == lists


def test_container():
    files = [{"ord": 0, "full_path": "a", "media_type": "x/y"}, {"ord": 1, "full_path": "b.opf", "media_type": xmlparts.PACKAGE_TYPE}]
    assert xmlparts.rootfiles(xmlparts.rootfiles_to_xml(files).encode()) == files
    assert xmlparts.default_rootfile(files) == 1
    assert xmlparts.default_rootfile(files[:1]) == 0
    assert xmlparts.default_rootfile([]) is None


def png(width, height, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + extra + chunk(b"IEND", b"")


def test_inspection():
    assert inspection.inspect(png(3, 4), "raster:jpeg") == {"kind": "raster:png", "state": "complete", "valid": True, "animated": False, "width": 3, "height": 4}
    assert not inspection.inspect(png(3, 4)[:-3], None)["valid"]
    gif = b"GIF89a" + struct.pack("<HHBBB", 5, 6, 0, 0, 0) + (b"\x2c" + struct.pack("<HHHHB", 0, 0, 5, 6, 0) + b"\x02\x01\x00\x00") * 2 + b"\x3b"
    assert inspection.inspect(gif, None)["animated"]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x0b\x08\x00\x07\x00\x09\x01\x01\x11\x00"
    assert (inspection.inspect(jpeg, None)["width"], inspection.inspect(jpeg, None)["height"]) == (9, 7)
    webp = b"RIFF\x00\x00\x00\x00WEBPVP8X\x0a\x00\x00\x00\x02\x00\x00\x00\x09\x00\x00\x13\x00\x00"
    assert inspection.inspect(webp, None) == {"kind": "raster:webp", "state": "complete", "valid": True, "width": 10, "height": 20, "animated": True}
    font = b"\x00\x01\x00\x00\x00\x01" + b"\x00" * 6 + b"maxp\x00\x00\x00\x00" + struct.pack(">II", 28, 6) + b"\x00\x01\x00\x00\x00\x2a"
    assert inspection.inspect(font, None)["glyphs"] == 42
    assert inspection.webvtt("WEBVTT\n\n1\n00:01.000 --> 00:02.000\nhi\n\nNOTE x\n\n00:00:03.000 --> 00:00:04.000 align:start\nyo") == {"valid": True, "cues": 2}
    assert not inspection.webvtt("WEBVTT\n\n01:07.250 --> 01:05.500\nlate")["valid"]
    moov = struct.pack(">I4s", 8 + 28, b"moov") + struct.pack(">I4sIIIII", 28, b"mvhd", 0, 0, 0, 1000, 2500)
    assert inspection.inspect(struct.pack(">I4s4sI4s", 20, b"ftyp", b"isom", 0, b"mp42") + moov, None)["duration_ms"] == 2500
    assert inspection.inspect(b"\x00\x00\x00\x14ftypavif\x00\x00\x00\x00avif", None)["kind"] == "raster:avif"
    assert inspection.inspect(b"", None) == {"kind": None, "state": "not_applicable"}
    assert not inspection.inspect(b"OggS", None)["valid"]


@pytest.mark.parametrize("text", ["epubcfi(/6/4[chap^]1]!/4/2:3[ab,c;s=a])", "epubcfi(/6/2!/4,/2/1:0,/4/1:5)", "epubcfi(/6/14!/4/2~2.5@50:75)", "epubcfi(/6/2!/4/1:0[^^x])"])
def test_cfi_round_trip(text):
    assert cfi.show_cfi(cfi.parse_cfi(text)) == text


def test_cfi_resolution():
    doc = '<html><head/><body id="b">a\U0001f600<p>cd<i>e</i>f</p></body></html>'
    x = cfi.parse_cfi("epubcfi(/6/4!/4[b]/2/3:1)")
    assert cfi.spine_index(x) == 1
    assert cfi.resolve(doc, x.parent.steps[2:], x.parent.offset) == ("p", 7)
    for bad in ("epubcfi()", "epubcfi(/6", "x", "epubcfi(/6/4:)", "epubcfi(/6/4[a)", "epubcfi(/6/4,/2)", "epubcfi(/06)"):
        with pytest.raises(cfi.LocatorError):
            cfi.parse_cfi(bad)
    for steps in ("/4[zz]", "/4/8", "/4/2/9:0", "/4/2/3:5"):
        y = cfi.parse_cfi(f"epubcfi(/6/4!{steps})")
        with pytest.raises(cfi.LocatorError):
            cfi.resolve(doc, y.parent.steps[2:], y.parent.offset)


def test_overlay_round_trip_and_renditions():
    nodes = xmlparts.parse_smil(SMIL)
    assert xmlparts.parse_smil(xmlparts.smil_to_xml(nodes).encode()) == nodes
    files = [{"full_path": p} for p in ("a/b.opf", None, "../x", "c:d")]
    assert [xmlparts.rendition(files, i)[1] for i in range(-1, 5)] == ["out-of-bounds", "canonical", "missing", "invalid", "invalid", "out-of-bounds"]
    assert xmlparts.rendition([], 0) == (None, "none")


def test_bases():
    cases = [("c.png", ["../img/", "x/"], "E/img/x/c.png"), ("c.png", [], "E/t/c.png"), ("#f", ["d/e.xhtml"], "E/t/d/e.xhtml"), ("c.png", ["http://h/"], None), ("../../../../c", ["x/"], None), ("a%2fb", [], None), ("", [], None)]
    assert [hrefs.resolve_with_bases("E/t/a.xhtml", b, h) for h, b, _ in cases] == [w for _, _, w in cases]
