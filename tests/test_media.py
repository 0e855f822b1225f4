"""Header facts of media made here."""

import struct

from codexmill.parsers.inspection import font_names, inspect


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def page(serial, granule, packet):
    return b"OggS" + struct.pack("<BBqIIIB", 0, 0, granule, serial, 0, 0, 1) + bytes([len(packet)]) + packet


def element(kind, body):
    return kind + (0x4000 | len(body)).to_bytes(2, "big") + body


def test_ogg():
    opus = b"OpusHead" + bytes([1, 2]) + struct.pack("<HI", 312, 48000) + b"\0\0\0"
    seen = inspect(page(7, 0, opus) + page(7, 48000 * 2 + 312, b"x" * 20), None)
    assert (seen["kind"], seen["valid"], seen["duration_ms"], seen["tracks"], seen["codecs"]) == ("media:ogg", True, 2000, ["audio"], ["opus"])
    assert not inspect(page(7, 0, opus)[:-3], None)["valid"]


def test_webm():
    info = element(b"\x15\x49\xa9\x66", element(b"\x2a\xd7\xb1", (1_000_000).to_bytes(3, "big")) + element(b"\x44\x89", struct.pack(">d", 1500.0)))
    tracks = element(b"\x16\x54\xae\x6b", element(b"\xae", element(b"\x83", b"\x01") + element(b"\x86", b"V_VP9")) + element(b"\xae", element(b"\x83", b"\x02")))
    seen = inspect(element(b"\x1a\x45\xdf\xa3", b"") + element(b"\x18\x53\x80\x67", info + tracks), None)
    assert (seen["kind"], seen["valid"], seen["duration_ms"], seen["tracks"], seen["codecs"]) == ("media:webm", True, 1500, ["video", "audio"], ["V_VP9"])
    assert not inspect(b"\x1a\x45\xdf\xa3\xff", None)["valid"]


def test_mp3_and_aac():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(417 - 4)  # 128 kbit/s at 44.1 kHz
    seen = inspect(b"ID3\x03\0\0\0\0\0\x05" + b"x" * 5 + frame * 100, None)
    assert (seen["kind"], seen["valid"], seen["duration_ms"]) == ("media:mp3", True, int(100 * 1152 * 1000 / 44100))
    adts = bytes([0xFF, 0xF1, 0x50, 0x80, 0x01, 0x40, 0x00]) + bytes(3)
    seen = inspect(adts * 43, None)
    assert (seen["kind"], seen["valid"], seen["duration_ms"]) == ("media:aac", True, 43 * 1024 * 1000 // 44100)
    assert not inspect(adts[:-1], None)["valid"]


def test_avif_and_jxl():
    ispe = box(b"ispe", struct.pack(">III", 0, 640, 480))
    meta = box(b"meta", b"\0\0\0\0" + box(b"iprp", box(b"ipco", ispe)))
    whole = box(b"ftyp", b"avif\0\0\0\0avif") + meta + box(b"mdat", b"xx")
    seen = inspect(whole, None)
    assert (seen["kind"], seen["valid"], seen["width"], seen["height"]) == ("raster:avif", True, 640, 480)
    assert not inspect(whole[:-1], None)["valid"]
    bits = 1 | (9 << 1) | (1 << 6)  # small, height 80, square
    seen = inspect(b"\xff\x0a" + bits.to_bytes(10, "little"), None)
    assert (seen["kind"], seen["width"], seen["height"]) == ("raster:jxl", 80, 80)
    wide = 0 | (1 << 1) | (599 << 3) | (0 << 16) | (1 << 19) | (799 << 21)  # 13 bits each
    assert {k: inspect(b"\xff\x0a" + wide.to_bytes(10, "little"), None)[k] for k in ("width", "height")} == {"width": 800, "height": 600}


def test_font_names():
    text = "Näme".encode("utf-16-be")
    name = struct.pack(">HHH", 0, 1, 18) + struct.pack(">6H", 3, 1, 0x409, 1, len(text), 0) + text
    maxp = struct.pack(">IH", 0x10000, 7)
    at = 12 + 32
    font = b"OTTO" + struct.pack(">4H", 2, 0, 0, 0) + b"maxp" + struct.pack(">III", 0, at, len(maxp)) + b"name" + struct.pack(">III", 0, at + len(maxp), len(name)) + maxp + name
    seen = inspect(font, None)
    assert (seen["valid"], seen["glyphs"], seen["family"]) == (True, 7, "Näme")
    assert font_names(font) == {"family": "Näme"}
