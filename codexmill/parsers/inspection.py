"""Byte inspection: format detection by signature and header facts of images, fonts, captions, text and media."""

from __future__ import annotations

import re
import struct
import zlib

# Signatures in the order they are tried; offset, bytes, format.
SIGNATURES = (
    (0, b"\xff\xd8\xff", "raster:jpeg"),
    (0, b"\x89PNG\r\n\x1a\n", "raster:png"),
    (0, b"GIF87a", "raster:gif"),
    (0, b"GIF89a", "raster:gif"),
    (0, b"\xff\x0a", "raster:jxl"),
    (0, b"\x00\x00\x00\x0cJXL \r\n\x87\n", "raster:jxl"),
    (0, b"wOFF", "font:woff"),
    (0, b"wOF2", "font:woff2"),
    (0, b"ttcf", "font:ttc"),
    (0, b"OTTO", "font:otf"),
    (0, b"\x00\x01\x00\x00", "font:ttf"),
    (0, b"true", "font:ttf"),
    (0, b"OggS", "media:ogg"),
    (0, b"\x1aE\xdf\xa3", "media:webm"),
    (0, b"ID3", "media:mp3"),
    (0, b"WEBVTT", "webvtt"),
    (0, b"\xef\xbb\xbfWEBVTT", "webvtt"),
)
FONT_FACES = 4096


def detect(data: bytes) -> str | None:
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "raster:webp"
    if data[4:8] == b"ftyp" and len(data) >= 16:
        size = min(int.from_bytes(data[:4], "big"), len(data))
        brands = [data[8:12], *(data[i : i + 4] for i in range(16, size - 3, 4))]
        return "raster:avif" if b"avif" in brands or b"avis" in brands else "media:mp4"
    for at, mark, name in SIGNATURES:
        if data[at : at + len(mark)] == mark:
            return name
    if len(data) > 2 and data[0] == 0xFF and data[1] & 0xF6 == 0xF0:
        return "media:aac"
    if len(data) > 3 and data[0] == 0xFF and data[1] & 0xE0 == 0xE0 and data[1] & 0x18 != 0x08 and data[1] & 0x06:
        return "media:mp3"
    return None


def _jpeg(b: bytes) -> dict:
    at = 2
    while at + 4 <= len(b) and b[at] == 0xFF:
        marker = b[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker in (0xD8, 0x01) or 0xD0 <= marker <= 0xD7:
            at += 2
            continue
        length = int.from_bytes(b[at + 2 : at + 4], "big")
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 9 > len(b):
                break
            return {"valid": True, "height": int.from_bytes(b[at + 5 : at + 7], "big"), "width": int.from_bytes(b[at + 7 : at + 9], "big")}
        at += 2 + length
    return {"valid": False}


def _png(b: bytes) -> dict:
    out, at, frames = {"valid": False, "animated": False}, 8, 0
    while at + 12 <= len(b):
        size, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(b) or zlib.crc32(kind + body) != int.from_bytes(b[at + 8 + size : at + 12 + size], "big"):
            return out | {"valid": False}
        if kind == b"IHDR":
            out |= {"width": int.from_bytes(body[:4], "big"), "height": int.from_bytes(body[4:8], "big")}
        frames += kind == b"acTL"
        if kind == b"IEND":
            return out | {"valid": "width" in out, "animated": frames > 0}
        at += 12 + size
    return out


def _gif(b: bytes) -> dict:
    if len(b) < 13:
        return {"valid": False}
    width, height, flags = struct.unpack_from("<HHB", b, 6)
    at, frames = 13 + (3 * 2 ** ((flags & 7) + 1) if flags & 0x80 else 0), 0

    def skip(at: int) -> int:
        while at < len(b) and b[at]:
            at += 1 + b[at]
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return {"valid": True, "width": width, "height": height, "animated": frames > 1}
        if b[at] == 0x21:
            at = skip(at + 2)
        elif b[at] == 0x2C and at + 10 <= len(b):
            frames += 1
            local = b[at + 9]
            at = skip(at + 10 + (3 * 2 ** ((local & 7) + 1) if local & 0x80 else 0) + 1)
        else:
            break
    return {"valid": False, "width": width, "height": height, "animated": frames > 1}


def _webp(b: bytes) -> dict:
    kind = b[12:16]
    if kind == b"VP8X" and len(b) >= 30:
        return {"valid": True, "width": int.from_bytes(b[24:27], "little") + 1, "height": int.from_bytes(b[27:30], "little") + 1, "animated": bool(b[20] & 2)}
    if kind == b"VP8L" and len(b) >= 25 and b[20] == 0x2F:
        bits = int.from_bytes(b[21:25], "little")
        return {"valid": True, "width": (bits & 0x3FFF) + 1, "height": (bits >> 14 & 0x3FFF) + 1, "animated": False}
    if kind == b"VP8 " and len(b) >= 30 and b[23:26] == b"\x9d\x01\x2a":
        return {"valid": True, "width": int.from_bytes(b[26:28], "little") & 0x3FFF, "height": int.from_bytes(b[28:30], "little") & 0x3FFF, "animated": False}
    return {"valid": False}


def _font(b: bytes, at: int = 0) -> dict:
    if len(b) < at + 12:
        return {"valid": False}
    n = int.from_bytes(b[at + 4 : at + 6], "big")
    tables = {}
    for i in range(n):
        rec = b[at + 12 + 16 * i : at + 28 + 16 * i]
        if len(rec) < 16:
            return {"valid": False}
        tables[rec[:4]] = (int.from_bytes(rec[8:12], "big"), int.from_bytes(rec[12:16], "big"))
    ok = all(o + s <= len(b) for o, s in tables.values())
    glyphs = int.from_bytes(b[tables[b"maxp"][0] + 4 : tables[b"maxp"][0] + 6], "big") if b"maxp" in tables and ok else None
    names = font_names(b, at) if ok and b"name" in tables else {}
    return {"valid": ok and n > 0, "glyphs": glyphs, "variable": b"fvar" in tables, "faces": 1, "family": names.get("family"), "style": names.get("style")}


def _ttc(b: bytes) -> dict:
    n = int.from_bytes(b[8:12], "big")
    if n > FONT_FACES or len(b) < 12 + 4 * n:
        return {"valid": False, "faces": n}
    faces = [_font(b, int.from_bytes(b[12 + 4 * i : 16 + 4 * i], "big")) for i in range(n)]
    return {"valid": n > 0 and all(f["valid"] for f in faces), "faces": n, "glyphs": sum(f.get("glyphs") or 0 for f in faces), "variable": any(f.get("variable") for f in faces), "family": faces[0].get("family") if faces else None, "style": faces[0].get("style") if faces else None}


def _woff(b: bytes) -> dict:
    if len(b) < 44:
        return {"valid": False}
    length, n = int.from_bytes(b[8:12], "big"), int.from_bytes(b[12:14], "big")
    ok = length == len(b) and n > 0 and 44 + 20 * n <= len(b)
    for i in range(n if ok else 0):
        o, size, full = struct.unpack_from(">III", b, 44 + 20 * i + 4)
        ok &= o + size <= len(b) and size <= full
    return {"valid": ok, "faces": 1}


def _woff2(b: bytes) -> dict:
    ok = len(b) >= 48 and int.from_bytes(b[8:12], "big") == len(b) and int.from_bytes(b[12:14], "big") > 0
    return {"valid": ok, "faces": 1}


_STAMP = r"(?:\d{2,}:)?[0-5]\d:[0-5]\d\.\d{3}"


def vtt_ms(stamp: str) -> int:
    *hours, minutes, rest = stamp.split(":")
    return (int(hours[0]) if hours else 0) * 3_600_000 + int(minutes) * 60_000 + int(rest[:2]) * 1000 + int(rest[3:])


def webvtt(text: str) -> dict:
    """Validity and number of cues of a caption file."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    if not re.match(r"WEBVTT(?:[ \t][^\n]*)?(?:\n|$)", lines):
        return {"valid": False, "cues": 0}
    cues, ok = 0, True
    for block in re.split(r"\n{2,}", lines)[1:]:
        rows = [r for r in block.split("\n") if r]
        if not rows or re.match(r"(NOTE|STYLE|REGION)\b", rows[0]):
            continue
        timing = next((r for r in rows[:2] if "-->" in r), "")
        m = re.match(rf"\s*({_STAMP})[ \t]+-->[ \t]+({_STAMP})(?:[ \t].*)?$", timing)
        ok &= bool(m) and vtt_ms(m[1]) < vtt_ms(m[2])
        cues += bool(m)
    return {"valid": ok, "cues": cues}


def text_encoding(data: bytes) -> str | None:
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-bom"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    try:
        data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return "utf-8"


def _mp4(b: bytes) -> dict:
    """Duration and track kinds from the movie box."""

    boxes = lambda a, z: _boxes(b, a, z)
    out = {"valid": False, "duration_ms": None, "tracks": []}
    for kind, a, z in boxes(0, len(b)):
        if kind == b"moov":
            out["valid"] = True
            for k2, a2, z2 in boxes(a, z):
                if k2 == b"mvhd":
                    wide = b[a2] == 1
                    scale, length = struct.unpack_from(">IQ" if wide else ">II", b, a2 + (20 if wide else 12))
                    out["duration_ms"] = length * 1000 // scale if scale else None
                if k2 == b"trak":
                    for k3, a3, z3 in boxes(a2, z2):
                        if k3 == b"mdia":
                            out["tracks"] += [{b"soun": "audio", b"vide": "video"}.get(b[a4 + 8 : a4 + 12], "other") for k4, a4, _ in boxes(a3, z3) if k4 == b"hdlr"]
    return out


def _boxes(b: bytes, a: int, z: int):
    while a + 8 <= z:
        size, kind, head = int.from_bytes(b[a : a + 4], "big"), b[a + 4 : a + 8], 8
        if size == 1:
            size, head = int.from_bytes(b[a + 8 : a + 16], "big"), 16
        size = size or z - a
        if size < head or a + size > z:
            return
        yield kind, a + head, a + size
        a += size


def _avif(b: bytes) -> dict:
    """Valid if whole boxes fill the file and the brand, the items and their data are there; the size from the largest image extent."""
    top = list(_boxes(b, 0, len(b)))
    whole = bool(top) and top[-1][2] == len(b)
    out = {"valid": whole and top[0][0] == b"ftyp" and {b"meta", b"mdat"} <= {k for k, _, _ in top} or whole and {b"ftyp", b"moov"} <= {k for k, _, _ in top}, "animated": b[8:12] == b"avis"}
    sizes = []
    for kind, a, z in top:
        if kind == b"meta":
            for k2, a2, z2 in _boxes(b, a + 4, z):
                if k2 == b"iprp":
                    sizes += [struct.unpack_from(">II", b, a4 + 4) for k3, a3, z3 in _boxes(b, a2, z2) if k3 == b"ipco" for k4, a4, _ in _boxes(b, a3, z3) if k4 == b"ispe"]
    if sizes:
        out["width"], out["height"] = max(sizes)
    return out


def _jxl(b: bytes) -> dict:
    """Size of a JPEG XL image from its codestream header."""
    at = 0
    if b[:2] != b"\xff\x0a":
        found = next((a for k, a, _ in _boxes(b, 0, len(b)) if k == b"jxlc"), None)
        part = next((a + 4 for k, a, _ in _boxes(b, 0, len(b)) if k == b"jxlp"), None)
        at = found if found is not None else part
        if at is None or b[at : at + 2] != b"\xff\x0a":
            return {"valid": False}
    if len(b) < at + 12:
        return {"valid": False}
    bits, pos = int.from_bytes(b[at + 2 : at + 14], "little"), 0

    def take(n: int) -> int:
        nonlocal pos
        value = bits >> pos & (1 << n) - 1
        pos += n
        return value

    lengths = (9, 13, 18, 30)  # fixed values: widths of a size by its two leading bits
    small = take(1)
    height = (take(5) + 1) * 8 if small else take(lengths[take(2)]) + 1
    ratio = take(3)
    scale = ((1, 1), (1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))[ratio]  # fixed values: aspect ratios; the first is none
    width = height * scale[0] // scale[1] if ratio else (take(5) + 1) * 8 if small else take(lengths[take(2)]) + 1
    return {"valid": True, "width": width, "height": height}


def _ogg(b: bytes) -> dict:
    """Tracks and duration of an Ogg stream: the codec from each first packet, the time from the last position."""
    at, streams, ok = 0, {}, True
    while at + 27 <= len(b):
        if b[at : at + 4] != b"OggS":
            ok = False
            break
        granule, serial = struct.unpack_from("<qI", b, at + 6)
        n = b[at + 26]
        body = at + 27 + n
        size = sum(b[at + 27 : at + 27 + n])
        packet = b[body : body + size]
        if body + size > len(b):
            ok = False
            break
        if serial not in streams:
            if packet[1:7] == b"vorbis" and len(packet) >= 16:
                streams[serial] = ["audio", "vorbis", int.from_bytes(packet[12:16], "little"), 0]
            elif packet[:8] == b"OpusHead" and len(packet) >= 12:
                streams[serial] = ["audio", "opus", 48_000, int.from_bytes(packet[10:12], "little")]
            elif packet[1:7] == b"theora":
                streams[serial] = ["video", "theora", 0, 0]
            else:
                streams[serial] = ["other", None, 0, 0]
            streams[serial].append(0)
        if granule > 0:
            streams[serial][4] = granule
        at = body + size
    times = [max(0, last - skip) * 1000 // rate for _, _, rate, skip, last in streams.values() if rate]
    return {"valid": ok and bool(streams), "duration_ms": max(times, default=None), "tracks": [s[0] for s in streams.values()], "codecs": [s[1] for s in streams.values() if s[1]]}


def _ebml_number(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and what follows it; ``keep`` leaves the length marker in (identifiers)."""
    first = b[at]
    n = 9 - first.bit_length() if first else 9
    if n > 8 or at + n > len(b):
        raise IndexError
    value = int.from_bytes(b[at : at + n], "big")
    return (value if keep else value & (1 << 7 * n) - 1), at + n


def _webm(b: bytes) -> dict:
    """Tracks, codecs and duration of a Matroska segment."""
    out = {"valid": False, "duration_ms": None, "tracks": [], "codecs": []}
    scale, length = 1_000_000, None

    def walk(a: int, z: int, depth: int) -> None:
        nonlocal scale, length
        while a < z:
            kind, a = _ebml_number(b, a, True)
            head = a
            size, a = _ebml_number(b, a, False)
            open_ended = size == (1 << 7 * (a - head)) - 1
            end = z if open_ended else min(a + size, z)
            if kind == 0x18538067:  # segment
                out["valid"] = True
            if kind in (0x18538067, 0x1549A966, 0x1654AE6B, 0xAE) and depth < 4:  # segment, info, tracks, one track
                walk(a, end, depth + 1)
            elif kind == 0x2AD7B1:
                scale = int.from_bytes(b[a:end], "big")
            elif kind == 0x4489:
                length = struct.unpack(">d" if end - a == 8 else ">f", b[a:end])[0]
            elif kind == 0x83:
                out["tracks"].append({1: "video", 2: "audio"}.get(b[a], "other"))
            elif kind == 0x86:
                out["codecs"].append(b[a:end].decode("ascii", "replace"))
            elif kind == 0x1F43B675:  # media data follow
                return
            a = end

    walk(0, len(b), 0)
    if length is not None:
        out["duration_ms"] = int(length * scale / 1_000_000)
    return out


# Bit rates (kbit/s) and sample rates of MPEG audio headers, and sample rates of ADTS.
_MP3_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_MP3_SAMPLES = (44_100, 48_000, 32_000)
_ADTS_SAMPLES = (96_000, 88_200, 64_000, 48_000, 44_100, 32_000, 24_000, 22_050, 16_000, 12_000, 11_025, 8_000, 7_350)


def _mp3(b: bytes) -> dict:
    """Frames of MPEG audio behind an ID3 tag; the duration from all their samples."""
    at = 10 + sum((b[6 + i] & 0x7F) << 7 * (3 - i) for i in range(4)) if b[:3] == b"ID3" and len(b) >= 10 else 0
    frames, ms = 0, 0.0
    while at + 4 <= len(b):
        if b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
            break
        version, layer, rate, sample = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
        if version == 1 or layer == 4 or rate in (0, 15) or sample == 3:
            break
        half = 1 if version == 3 else 2
        hertz = _MP3_SAMPLES[sample] // (half if version else 4)
        kbits, pad = _MP3_RATES[half, layer][rate], b[at + 2] >> 1 & 1
        count = 384 if layer == 1 else 1152 if layer == 2 or half == 1 else 576
        at += (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else count // 8 * kbits * 1000 // hertz + pad
        frames += 1
        ms += count * 1000 / hertz
    return {"valid": frames > 0, "duration_ms": int(ms) if frames else None, "tracks": ["audio"] if frames else [], "codecs": ["mp3"] if frames else []}


def _aac(b: bytes) -> dict:
    """ADTS frames; the duration from all their samples."""
    at, blocks, hertz, ok = 0, 0, 0, True
    while at + 7 <= len(b):
        size, rate = (b[at + 3] & 3) << 11 | b[at + 4] << 3 | b[at + 5] >> 5, b[at + 2] >> 2 & 15
        if b[at] != 0xFF or b[at + 1] & 0xF6 != 0xF0 or size < 7 or rate >= len(_ADTS_SAMPLES) or at + size > len(b):
            ok = False
            break
        hertz = _ADTS_SAMPLES[rate]
        blocks += (b[at + 6] & 3) + 1
        at += size
    return {"valid": ok and blocks > 0, "duration_ms": blocks * 1024 * 1000 // hertz if hertz else None, "tracks": ["audio"] if blocks else [], "codecs": ["aac"] if blocks else []}


def font_names(b: bytes, at: int = 0) -> dict[str, str]:
    """Family, style and full name of a font from its name table, English ones first."""
    n = int.from_bytes(b[at + 4 : at + 6], "big")
    table = next((struct.unpack_from(">II", b, at + 12 + 16 * i + 8) for i in range(n) if b[at + 12 + 16 * i : at + 16 + 16 * i] == b"name"), None)
    if table is None:
        return {}
    start, wanted, found = table[0], {1: "family", 2: "style", 4: "full"}, {}
    count, strings = struct.unpack_from(">HH", b, start + 2)
    for i in range(count):
        platform, _, language, name, length, offset = struct.unpack_from(">6H", b, start + 6 + 12 * i)
        if name in wanted and platform in (0, 1, 3):
            raw = b[start + strings + offset : start + strings + offset + length]
            rank = (0 if platform == 3 and language == 0x409 else 1 if platform == 3 else 2, i)
            text = raw.decode("mac-roman" if platform == 1 else "utf-16-be", "replace")
            found[wanted[name]] = min(found.get(wanted[name], (rank, text)), (rank, text))
    return {k: v[1] for k, v in found.items()}


_INSPECT = {"raster:jpeg": _jpeg, "raster:png": _png, "raster:gif": _gif, "raster:webp": _webp, "font:ttf": _font, "font:otf": _font, "font:ttc": _ttc, "font:woff": _woff, "font:woff2": _woff2, "media:mp4": _mp4, "media:ogg": _ogg, "media:webm": _webm, "media:mp3": _mp3, "media:aac": _aac, "raster:avif": _avif, "raster:jxl": _jxl}


def inspect(data: bytes, declared: str | None) -> dict:
    """Header facts: what is detected beats what is declared; formats without a reader are told as unsupported."""
    kind = detect(data) or declared
    if kind is None:
        return {"kind": None, "state": "not_applicable"}
    if kind in ("webvtt", "text", "svg"):
        encoding = text_encoding(data)
        more = webvtt(data.decode("utf-8", "replace")) if kind == "webvtt" else {"valid": encoding is not None}
        return {"kind": kind, "state": "complete", "encoding": encoding, **more}
    if kind not in _INSPECT:
        return {"kind": kind, "state": "partial", "issue": "unsupported"}
    try:
        return {"kind": kind, "state": "complete", **_INSPECT[kind](data)}
    except (IndexError, struct.error):
        return {"kind": kind, "state": "complete", "valid": False}
