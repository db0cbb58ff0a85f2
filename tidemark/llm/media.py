"""Signature sniffing of media columns.

An Aho-Corasick automaton over all magic bytes passes once over each payload. At every place that it finds, the format's validator walks the structure (chunks with their checksums, segments, blocks, boxes, compressed streams) to the object's end. A payload's type is that of the valid object at its start; without one, that of a magic there (truncated or broken media), or what the text before the first object says. The declared type is corrected to it, and every valid object that doesn't begin at the start, or lies behind or inside another, is carved: type, start, length and SHA-256.

Defined cases: a null payload has null type, length and objects; an empty one is application/x-empty; rows with a null or repeated id are rows like others; a null declared type is corrected like a wrong one; a payload has no limit of length and no number of objects is too many; extra columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import table, tune


class Payload:
    """Bytes, and what several validators look up in them."""

    def __init__(self, data: bytes):
        self.data, self._found, self._zips = data, {}, None

    def __len__(self) -> int:
        return len(self.data)

    def after(self, pattern: bytes, at: int) -> int:
        """Start of the first match at or after at, or -1. Matches are listed once, however often they are asked for."""
        from bisect import bisect_left

        if pattern not in self._found:
            self._found[pattern] = [m.start() for m in re.finditer(pattern, self.data, re.S)]
        places = self._found[pattern]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def archives(self) -> dict[int, int]:
        """The end of the ZIP archive that begins at each place, from the end records, each looked at once; a first archive counts."""
        if self._zips is None:
            self._zips, d = {}, self.data
            for m in re.finditer(rb"PK\x05\x06", d):
                at = m.start()
                if at + 22 > len(d):
                    break
                size, offset, note = struct.unpack("<IIH", d[at + 12 : at + 22])
                if at + 22 + note <= len(d) and at >= size + offset and (size == 0 or d[at - size : at - size + 4] == b"PK\x01\x02"):
                    self._zips.setdefault(at - size - offset, at + 22 + note)
        return self._zips


# ---- validators: (payload, start) to the object's end, or None


def png(p: Payload, s: int) -> int | None:
    d, at, first = p.data, s + 8, True
    while at + 12 <= len(d):
        n = int.from_bytes(d[at : at + 4], "big")
        kind = d[at + 4 : at + 8]
        if first and (kind != b"IHDR" or n != 13) or at + 12 + n > len(d) or not kind.isalpha():
            return None
        if zlib.crc32(memoryview(d)[at + 4 : at + 8 + n]) != int.from_bytes(d[at + 8 + n : at + 12 + n], "big"):
            return None
        at, first = at + 12 + n, False
        if kind == b"IEND":
            return at
    return None


def jpeg(p: Payload, s: int) -> int | None:
    d, at, scans = p.data, s + 2, 0
    while at + 4 <= len(d) and d[at] == 0xFF:
        m = d[at + 1]
        if m == 0xFF:
            at += 1
            continue
        n = int.from_bytes(d[at + 2 : at + 4], "big")
        if m in (0x00, 0x01) or 0xD0 <= m <= 0xD9 or n < 2 or at + 2 + n > len(d):
            return None
        at += 2 + n
        if m == 0xDA:  # a scan's data run to the next marker that isn't stuffing or a restart
            scans += 1
            at = p.after(rb"\xff[^\x00\xd0-\xd7\xff]", at)
            if at < 0:
                return None
            if d[at + 1] == 0xD9:
                return at + 2
    return None


def gif(p: Payload, s: int) -> int | None:
    d, at = p.data, s + 13
    if at > len(d):
        return None
    if d[s + 10] & 0x80:
        at += 3 << (d[s + 10] & 7) + 1
    while at < len(d):
        kind = d[at]
        if kind == 0x3B:
            return at + 1
        if kind == 0x21 and at + 2 < len(d):
            at += 2
        elif kind == 0x2C and at + 10 < len(d):
            at += 10 + (3 << (d[at + 9] & 7) + 1 if d[at + 9] & 0x80 else 0) + 1
        else:
            return None
        while at < len(d) and d[at]:
            at += d[at] + 1
        at += 1
    return None


def pdf(p: Payload, s: int) -> int | None:
    if not re.match(rb"%PDF-[12]\.[0-9]", p.data[s : s + 8]):
        return None
    end = p.after(rb"startxref\s{1,2}[0-9]{1,10}\s{1,2}%%EOF", s)
    if end < 0:
        return None
    head = p.after(rb"%PDF-[12]\.[0-9]", s + 5)
    if 0 <= head < end:
        return None
    # later revisions are appended
    while (more := p.after(rb"startxref\s{1,2}[0-9]{1,10}\s{1,2}%%EOF", end + 1)) >= 0 and not 0 <= head < more:
        end = more
    return p.data.index(b"%%EOF", end) + 5


def zip_(p: Payload, s: int) -> int | None:
    return p.archives().get(s)


def gz(p: Payload, s: int) -> int | None:
    if len(p) < s + 18 or p.data[s + 3] & 0xE0:
        return None
    z, at = zlib.decompressobj(31), s
    try:
        while at < len(p) and not z.eof:
            z.decompress(p.data[at : at + 65536], 1 << 20)
            while z.unconsumed_tail:
                z.decompress(z.unconsumed_tail, 1 << 20)
            at += 65536
    except zlib.error:
        return None
    return min(at, len(p)) - len(z.unused_data) if z.eof else None


def riff(p: Payload, s: int) -> int | None:
    d = p.data
    end = s + 8 + int.from_bytes(d[s + 4 : s + 8], "little")
    if end > len(d) or d[s + 8 : s + 12] not in _FORMS:
        return None
    at = s + 12
    while at + 8 <= end:
        n = int.from_bytes(d[at + 4 : at + 8], "little")
        at += 8 + n + (n & 1)
    return end if at in (end, end + 1) and end > s + 12 else None


def bmp(p: Payload, s: int) -> int | None:
    if len(p) < s + 30:
        return None
    size, zero, pixels, head = struct.unpack("<IIII", p.data[s + 2 : s + 18])
    planes, bits = struct.unpack("<HH", p.data[s + 26 : s + 30])
    good = zero == 0 and head in (40, 52, 56, 64, 108, 124) and 14 + head <= pixels <= size <= len(p) - s and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return s + size if good else None


def ogg(p: Payload, s: int) -> int | None:
    d, at = p.data, s
    serial = d[s + 14 : s + 18]
    if len(d) < s + 27 or not d[s + 5] & 2:
        return None
    while at + 27 <= len(d) and d[at : at + 5] == b"OggS\0" and d[at + 14 : at + 18] == serial:
        n = d[at + 26]
        last, at = d[at + 5] & 4, at + 27 + n + sum(d[at + 27 : at + 27 + n])
        if at > len(d):
            return None
        if last:
            return at
    return None


def mp4(p: Payload, s: int) -> int | None:
    """s is the box's start, four bytes before its name."""
    d, at, seen = p.data, s, set()
    while at + 8 <= len(d):
        n, kind = int.from_bytes(d[at : at + 4], "big"), d[at + 4 : at + 8]
        if n < 8 or at + n > len(d) or kind not in _BOXES or at > s and kind == b"ftyp":
            break
        seen.add(kind)
        at += n
    return at if seen & {b"moov", b"moof", b"mdat", b"meta"} else None


_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}
_BOXES = frozenset([b"ftyp", b"moov", b"moof", b"mdat", b"meta", b"free", b"skip", b"wide", b"uuid", b"sidx", b"mfra", b"pdin", b"styp", b"emsg"])
#: magic: (type, validator, bytes before the magic)
SIGNATURES = {
    b"\x89PNG\r\n\x1a\n": ("image/png", png, 0),
    b"\xff\xd8\xff": ("image/jpeg", jpeg, 0),
    b"GIF87a": ("image/gif", gif, 0),
    b"GIF89a": ("image/gif", gif, 0),
    b"%PDF-": ("application/pdf", pdf, 0),
    b"PK\x03\x04": ("application/zip", zip_, 0),
    b"PK\x05\x06": ("application/zip", zip_, 0),
    b"\x1f\x8b\x08": ("application/gzip", gz, 0),
    b"RIFF": ("", riff, 0),
    b"BM": ("image/bmp", bmp, 0),
    b"OggS": ("audio/ogg", ogg, 0),
    b"ftyp": ("video/mp4", mp4, 4),
}
_state: dict = {}


def _automaton():
    if not _state:
        import ahocorasick

        a = ahocorasick.Automaton()
        for k in SIGNATURES:
            a.add_word(k.decode("latin-1"), k)
        a.make_automaton()
        _state["a"] = a
    return _state["a"]


def _type(data: bytes, s: int, magic: bytes) -> str:
    return SIGNATURES[magic][0] or _FORMS.get(data[s + 8 : s + 12], "application/x-riff")


def objects(data: bytes) -> tuple[list[tuple[str, int, int]], str | None]:
    """(type, start, length) of each valid object in order of start; the type of a magic at 0, valid or not."""
    p, out, head = Payload(data), [], None
    done: dict[str, int] = {}  # an archive's inner headers are not archives
    for end, magic in _automaton().iter(data.decode("latin-1")):
        kind, check, before = SIGNATURES[magic]
        s = end + 1 - len(magic) - before
        if s < 0:
            continue
        if s == 0 and (len(magic) > 2 or check(p, 0)):
            head = _type(data, s, magic)
        if magic[:2] == b"PK" and s < done.get(kind, 0):
            continue
        if (e := check(p, s)) is not None:
            out.append((_type(data, s, magic), s, e - s))
            done[kind] = e
    return sorted(out, key=lambda x: (x[1], -x[2])), head


def text_type(data: bytes) -> str:
    if not data:
        return "application/x-empty"
    try:
        text = data.decode()
    except UnicodeDecodeError:
        return "application/octet-stream"
    if "\0" in text:
        return "application/octet-stream"
    start = text[:1024].lstrip("﻿ \t\r\n").lower()
    return "text/html" if start.startswith(("<!doctype html", "<html")) else "text/plain"


def sniff_one(data: bytes, declared: str | None) -> dict:
    found, magic = objects(data)
    first = next((x for x in found if x[1] == 0), None)
    kind = first[0] if first else magic or text_type(data[: found[0][1]] if found else data)
    rest = [x for x in found if x is not first]
    return {
        "type": kind,
        "valid": bool(first) if magic or first else True,
        "corrected": declared != kind,
        "length": first[2] if first else len(data),
        "carved": [{"type": t, "start": s, "length": n, "sha256": hashlib.sha256(data[s : s + n]).hexdigest()} for t, s, n in rest],
    }


_RESULT = pa.struct([("type", pa.string()), ("valid", pa.bool_()), ("corrected", pa.bool_()), ("length", pa.int64()), ("carved", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())])))])
_DDL = "media_id long, declared string, type string, valid boolean, corrected boolean, length long, carved array<struct<type string, start long, length long, sha256 string>>"
_NONE = {"type": None, "valid": None, "corrected": None, "length": None, "carved": None}


def _sniff(batches):
    for b in batches:
        for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
            rows = [_NONE if d is None else sniff_one(d, t) for t, d in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
            fields = pa.array(rows, _RESULT).flatten()
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *fields], names=["media_id", "declared", *(f.name for f in _RESULT)])


def sniff(media: DataFrame) -> DataFrame:
    """(media_id, declared, type, valid, corrected, length, carved) for each row of media (media_id, declared, payload)."""
    tune(media.sparkSession)
    return media.select(F.col("media_id").cast("long").alias("media_id"), F.col("declared").cast("string").alias("declared"), F.col("payload").cast("binary").alias("payload")).mapInArrow(_sniff, _DDL)


# ---- the media column of pages: each page's html wrapped in the container that its number says


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def make_png(note: bytes = b"") -> bytes:
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + (_chunk(b"tEXt", b"Comment\0" + note) if note else b"") + _chunk(b"IDAT", zlib.compress(b"\0\x7f", 0)) + _chunk(b"IEND", b"")


def make_gif(note: bytes) -> bytes:
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x21\xfe" + b"".join(bytes([len(x)]) + x for x in (note[i : i + 255] for i in range(0, len(note), 255))) + b"\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\0" + b"\x3b"


def make_jpeg(note: bytes) -> bytes:
    notes = b"".join(b"\xff\xfe" + struct.pack(">H", len(x) + 2) + x for x in (note[i : i + 65000] for i in range(0, len(note), 65000)))
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0\1\1\0\0\1\0\1\0\0" + notes + b"\xff\xda" + struct.pack(">H", 8) + b"\1\1\0\0\x3f\0" + b"\x12\xff\x00\x34\xff\xd9"


def make_wav(data: bytes) -> bytes:
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def make_zip(data: bytes) -> bytes:
    crc, name = zlib.crc32(data), b"page.html"
    entry = struct.pack("<HHHHHIIIHH", 20, 0, 0, 0, 33, crc, len(data), len(data), len(name), 0)
    local = b"PK\3\4" + entry + name + data
    central = b"PK\1\2" + struct.pack("<H", 20) + entry + struct.pack("<HHHII", 0, 0, 0, 0, 0) + name
    return local + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local), 0)


def make_pdf(data: bytes) -> bytes:
    return b"%PDF-1.4\n1 0 obj <</Length " + str(len(data)).encode() + b">> stream\n" + data + b"\nendstream endobj\ntrailer <<>>\nstartxref\n0\n%%EOF"


def make_bmp(data: bytes) -> bytes:
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(data), 0, 54, 40, 1, 1, 1, 24, 0, len(data), 0, 0, 0, 0) + data


_DECLARED = ("image/png", "image/gif", "image/jpeg", "audio/wav", "application/zip", "application/gzip", "application/pdf", "text/html", "image/bmp", "image/png")


def payload_of(number: int, html: bytes) -> tuple[str, bytes]:
    """(declared type, payload): of ten containers, the eighth is the page itself with an image behind it, the tenth a PNG cut short; every third number declares the next container's type."""
    k = number % 10
    makers = (make_png, make_gif, make_jpeg, make_wav, make_zip, lambda x: gzip.compress(x, 1, mtime=0), make_pdf, lambda x: x + make_png(), make_bmp, lambda x: make_png(x)[:-20])
    return _DECLARED[(k + (number % 3 == 0)) % 10], makers[k](html)


def _media(batches):
    for b in batches:
        for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
            rows = [(None, None) if h is None else payload_of(i or 0, h.encode()) for i, h in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], names=["media_id", "declared", "payload"])


def media_of(pages: DataFrame) -> DataFrame:
    """(media_id, declared, payload): the tables at hand have no media column, so each page makes one."""
    tune(pages.sparkSession)
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_media, "media_id long, declared string, payload binary")


def op8_media_columns(spark, sf_dir):
    return sniff(media_of(table(spark, sf_dir, "pages")))
