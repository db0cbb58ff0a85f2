import gzip
import hashlib
import io
import random
import struct
import time
import wave
import zipfile
import zlib

import pytest

from tidemark.llm import media as m

HTML = "<!DOCTYPE html><p>text é</p>".encode() * 20


def brute(data):
    """Every place and every signature, without the automaton."""
    out = set()
    for s in range(len(data)):
        for magic, (_, check, before) in m.SIGNATURES.items():
            if data[s + before : s + before + len(magic)] == magic and (e := check(m.Payload(data), s)) is not None:
                out.add((m._type(data, s, magic), s, e - s))
    return out


def real_wav():
    f = io.BytesIO()
    with wave.open(f, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(bytes(range(200)))
    return f.getvalue()


def real_zip():
    f = io.BytesIO()
    with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "text " * 50)
        z.writestr("b/c.bin", bytes(range(256)))
    return f.getvalue()


def ogg():
    page = lambda flag, n: b"OggS\0" + bytes([flag]) + struct.pack("<qIII", 0, 77, n, 0) + b"\1\5hello"
    return page(2, 0) + page(0, 1) + page(4, 2)


def mp4():
    box = lambda k, d: struct.pack(">I", len(d) + 8) + k + d
    return box(b"ftyp", b"isom\0\0\0\1") + box(b"moov", b"x" * 20) + box(b"mdat", b"y" * 30)


WHOLE = {
    "image/png": m.make_png(HTML), "image/gif": m.make_gif(HTML), "image/jpeg": m.make_jpeg(HTML), "audio/wav": real_wav(), "application/zip": real_zip(), "application/gzip": gzip.compress(HTML, mtime=0),
    "application/pdf": m.make_pdf(HTML), "image/bmp": m.make_bmp(b"\1\2\3\0"), "audio/ogg": ogg(), "video/mp4": mp4(),
}


@pytest.mark.parametrize("kind", WHOLE)
def test_whole_cut_damaged_and_embedded(kind):
    data = WHOLE[kind]
    r = m.sniff_one(data, kind)
    assert (r["type"], r["valid"], r["corrected"], r["length"]) == (kind, True, False, len(data))
    assert m.sniff_one(data, "text/html")["corrected"] and m.sniff_one(data, None)["corrected"]
    # embedded in text, twice, with more behind
    inside = b"some text " + data + b" between " + data + b"\0tail"
    r = m.sniff_one(inside, kind)
    ours = [(c["start"], c["length"], c["sha256"]) for c in r["carved"] if c["type"] == kind]
    sha = hashlib.sha256(data).hexdigest()
    assert (10, len(data), sha) in ours and (19 + len(data), len(data), sha) in ours
    # cut short
    cut = m.sniff_one(data[:-3], kind)
    assert not any(c["start"] == 0 for c in cut["carved"]) and (not cut["valid"] or cut["type"] != kind or cut["length"] < len(data))


@pytest.mark.parametrize("kind", WHOLE)
def test_against_all_places(kind):
    r = random.Random(7)
    data = WHOLE[kind] + bytes(r.choices(range(256), k=300)) + WHOLE["image/png"] + b"PK\3\4 RIFF BM \xff\xd8\xff %PDF-1.4 ftyp GIF89a \x1f\x8b\x08" + m.make_gif(b"x")
    assert set(m.objects(data)[0]) <= brute(data)
    inner = {x for x in brute(data) if not (x[0] == "application/zip" and x not in m.objects(data)[0])}
    assert inner <= set(m.objects(data)[0])


def test_made_containers_are_what_they_say():
    with zipfile.ZipFile(io.BytesIO(m.make_zip(HTML))) as z:
        assert z.read("page.html") == HTML and z.testzip() is None
    with wave.open(io.BytesIO(m.make_wav(b"abc"))) as w:
        assert w.readframes(10) == b"abc"
    assert gzip.decompress(m.payload_of(5, HTML)[1]) == HTML


def test_checksums_and_sizes_count():
    png = bytearray(WHOLE["image/png"])
    png[60] ^= 1
    assert m.sniff_one(bytes(png), "image/png")["valid"] is False
    z = zlib.compress(b"x")
    assert m.sniff_one(z, "x")["type"] == "application/octet-stream"
    assert m.sniff_one(b"BM is how this text begins", "text/plain") == {"type": "text/plain", "valid": True, "corrected": False, "length": 26, "carved": []}


@pytest.mark.parametrize("data, kind", [(b"", "application/x-empty"), (b"  <!doctype HTML><p>", "text/html"), ("é text".encode(), "text/plain"), (b"\xff\xfe\0", "application/octet-stream"), (b"a\0b", "application/octet-stream")])
def test_texts(data, kind):
    assert m.sniff_one(data, kind)["type"] == kind


def test_many_magics_are_no_trouble():
    t = time.time()
    for magic in m.SIGNATURES:
        m.sniff_one(magic * 20_000, "x")
    assert time.time() - t < 20


def test_query_on_every_page(spark):
    at = "/root/testdata/sf0.01"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = m.op8_media_columns(spark, at).collect()
    assert len(got) == len(pages)
    for r in got:
        k, size = r.media_id % 10, len(m.payload_of(r.media_id, pages[r.media_id].encode())[1])
        assert r.type == m._DECLARED[k] and r.corrected == (r.declared != r.type)
        assert r.valid == (k != 9) and r.length == size
        assert (len(r.carved) >= 1) == (k == 7)


def test_cases(spark):
    rows = [(1, "image/png", None), (2, None, b""), (None, "image/gif", bytearray(WHOLE["image/gif"])), (3, "x", bytearray(b"a" * 3_000_000 + WHOLE["image/png"])), (3, "x", bytearray(b"a" * 3_000_000 + WHOLE["image/png"]))]
    media = spark.createDataFrame(rows, "media_id int, declared string, payload binary").selectExpr("*", "1 AS type", "2 AS `a.b`")
    got = sorted((r.media_id or 0, r.type, r.length, len(r.carved or [])) for r in m.sniff(media).collect())
    png = len(rows[3][2])
    assert got == [(0, "image/gif", len(WHOLE["image/gif"]), 0), (1, None, None, 0), (2, "application/x-empty", 0, 0), (3, "text/plain", png, 1), (3, "text/plain", png, 1)]
    assert m.sniff(media.limit(0)).count() == 0
