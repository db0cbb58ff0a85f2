import gzip
import hashlib
import json
import random
import re
from pathlib import Path

from tidemark.llm import warc


def pages(n=300):
    r = random.Random(2)
    out = [(i, f"http://{r.choice('abc')}.site{i % 7}.example.org/{r.randint(0, 99)}", "<p>" + " ".join(r.choices(["word", "é", "日本", "x" * 50], k=r.randint(0, 200)))) for i in range(n)]
    return out + [out[3]] * 3 + [(500, None, "no url"), (501, "http://null.example.org/", None), (501, "http://null.example.org/", ""), (None, "not a url\n with space", "x"), (502, "HTTP://A.example.org", "\r\n\r\n" * 5), (503, "http://long.example.org", "long " * 300_000)]


def brute(rows, shard, target):
    """One process: sorts, cuts, compresses, rolls. {file: bytes}"""

    def host(url):
        m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#\\\s]*)", url or "")
        h = re.sub(r"\.?(:[0-9]*)?$", "", re.sub(r"^.*@", "", m[1])).lower() if m else ""
        return ",".join(reversed(h.split("."))) if h else None

    low = lambda x: (x is not None, x if x is not None else 0)
    text = lambda x: (x is not None, (x or "").encode())
    sha = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    key = lambda x: (text(host(x[1])), text(x[1]), low(x[0]), sha(x[2]))
    rows = sorted(rows, key=key)
    bounds, at = {}, 0
    for x in rows:
        bounds.setdefault(at // shard, key(x))
        at += len((x[2] or "").encode())
    bounds = sorted({k for s, k in bounds.items() if s})
    files, seen, now = {}, {}, (None, 0)
    for x in rows:
        p, u, h = x
        again = seen[p, u, sha(h)] = seen.get((p, u, sha(h)), -1) + 1
        s = sum(k <= key(x) for k in bounds)
        if s != now[0]:
            now = (s, 0)
        elif len(files[warc.file_name(*now)]) >= target:
            now = (s, now[1] + 1)
        name = warc.file_name(*now)
        files[name] = files.get(name) or warc.info(name)
        files[name] += warc.member(warc.record(p, u, h, again)[0])
    return files


def folder(tmp_path, name):
    return {p.name: p.read_bytes() for p in (tmp_path / name).glob("*.warc.gz")}


def write(spark, rows, uri, parts, shard, target):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS member", "1 AS `a.b`").repartition(parts)
    return warc.write_warc(df, uri, shard, target)


def test_same_bytes_as_one_process_however_it_is_split(spark, tmp_path):
    rows = pages()
    want = brute(rows, 40_000, 6000)
    assert len(want) > 5 and len({x[:12] for x in want}) > 2
    for name, parts in (("a", 1), ("b", 7)):
        index = write(spark, rows, (tmp_path / name).as_uri(), parts, 40_000, 6000).collect()
        assert folder(tmp_path, name) == want
        assert not (tmp_path / name / "_temporary").exists()
        listed = [json.loads(x) for x in (tmp_path / name / "manifest.jsonl").read_text().splitlines()]
        assert [x["file"] for x in listed] == sorted(want)
        assert all(x["bytes"] == len(want[x["file"]]) and x["sha256"] == hashlib.sha256(want[x["file"]]).hexdigest() for x in listed)
        assert sum(x["records"] for x in listed) == len(index) == len(rows)
        # each index row leads to its record
        assert len({r.record_id for r in index}) == len(rows)
        for r in index:
            data = gzip.decompress(want[r.file][r.offset : r.offset + r.length])
            assert f"WARC-Record-ID: {r.record_id}\r\n".encode() in data and f"WARC-Payload-Digest: {r.digest}\r\n".encode() in data


def test_headers_agree_with_content():
    data, name, own = warc.record(1, "http://x.example.org/a b", "<p>é</p>")
    head, block = data[:-4].split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    assert fields["Content-Length"] == str(len(block)) and fields["WARC-Block-Digest"] == warc.digest(block)
    assert fields["WARC-Payload-Digest"] == own == warc.digest("<p>é</p>".encode()) and fields["WARC-Target-URI"].endswith("a%20b") and fields["WARC-Record-ID"] == name


def test_empty_table(spark, tmp_path):
    out = write(spark, [], (tmp_path / "e").as_uri(), 1, 40_000, 6000)
    assert out.count() == 0 and (tmp_path / "e" / "manifest.jsonl").read_text() == ""


def test_publishing_again_changes_nothing(tmp_path):
    import pyarrow as pa

    (tmp_path / "_temporary").mkdir()
    (tmp_path / "_temporary" / "t").write_bytes(b"data")
    batch = pa.RecordBatch.from_pydict({"file": ["f"], "temp": ["t"]})
    for _ in range(2):
        list(warc._publish(tmp_path.as_uri())(iter([batch])))
    assert (tmp_path / "f").read_bytes() == b"data"


def test_registered_over_every_page(spark):
    at = "/root/testdata/sf0.001"
    out = warc.op10_warc_writer(spark, at)
    assert out.select("page_id").distinct().count() == spark.read.parquet(f"{at}/pages.parquet").count()
    assert not list(Path("/root/repo").glob("*.warc.gz"))
