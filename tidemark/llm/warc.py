"""Deterministic sharded WARC writer.

Records are ordered by host (labels reversed), URL, page_id and payload digest, and range-sorted into shards: a first pass sorts the keys alone, sums the payloads' sizes in that order and cuts every SHARD bytes; the cuts (a key for each shard) go to the second pass, which sends each page to its shard. A shard is sorted and written by one task. Each page becomes a response record with headers made anew (target, date, record id, block and payload digests, lengths) in a gzip member of its own; when a file has TARGET compressed bytes, the shard goes on in a new one. So the files, byte for byte, depend on the records and the two sizes alone, not on how Spark split the work. The driver holds a key for each shard: choose SHARD so that these are few enough.

Files are written under temporary names that no two attempts share. The index of the attempts that Spark committed names them; it is written as a table, then every file gets its final name, and last of all the manifest, itself renamed from a temporary name. A folder without a manifest is unfinished; files that the manifest doesn't name aren't part of the archive.

Defined cases: a null html is an empty payload; a null url becomes urn:page:<page_id>; control characters and spaces in a url are percent-encoded; repeated rows are records of their own, numbered, so that every record id is unique; extra columns are never read; an empty table gives a manifest without files.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.url_filter import host_of
from tidemark.session import stored, table, tune, work_dir

#: Payload bytes of a shard, compressed bytes after which a file is full, and the date of all records (deterministic output has no clock).
SHARD, TARGET, DATE = 128 << 20, 32 << 20, "2024-01-01T00:00:00Z"
_ORDER = ["site", "url", "page_id", "sha"]
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def member(data: bytes) -> bytes:
    """One gzip member without name and time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, html: str | None, again: int = 0, date: str = DATE) -> tuple[bytes, str, str]:
    """(record, record id, payload digest). again: how many equal records come before."""
    payload = (html or "").encode()
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    own = digest(payload)
    name = f"<urn:uuid:{uuid.uuid5(_SPACE, json.dumps([page_id, target, own, again]))}>"
    head = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {date}",
        f"WARC-Record-ID: {name}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Block-Digest: {digest(block)}",
        f"WARC-Payload-Digest: {own}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", name, own


def info(name: str, date: str = DATE) -> bytes:
    """The member that begins each file."""
    body = f"software: tidemark\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Date: {date}", f"WARC-Filename: {name}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(_SPACE, name)}>", "Content-Type: application/warc-fields", f"WARC-Block-Digest: {digest(body)}", f"Content-Length: {len(body)}"]
    return member("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def file_name(shard: int, k: int) -> str:
    return f"shard-{shard:06d}-{k:04d}.warc.gz"


def file_system(uri: str):
    """(pyarrow file system, path) of a Hadoop URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", re.sub(r"^file:/(?!/)", "file:///", uri)))


def _write(uri: str, target: int, date: str):
    def run(batches):
        """Writes the shards of a sorted partition, each file under a new temporary name."""
        system, path = file_system(uri)
        out = sha = now = last = None
        rows, k, size, again, temp = [], 0, 0, 0, ""

        def close():
            out.close()
            cols = list(zip(*rows))
            n = len(rows)
            done = pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array([file_name(now, k)] * n), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string()), pa.array([temp] * n), pa.array([size] * n, pa.int64()), pa.array([sha.hexdigest()] * n)],
                names=["page_id", "record_id", "file", "offset", "length", "digest", "temp", "bytes", "sha256"],
            )
            rows.clear()
            return done

        def put(data: bytes) -> None:
            nonlocal size
            out.write(data)
            sha.update(data)
            size += len(data)

        for b in batches:
            for i in range(b.num_rows):
                shard, page_id, url, html, digest_ = (b.column(c)[i].as_py() for c in ("shard", "page_id", "url", "html", "sha"))
                if out is not None and (shard != now or size >= target):
                    yield close()
                    out, k = None, k + 1 if shard == now else 0
                again, last = (again + 1 if (page_id, url, digest_) == last else 0), (page_id, url, digest_)
                if out is None:
                    now, size, sha = shard, 0, hashlib.sha256()
                    temp = f"{file_name(now, k)}.{uuid.uuid4().hex}"
                    out = system.open_output_stream(f"{path}/_temporary/{temp}")
                    put(info(file_name(now, k), date))
                data, name, own = record(page_id, url, html, again, date)
                data, at = member(data), size
                put(data)
                rows.append((page_id, name, at, len(data), own))
        if out is not None:
            yield close()

    return run


_INDEX = "page_id long, record_id string, file string, offset long, length long, digest string, temp string, bytes long, sha256 string"


def _publish(uri: str):
    def run(batches):
        """Gives files their final names; a file that has it already was published by an attempt before."""
        from pyarrow import fs

        system, path = file_system(uri)
        for b in batches:
            for name, temp in zip(b.column("file").to_pylist(), b.column("temp").to_pylist()):
                if system.get_file_info(f"{path}/_temporary/{temp}").type == fs.FileType.File:
                    system.move(f"{path}/_temporary/{temp}", f"{path}/{name}")
                elif system.get_file_info(f"{path}/{name}").type != fs.FileType.File:
                    raise FileNotFoundError(f"{path}/{name}")
            yield b

    return run


def _key(values) -> tuple:
    """A tuple that compares as Spark sorts the columns: nulls first, texts by their bytes."""
    return tuple((v is not None, v.encode() if isinstance(v, str) else v or 0) for v in values)


def cuts(rows: DataFrame, shard: int) -> list[tuple]:
    """The first key of every shard but the first. rows: the key columns and size."""
    sorted_ = rows.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id())
    keys = stored(sorted_, f"{work_dir(rows.sparkSession, 'warc-keys')}/keys")
    sums = keys.groupBy("part").agg(F.sum("size").alias("sum"))  # a row for each partition
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("sum")).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("part").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    placed = keys.withColumn("inside", inside).join(F.broadcast(before), "part").withColumn("shard", F.floor((F.col("before") + F.col("inside")) / shard))
    first = placed.groupBy("shard").agg(F.min(F.struct(*_ORDER)).alias("key")).where("shard > 0").select("key.*")
    return sorted({_key(r) for r in first.collect()})


def write_warc(pages: DataFrame, uri: str, shard: int = SHARD, target: int = TARGET, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC files under uri; gives the index: (page_id, record_id, file, offset, length, digest)."""
    spark = tune(pages.sparkSession)
    system, path = file_system(uri)
    system.create_dir(f"{path}/_temporary", recursive=True)
    host = F.array_join(F.reverse(F.split(host_of(F.col("url")), r"\.")), ",")
    payload = F.coalesce("html", F.lit(""))
    rows = pages.select(host.alias("site"), F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(payload).alias("sha"))
    bounds = spark.sparkContext.broadcast(cuts(rows.select(*_ORDER, F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size")), shard))

    @F.arrow_udf(T.LongType())
    def shard_of(site: pa.Array, url: pa.Array, page_id: pa.Array, sha: pa.Array) -> pa.Array:
        return pa.array([bisect_right(bounds.value, _key(k)) for k in zip(*(c.to_pylist() for c in (site, url, page_id, sha)))], pa.int64())

    sent = rows.withColumn("shard", shard_of(*_ORDER)).repartitionById(len(bounds.value) + 1, F.col("shard").cast("int")).sortWithinPartitions("shard", *_ORDER)
    index = stored(sent.select("shard", "page_id", "url", "html", "sha").mapInArrow(_write(uri, target, date), _INDEX), f"{uri}/_index")
    files = index.groupBy("file", "temp", "bytes", "sha256").agg(F.count("*").alias("records"))
    stored(files.mapInArrow(_publish(uri), files.schema).select("file", "records", "bytes", "sha256"), f"{uri}/_temporary/manifest")
    listed = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{uri}/_temporary/manifest")
    with system.open_output_stream(f"{path}/_manifest.tmp") as f:  # a line for each file
        for r in listed.orderBy("file").toLocalIterator():
            f.write(json.dumps(r.asDict()).encode() + b"\n")
    system.move(f"{path}/_manifest.tmp", f"{path}/manifest.jsonl")
    system.delete_dir(f"{path}/_temporary")
    return index.select("page_id", "record_id", "file", "offset", "length", "digest")


def op10_warc_writer(spark, sf_dir):
    return write_warc(table(spark, sf_dir, "pages"), work_dir(spark, "warc"))
