"""MinHash near-duplicates: one-permutation hashing, optimal densification, bands, star edges.

Each document's shingles (runs of three lower-case words) are hashed once; the hash's top bits choose one of BINS bins and each bin keeps its least value. An empty bin borrows from the bin that a 2-universal walk, the same for all documents, reaches first among the filled ones (optimal densification). Signatures keep 16 bits of each bin. Documents of equal signatures are copies of the least of them, which alone goes on. BANDS groups of bins make bucket keys. A bucket is one star: every document has an edge to the bucket's least one, and one to the document before it in the order of the bins that follow the band, so that a document that is unlike the star's centre still meets the bucket's document most like itself. A bucket of n documents gives 2(n - 1) candidate pairs at most, however unlike they are, and there is one turn only; no bucket is capped. Pairs whose signatures agree in fewer than THRESHOLD of the bins are refused. Groups are the connected components of the accepted edges.

Defined cases: a null or wordless text and a null doc_id are in no group; rows that share doc_id and text are one document, rows that share only the doc_id are documents of their own; texts below three words have one shingle; other columns, whatever their names, are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.words import U, mix, shingles, words
from tidemark.session import remove, row_of, stored, table, tune, work_dir

SHINGLE, BINS, BANDS = 3, 128, 32
#: Share of equal bins that a pair needs; an estimate of the Jaccard similarity of the shingles.
THRESHOLD = 0.45


@cache
def _walk(bins: int) -> np.ndarray:
    """The order in which an empty bin (row) looks at the others."""
    with np.errstate(over="ignore"):
        i, j = np.meshgrid(np.arange(bins, dtype=np.uint64), np.arange(8 * bins, dtype=np.uint64), indexing="ij")
        return (mix((i + U(1)) * U(0x9E3779B97F4A7C15) + mix(j + U(77))) % U(bins)).astype(np.int64)


def signatures(rows: np.ndarray, hashes: np.ndarray, n: int, bins: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """(n x bins uint32 signatures, mask of rows that have a shingle) from pairs of row and shingle hash."""
    low = np.full(n * bins, 1 << 32, dtype=np.uint64)
    np.minimum.at(low, rows * bins + ((hashes >> U(32)) * U(bins) >> U(32)).astype(np.int64), hashes & U(0xFFFFFFFF))
    low = low.reshape(n, bins)
    filled = low < U(1 << 32)
    some = filled.any(axis=1)
    walk = _walk(bins)
    open_, step = ~filled & some[:, None], 0
    # a borrowed value is salted by both bins: a text of few shingles still fills its signature with many bits
    out = mix(low)
    while open_.any():
        r, b = np.nonzero(open_)
        # after the whole walk (never in practice) the next filled bin in order is taken
        c = walk[b, step] if step < walk.shape[1] else (b + step) % bins
        ok = filled[r, c]
        with np.errstate(over="ignore"):
            salt = (c[ok].astype(np.uint64) << U(32)) + (b[ok].astype(np.uint64) + U(1) << U(40))
            out[r[ok], b[ok]] = mix(low[r[ok], c[ok]] + salt)
        open_[r[ok], b[ok]] = False
        step += 1
    return out.astype(np.uint32), some


def band_keys(sig: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """n x bands keys as signed 64-bit numbers."""
    n, bins = sig.shape
    parts = sig.reshape(n, bands, bins // bands).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(bands, dtype=np.uint64), (n, bands)).copy()
        for j in range(parts.shape[2]):
            key = mix(key * U(0xD6E8FEB86659FD93) + parts[:, :, j] + U(1))
    return key.view(np.int64)


def _sign(bins: int):
    def run(batches):
        for b in batches:
            texts = b.column(2)
            r, h = shingles(words(texts), SHINGLE)
            sig, some = signatures(r, h, len(texts), bins)
            at = np.flatnonzero(some)
            sig = np.ascontiguousarray(sig[at].astype(">u2"))
            k, rows = len(at), pa.array(at)
            sigs = pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((np.arange(k + 1) * bins * 2).astype(np.int32)), pa.py_buffer(sig)])
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), sigs], names=["id", "th", "sig"])

    return run


@F.arrow_udf(T.DoubleType())
def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    if not len(a):
        return pa.array([], pa.float64())
    x, y = (np.frombuffer(b"".join(c.to_pylist()), dtype=np.uint16).reshape(len(c), -1) for c in (a, b))
    return pa.array((x == y).mean(axis=1))


def sign(docs: DataFrame, work: str, bins: int = BINS) -> DataFrame:
    """(v, sig) of each row that has words, as a stored table; v is the document: struct of id (doc_id) and th (text hash)."""
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th"), "text")
    return stored(own.mapInArrow(_sign(bins), "id long, th long, sig binary").select(F.struct("id", "th").alias("v"), "sig"), f"{work}/signatures")


def candidates(reps: DataFrame, bins: int = BINS, bands: int = BANDS) -> DataFrame:
    """(a, b): the star edges and the neighbour edges of all buckets, each once, a < b."""
    wide = 2 * bins // bands
    piece = lambda i: F.expr(f"substring(sig, cast(({i}) * {wide} + 1 AS int), {wide})")
    rows = reps.select("v", "sig", F.explode(F.sequence(F.lit(0), F.lit(bands - 1))).alias("band"))
    rows = rows.select("v", F.xxhash64("band", piece("band")).alias("key"), piece(f"(band + 1) % {bands}").alias("next"))
    inside = Window.partitionBy("key")
    order = inside.orderBy("next", "v")
    met = rows.select("v", F.lag("v").over(order).alias("near"), F.min("v").over(inside).alias("centre"))
    ends = F.array(F.col("centre"), F.col("near"))
    pairs = met.where("near IS NOT NULL OR centre != v").select("v", F.explode(F.array_compact(F.array_distinct(ends))).alias("w")).where("v != w")
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def similar_edges(reps: DataFrame, work: str, bins: int = BINS, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """Accepted edges (a < b), as a stored table."""
    judged = (
        candidates(reps, bins, bands)
        .join(reps.select(F.col("v").alias("a"), F.col("sig").alias("sa")), "a")
        .join(reps.select(F.col("v").alias("b"), F.col("sig").alias("sb")), "b")
        .where(_agreement("sa", "sb") >= threshold)
        .select("a", "b")
    )
    return stored(judged, f"{work}/accepted")


def components(edges: DataFrame, work: str) -> DataFrame:
    """(v, l): for every node but its component's least, that least node. Least labels spread along the edges and jump to their label's label until nothing changes."""
    spark = edges.sparkSession
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{work}/edges")
    label = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("l")).select("v", F.least("l", "v").alias("l")), f"{work}/label0")
    turn = 0
    while True:
        near = both.join(label.select(F.col("v").alias("b"), "l"), "b").select(F.col("a").alias("v"), "l")
        low = near.unionByName(label).groupBy("v").agg(F.min("l").alias("l"))
        jump = label.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        turn += 1
        fresh = stored(low.join(jump, "l").select("v", F.least("l", "ll").alias("l")), f"{work}/label{turn}")
        changed = not fresh.join(label, ["v", "l"], "left_anti").isEmpty()
        remove(spark, f"{work}/label{turn - 1}")
        label = fresh
        if not changed:
            return label.where("l < v")


def _gone(signed: DataFrame, work: str, bins: int, bands: int, threshold: float) -> DataFrame:
    """(v, first): each document that a group has besides its least."""
    spark = signed.sparkSession
    reps = stored(signed.groupBy("sig").agg(F.min("v").alias("v")), f"{work}/reps")
    copies = stored(signed.join(reps.select("sig", F.col("v").alias("rep")), "sig").where("v != rep").select("v", "rep").distinct(), f"{work}/copies")
    groups = components(similar_edges(reps, work, bins, bands, threshold), work)
    for name in ("reps", "accepted", "edges"):
        remove(spark, f"{work}/{name}")
    far = copies.join(groups.select(F.col("v").alias("rep"), "l"), "rep", "left").select("v", F.coalesce("l", "rep").alias("first"))
    return groups.select("v", F.col("l").alias("first")).unionByName(far)


def near_duplicates(docs: DataFrame, bins: int = BINS, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of) for each document that a group has besides its least one (in order of doc_id, then of text hash)."""
    work = work_dir(tune(docs.sparkSession), "near")
    return _gone(sign(docs, work, bins), work, bins, bands, threshold).select(F.col("v.id").alias("doc_id"), F.col("first.id").alias("duplicate_of"))


def keep_one(docs: DataFrame, bins: int = BINS, bands: int = BANDS, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates: of each group the least document stays, and of rows that share doc_id and text the one whose columns are least as JSON. Documents without words, and rows without a doc_id, stay."""
    work = work_dir(tune(docs.sparkSession), "near")
    signed = sign(docs, work, bins)
    twice = stored(signed.groupBy("v").count().where("count > 1").select("v"), f"{work}/twice")
    gone = _gone(signed, work, bins, bands, threshold)
    # the whole row is one column here, so that no name can clash
    rows = docs.select(row_of(docs).alias("row"), F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th")).alias("v"), (F.col("doc_id").isNull() | F.col("text").isNull()).alias("bare"))
    out = rows.join(gone.select("v"), (rows["v"] == gone["v"]) & ~rows["bare"], "left_anti")
    if not twice.isEmpty():
        again = out.join(twice, (out["v"] == twice["v"]) & ~out["bare"], "left_semi")
        first = Window.partitionBy("v").orderBy(F.to_json("row"))
        one = again.withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        out = out.join(twice, (out["v"] == twice["v"]) & ~out["bare"], "left_anti").unionByName(one)
    return out.select("row.*")


def op9_minhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))
