"""Byte-level BPE: overlapping chunk encoding, and decoding.

Documents of more than CHUNK characters are cut into chunks that overlap by OVERLAP. Chunks are spread over the cluster and pre-tokenised each by itself; two neighbours are stitched at the first place in their overlap where both have a pre-token boundary (from there on both would go on alike, because the pattern never looks back). The pieces between stitches are encoded in parallel and their ids joined. Where an overlap has no common boundary (one huge pre-token), the rest of the document is one piece, so the ids are always those of the whole text. Shorter documents are one piece from the start. Decoding concatenates the bytes of the ids; every row says whether that gives back the text's bytes.

The vocabulary is read on the driver from a rank file (a parameter) and sent to the workers.

Defined cases: a null text has null ids, an empty one none; ids of special tokens are never made, their strings are ordinary text; a null or repeated doc_id changes nothing, each row gets its ids; extra columns are dropped.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import stored, table, tune, work_dir

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK, OVERLAP, MARGIN = 65_536, 1_024, 16
#: A pre-token of more characters goes around the compiled pattern, which has a limit on backtracking.
_LONG_SPACE = 4_096

_codecs: dict = {}


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import regex
        import tiktoken

        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.spaces = regex.compile(r"\s{%d,}" % _LONG_SPACE)
        self.bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> np.ndarray:
        if self.spaces.search(text):
            return np.array([i for m in self.pattern.finditer(text) for i in self.encoding._encode_single_piece(m.group())], dtype=np.int32)
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def boundaries(self, text: str) -> list[int]:
        """Ends of the pre-tokens that stay the same whatever follows the text."""
        ends = [m.end() for m in self.pattern.finditer(text)]
        return [e for e in ends[:-1] if e <= len(text) - MARGIN]


def read_ranks(path: str = RANKS) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _codec(shared) -> Codec:
    """One codec for each worker."""
    if shared.value[0] not in _codecs:
        _codecs[shared.value[0]] = Codec(shared.value[1])
    return _codecs[shared.value[0]]


def _ids(arrays: list[np.ndarray | None]) -> pa.Array:
    size = np.array([0 if a is None else len(a) for a in arrays], dtype=np.int32)
    flat = np.concatenate([a for a in arrays if a is not None] or [np.zeros(0, np.int32)]).astype(np.int32)
    mask = pa.array([a is None for a in arrays], pa.bool_()) if any(a is None for a in arrays) else None
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(flat), mask=mask)


def _encode(shared, keys: list[str]):
    """keys, ids and exactness for rows of keys and text."""

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                texts = part.column("text").to_pylist()
                ids = [None if t is None else codec.encode(t) for t in texts]
                exact = [None if t is None else codec.decode(i.tolist()) == t.encode() for t, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), _ids(ids), pa.array(exact, pa.bool_())], names=[*keys, "tokens", "exact"])

    return run


def _cut(chunk: int, overlap: int):
    """The chunks of each text, in batches of a few."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                last = (len(text) - 1) // chunk
                for k in range(0, last + 1, 16):
                    n = list(range(k, min(k + 16, last + 1)))
                    parts = pa.array([text[j * chunk : (j + 1) * chunk + overlap] for j in n], pa.string())
                    same = pa.array([i] * len(n))
                    yield pa.RecordBatch.from_arrays([b.column("rid").take(same), b.column("doc_id").take(same), pa.array(n, pa.int32()), pa.array([last] * len(n), pa.int32()), parts], names=["rid", "doc_id", "chunk", "last", "text"])

    return run


def _pretokenise(shared, chunk: int, overlap: int):
    """Adds to each chunk its boundaries at its head and in its overlap with the next, as positions in the document."""

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            for part in (b.slice(i, 16) for i in range(0, b.num_rows, 16)):
                head, tail = [], []
                for text, k in zip(part.column("text").to_pylist(), part.column("chunk").to_pylist()):
                    e = [0, *codec.boundaries(text)]
                    head.append([x + k * chunk for x in e if x < overlap])
                    tail.append([x + k * chunk for x in e if x >= chunk])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64()))], names=[*part.schema.names, "head", "tail"])

    return run


def encode(docs: DataFrame, ranks_path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, tokens, n_tokens, exact) for every document."""
    if overlap > chunk:  # stitches of neighbouring pairs of chunks could cross
        raise ValueError("overlap must not exceed chunk")
    spark = tune(docs.sparkSession)
    shared = spark.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))  # one vocabulary, whatever the corpus
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.char_length("text")
    short = own.where(size.isNull() | (size <= chunk)).mapInArrow(_encode(shared, ["doc_id"]), "doc_id long, tokens array<int>, exact boolean")
    long = own.where(size > chunk).withColumn("rid", F.monotonically_increasing_id())
    cut = long.select("rid", "doc_id", "text").mapInArrow(_cut(chunk, overlap), "rid long, doc_id long, chunk int, last int, text string")
    work = work_dir(spark, "bpe")
    # stored, so that rid is fixed and the text is cut once
    chunks = stored(cut.repartition("rid", "chunk").mapInArrow(_pretokenise(shared, chunk, overlap), "rid long, doc_id long, chunk int, last int, text string, head array<long>, tail array<long>"), f"{work}/chunks")
    order = Window.partitionBy("rid").orderBy("chunk")
    stitch = F.array_min(F.array_intersect("tail", F.lead("head").over(order)))
    places = chunks.select("rid", "chunk", "last", F.when(F.col("chunk") < F.col("last"), stitch).alias("to"))
    # after a gap without common boundary nothing is sure: the rest is one piece
    lost = F.max((F.col("to").isNull() & (F.col("chunk") < F.col("last"))).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    places = places.withColumn("to", F.when(lost == 0, F.col("to"))).withColumn("start", F.lag("to").over(order))
    places = places.withColumn("piece", F.count("start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.col("chunk").cast("long") * chunk
    end = F.coalesce(F.col("to") - at, F.when(F.col("chunk") < F.col("last"), chunk).otherwise(chunk + overlap))
    begin = F.coalesce(F.col("start") - at, F.lit(0))
    parts = chunks.select("rid", "doc_id", "chunk", "text").join(places, ["rid", "chunk"])
    parts = parts.select("rid", "doc_id", "piece", "chunk", F.col("text").substr((begin + 1).cast("int"), (end - begin).cast("int")).alias("text"))
    pieces = parts.groupBy("rid", "doc_id", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("text"))
    done = pieces.mapInArrow(_encode(shared, ["rid", "doc_id", "piece"]), "rid long, doc_id long, piece long, tokens array<int>, exact boolean")
    whole = done.groupBy("rid", "doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "tokens"))), lambda x: x["tokens"])).alias("tokens"), F.every("exact").alias("exact"))
    out = short.unionByName(whole.drop("rid"))
    return out.select("doc_id", "tokens", F.when(F.col("tokens").isNotNull(), F.size("tokens")).alias("n_tokens"), "exact")


def decode(encoded: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """(doc_id, bytes): the concatenated bytes of tokens; null for null ids."""
    spark = tune(encoded.sparkSession)
    shared = spark.sparkContext.broadcast((ranks_path, read_ranks(ranks_path)))

    def run(batches):
        codec = _codec(shared)
        for b in batches:
            out = [None if t is None else codec.decode(t) for t in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, bytes binary")


def op5_byte_bpe(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"))
