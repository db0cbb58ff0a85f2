"""Content-defined chunking: a gear hash cuts where the content says, so that an edit moves few cuts (FastCDC, normalised chunking)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SIZE, AVG_SIZE, MAX_SIZE = 4 << 10, 16 << 10, 64 << 10
_WINDOW = 32
_GEAR = np.random.default_rng(4711).integers(0, 1 << 32, 256, dtype=np.uint64)


def _hashes(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte. Bits shift out after 32 bytes, so each value depends on these alone and all are found at once."""
    h = np.zeros(len(data), dtype=np.uint64)
    g = _GEAR[data]
    for j in range(min(_WINDOW, len(data))):
        h[j:] += g[: len(data) - j] << np.uint64(j)
    return h & np.uint64(0xFFFFFFFF)


def cuts(data: bytes, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE) -> list[int]:
    """Ends of the chunks. Before the average size a cut is harder to come by than after it."""
    raw = np.frombuffer(data, dtype=np.uint8)
    bits = max(1, average.bit_length() - 1)
    h = _hashes(raw)
    top = lambda n: np.flatnonzero(h >> np.uint64(32 - n) == 0) + 1
    hard, easy = top(bits + 1), top(bits - 1)
    out, at = [], 0
    while at < len(raw):
        middle, end = min(at + average, len(raw)), min(at + most, len(raw))
        k = np.searchsorted(hard, at + least)
        cut = int(hard[k]) if k < len(hard) and hard[k] <= middle else None
        if cut is None:
            k = np.searchsorted(easy, max(middle, at + least))
            cut = int(easy[k]) if k < len(easy) and easy[k] <= end else end
        out.append(cut)
        at = cut
    return out


def chunks(data: bytes, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE) -> list[tuple[str, int, int]]:
    """(hash, offset, length) in order."""
    ends = cuts(data, least, average, most)
    return [(hashlib.sha256(data[a:z]).hexdigest(), a, z - a) for a, z in zip([0, *ends], ends)]


def chunk_rows(content: DataFrame, least: int = MIN_SIZE, average: int = AVG_SIZE, most: int = MAX_SIZE, with_bytes: bool = False) -> DataFrame:
    """(resource_id, position, hash, offset, length[, bytes]) for content (resource_id long, data binary); a null has no chunks."""

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 64) for i in range(0, b.num_rows, 64)):
                ids, where, rows, pieces = part.column(0), [], [], []
                for i, data in enumerate(part.column(1).to_pylist()):
                    for k, (h, a, n) in enumerate(chunks(data, least, average, most) if data else []):
                        where.append(i)
                        rows.append((k, h, a, n))
                        if with_bytes:
                            pieces.append(data[a : a + n])
                cols = list(zip(*rows)) or [(), (), (), ()]
                arrays = [ids.take(pa.array(where, pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64())]
                names = ["resource_id", "position", "hash", "offset", "length"]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(pieces, pa.binary())] if with_bytes else []), names=names + ["bytes"] * with_bytes)

    return content.select(F.col("resource_id").cast("long").alias("resource_id"), F.col("data").cast("binary").alias("data")).mapInArrow(run, "resource_id long, position int, hash string, offset long, length long" + ", bytes binary" * with_bytes)
