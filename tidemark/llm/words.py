"""Words of whole Arrow batches, found and hashed with numpy.

A word is a run of ASCII letters, digits and of characters outside ASCII; everything else separates words. Words of two rows never join, however the rows lie in the buffer.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 21
_BASE = U(0x9E3779B97F4A7C15)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
WORD_BYTES = np.zeros(256, dtype=bool)
WORD_BYTES[[*b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"]] = True
WORD_BYTES[128:] = True
_powers: list[np.ndarray] = []


class Words(NamedTuple):
    """start and end are byte positions in data; row is the batch's row of each word; first[r] is row r's first word, first[-1] the number of words."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    row: np.ndarray
    first: np.ndarray


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.type not in (pa.large_string(), pa.large_binary()):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = pc.fill_null(texts, "" if texts.type == pa.large_string() else b"")
    _, offsets, data = texts.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), o


def slices(batch, column: int, size: int = 1 << 20):
    """The batch in slices of rows whose texts have size bytes at most; a longer text is a slice of its own."""
    o = buffers(batch.column(column))[1]
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(o, o[i] + size, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SEGMENT + 4096)
        with np.errstate(over="ignore"):
            for base in (_BASE, _INVERSE):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                _powers.append(np.cumprod(p))
        del _powers[:-2]
    return _powers[0], _powers[1]


def words(texts: pa.Array, lower: bool = True) -> Words:
    """All words of a batch. Hashes are of the lower-case form when lower is true."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if lower:
        texts = pc.utf8_lower(texts)
    data, offsets = buffers(texts)
    return words_of(data, offsets)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    lo, hi = int(offsets[0]), int(offsets[-1])
    cuts = np.unique(offsets)
    starts, ends, hashes = [], [], []
    with np.errstate(over="ignore"):
        at = lo
        while at < hi:
            to = min(hi, at + SEGMENT)
            if to < hi:  # end between words
                while to < hi:
                    gap = np.flatnonzero(~WORD_BYTES[data[to : to + 4096]])
                    if len(gap):
                        to += int(gap[0])
                        break
                    to = min(hi, to + 4096)
            part = data[at:to]
            inside = WORD_BYTES[part]
            edge = np.zeros(len(part) + 1, dtype=bool)
            own = cuts[np.searchsorted(cuts, at) : np.searchsorted(cuts, to, "right")] - at
            edge[own] = True
            before = np.empty_like(inside)
            before[0] = False
            before[1:] = inside[:-1]
            s = np.flatnonzero(inside & (~before | edge[:-1]))
            after = np.empty_like(inside)
            after[-1] = False
            after[:-1] = inside[1:]
            e = np.flatnonzero(inside & (~after | edge[1:])) + 1
            up, down = _pow(len(part) + 1)
            total = np.empty(len(part) + 1, dtype=np.uint64)
            total[0] = 0
            np.cumsum(_VALUES[part] * up[: len(part)], out=total[1:])
            hashes.append(mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)))
            starts.append(s + at)
            ends.append(e + at)
            at = to
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    h = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    first = np.searchsorted(start, offsets)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, h, row, first)


_STEP = U(0xD6E8FEB86659FD93)


def windows(w: Words, n: int, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every run of n words inside one row."""
    h = w.hash if hashes is None else hashes
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        g = h[n - 1 :].copy()
        for j in range(n - 2, -1, -1):
            g *= _STEP
            g += h[j : j + m]
        ok = np.flatnonzero(w.row[:m] == w.row[n - 1 :])
        return ok, mix(g[ok])


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of n words; a row of fewer words but at least one gives one shingle of all of them."""
    at, g = windows(w, n)
    count = np.diff(w.first)
    rows, hs = [w.row[at]], [g]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            short = np.flatnonzero(count == k)
            if len(short):
                x = np.zeros(len(short), dtype=np.uint64)
                for j in range(k - 1, -1, -1):
                    x = x * _STEP + w.hash[w.first[short] + j]
                rows.append(short)
                hs.append(mix(x + U(k)))
    return np.concatenate(rows), np.concatenate(hs)
