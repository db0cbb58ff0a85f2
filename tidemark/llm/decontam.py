"""Benchmark decontamination by template windows with typed slots.

A text becomes a sequence of units: a number (digits with ".", "," or ":" inside, or any word that begins with a digit) is a <num>, a unit of measure after a number a <unit>, a word of one capital and then others a <name>, wherever it stands (so an ordinary word that opens a sentence is a slot too); every other word stands for itself in lower case. Windows of WINDOW units are hashed verbatim, every unit as its lower-case text, and, if they have slots, as templates of two kinds: with words that open a sentence as names, and with these as literals. The windows of documents and benchmark items are hash-joined. A verbatim match always counts, so case and line breaks of a copy don't matter, nor how many slots the window has. A template match counts if at least half of the item's units are literal or open a sentence, and if its slot values and the document's map to each other one to one over all windows of this document, item, alignment and kind; only windows with a value that maps to several, or that several map to, fall away (the same template asked with inconsistent values is another question). A document is contaminated by an item if consistent windows cover MIN_COVER of the item's units, or RUN units in all.

Items of fewer than WINDOW units are matched by one window of their whole length. The benchmark's hashes go to the scan as a Bloom filter of a fixed size, whatever the benchmark's, so that hardly any other windows are shuffled; the join is exact.

Defined cases: null or empty texts and items match nothing; an item without a window that is half literal matches only verbatim; a copy that is renamed and in another case is only found where its windows have no name; repeated documents or items are reported each by their own id (rows that share an id are one); rows with a null id are left out; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import U, Words, buffers, mix, slices, windows, words_of
from tidemark.session import stored, table, tune, work_dir

WINDOW, MIN_COVER, RUN = 8, 0.5, 20
#: The Bloom filter has 2 ** FILTER_BITS bits.
FILTER_BITS = 26
UNITS = frozenset("kg g mg lb lbs oz km m cm mm mi mile miles foot feet ft inch inches yard yards l ml litre litres liter liters hour hours hr hrs minute minutes min mins second seconds sec secs day days week weeks month months year years dollar dollars cent cents euro euros pound pounds percent degrees degree mph kmh kph".split())

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".!?\n\r"]] = True
_SEP = np.zeros(256, dtype=bool)
_SEP[[*b".,:"]] = True
#: Bytes of the character that a byte begins; 0 for a byte inside one.
_SIZE = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, dtype=np.int64)
NUM, UNIT, NAME, PLAIN, VERBATIM = U(0xA1), U(0xA2), U(0xA3), U(0x10000), U(0x5EED0000)


def _hashes_of(values) -> np.ndarray:
    w = words_of(*buffers(pa.array(sorted(values))))
    return np.sort(w.hash)


_UNIT_HASHES = _hashes_of(UNITS)


def _lower(texts: pa.Array) -> pa.Array:
    """Lower case, byte for byte in place: a character whose small letter has another size stays."""
    low = pc.utf8_lower(texts)
    moved = np.flatnonzero(pc.binary_length(low).to_numpy(zero_copy_only=False) != pc.binary_length(texts).to_numpy(zero_copy_only=False))
    if not len(moved):
        return low
    out, old = low.to_pylist(), texts.take(pa.array(moved)).to_pylist()
    for i, t in zip(moved.tolist(), old):
        out[i] = "".join(x if len((x := c.lower()).encode()) == len(c.encode()) else c for c in t)
    return pa.array(out, low.type)


class Template:
    """words: the batch's units with template hashes; kind 0 literal, 1 <num>, 2 <unit>, 3 <name>."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        raw, offsets = buffers(texts)
        lo, hi = int(offsets[0]), int(offsets[-1])
        raw, offsets = raw[lo:hi], offsets - lo
        own, at = buffers(_lower(texts))
        data = own[int(at[0]) : int(at[0]) + hi - lo]
        w = words_of(data, offsets)
        n = len(w.start)
        first = raw[w.start] if n else np.zeros(0, np.uint8)
        digit = (first >= 48) & (first <= 57)
        # a name: a capital and then none, so that texts in capitals have no names
        other = np.concatenate([raw != data, np.zeros(8, bool)])
        size = np.concatenate([_SIZE[raw], np.zeros(8, np.int64)])

        def is_capital(at):
            out = other[at].copy()
            for k in (1, 2, 3):
                out |= other[at + k] & (size[at] > k)
            return out

        after = w.start + np.maximum(size[w.start], 1)
        upper = is_capital(w.start) & (after < w.end) & ~is_capital(np.minimum(after, len(raw)))
        head = np.zeros(n, dtype=bool)
        head[w.first[:-1][np.diff(w.first) > 0]] = True
        # a sentence begins after ., !, ? or a line end
        marks = np.concatenate([[0], np.cumsum(_ENDS[raw])])
        since = np.zeros(n, dtype=bool)
        since[1:] = marks[w.start[1:]] > marks[w.end[:-1]]
        begins = head | since
        glued = np.zeros(n, dtype=bool)  # the rest of a number such as 1,000
        if n:
            near = (w.start[1:] == w.end[:-1] + 1) & ~head[1:]
            glued[1:] = digit[1:] & digit[:-1] & near & _SEP[raw[np.minimum(w.end[:-1], len(raw) - 1)]]
        kind = np.zeros(n, dtype=np.int8)
        kind[digit] = 1
        kind[upper & ~digit] = 3
        keep = np.flatnonzero(~glued)
        end = w.end.copy()
        if glued.any():  # a unit ends where its last glued part ends
            last = np.append(keep[1:], n) - 1
            end[keep] = w.end[last]
        # a verbatim unit: all its parts in order
        part = np.arange(n) - np.repeat(keep, np.diff(np.append(keep, n)))
        with np.errstate(over="ignore"):
            parts = mix(w.hash + part.astype(np.uint64) * NUM)
            self.verbatim = np.add.reduceat(parts, keep) if n else parts
        h, kind = w.hash[keep], kind[keep]
        opens = begins[keep] & (kind == 3)
        unit = np.zeros(len(keep), dtype=bool)
        if len(keep) > 1:
            where = np.minimum(np.searchsorted(_UNIT_HASHES, h), len(_UNIT_HASHES) - 1)
            row = w.row[keep]
            unit[1:] = (_UNIT_HASHES[where[1:]] == h[1:]) & (kind[:-1] == 1) & (row[1:] == row[:-1])
        kind[unit & (kind != 1)] = 2
        plain = np.where(opens & (kind == 3), 0, kind).astype(np.int8)
        self.kinds = (kind, plain)
        self.hashes = tuple(np.where(k == 1, NUM, np.where(k == 2, UNIT, np.where(k == 3, NAME, h))) for k in self.kinds)
        h = self.hashes[0]
        row = w.row[keep]
        self.literal = plain == 0
        self.words = Words(data, offsets, w.start[keep], end[keep], h, row, np.searchsorted(row, np.arange(len(offsets))))

    def windows(self, n: int, half: bool) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(first unit, hash, kind of template or -1) of all verbatim windows of n units, and of the template windows with slots; half: of those only the ones at least half literal."""
        at, v = windows(self.words, n, self.verbatim)
        with np.errstate(over="ignore"):
            out = [(at, mix(v + U(n) + VERBATIM), -1)]
        for k, (kind, hashes) in enumerate(zip(self.kinds, self.hashes)):
            _, h = windows(self.words, n, hashes)
            slots, literal = (np.concatenate([[0], np.cumsum(x)]) for x in (kind != 0, self.literal))
            ok = slots[at + n] > slots[at]
            if half:
                ok &= 2 * (literal[at + n] - literal[at]) >= n
            with np.errstate(over="ignore"):
                out.append((at[ok], mix(h[ok] + U(n) + PLAIN * U(k)), k))
        return out

    def slots(self, at: np.ndarray, n: int, k: int) -> pa.Array:
        """The slot values of each window, in order."""
        if k < 0 or not len(at):
            return pa.array([[]] * len(at), pa.list_(pa.string()))
        w, units = self.words, at[:, None] + np.arange(n)
        ok = self.kinds[k][units] != 0
        used, which = np.unique(units[ok], return_inverse=True)
        values = pa.array([bytes(w.data[a:z]).decode("utf-8", "replace") for a, z in zip(w.start[used].tolist(), w.end[used].tolist())], pa.string())
        offsets = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), values.take(pa.array(which)))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The filter's two bits for each hash."""
    return (h >> U(64 - FILTER_BITS)).astype(np.int64), (h & U((1 << FILTER_BITS) - 1)).astype(np.int64)


def bloom(hashes: DataFrame) -> np.ndarray:
    """The filter of a column hash as 64-bit words; they are made by an aggregation, so that the driver gets no more than the filter's size."""
    h = F.col("hash")
    bit = F.explode(F.array(F.shiftrightunsigned(h, 64 - FILTER_BITS), h.bitwiseAND((1 << FILTER_BITS) - 1)))
    one = F.expr("shiftleft(1L, cast(bit & 63 AS int))")
    rows = hashes.select(bit.alias("bit")).groupBy(F.shiftrightunsigned("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, dtype=np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out


def _maybe(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.arange(len(h))
    for at in _places(h):
        at = at[out]
        out = out[(bits[at >> 6] >> (at & 63).astype(np.uint64) & U(1)).astype(bool)]
    return out


def _emit(name: str, lengths: list[int] | None, wanted):
    """Window rows of a batch's texts. lengths: the window lengths; None: each row by its own length, WINDOW at most, with the row's number of units."""

    def run(batches):
        for b in (part for whole in batches for part in slices(whole, 1)):
            t = Template(b.column(1))
            count = np.diff(t.words.first)
            for n in lengths or sorted(set(np.minimum(count, WINDOW).tolist()) - {0}):
                for at, h, kind in t.windows(n, lengths is None):
                    if lengths is None:
                        own = np.minimum(count, WINDOW)[t.words.row[at]] == n
                    else:
                        own = _maybe(wanted.value, h)
                    at, h = at[own], h[own]
                    if not len(at):
                        continue
                    rows, k = t.words.row[at], len(at)
                    yield pa.RecordBatch.from_arrays(
                        [
                            b.column(0).take(pa.array(rows)),
                            pa.array(h.view(np.int64)),
                            pa.array((at - t.words.first[rows]).astype(np.int32)),
                            pa.array(np.full(k, n, np.int32)),
                            pa.array(count[rows].astype(np.int32)),
                            pa.array(np.full(k, kind, np.int32)),
                            t.slots(at, n, kind),
                        ],
                        names=[f"{name}_id", "hash", f"{name}_at", "n", f"{name}_units", "kind", f"{name}_slots"],
                    )

    return run


def _schema(name: str) -> str:
    return f"{name}_id long, hash long, {name}_at int, n int, {name}_units int, kind int, {name}_slots array<string>"


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, share): the share of the item's units that the document holds with consistent slots."""
    spark = tune(docs.sparkSession)
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    item_rows = stored(items.mapInArrow(_emit("item", None, None), _schema("item")), work_dir(spark, "bench"))
    lengths = sorted({WINDOW, *(r[0] for r in item_rows.select("n").distinct().collect())})  # WINDOW values at most
    wanted = spark.sparkContext.broadcast(bloom(item_rows))
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    doc_rows = own.mapInArrow(_emit("doc", lengths, wanted), _schema("doc"))
    met = doc_rows.join(item_rows, ["hash", "n", "kind"]).withColumn("shift", F.col("doc_at") - F.col("item_at"))
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d"))
    aligned = met.groupBy("doc_id", "item_id", "shift", "kind").agg(F.max("item_units").alias("units"), F.collect_set(F.struct("item_at", "n", pairs.alias("slots"))).alias("at"))
    # values of one side that have several on the other
    aligned = aligned.withColumn("pairs", F.array_distinct(F.flatten(F.transform("at", lambda a: a["slots"]))))
    repeated = lambda c: F.filter(F.array_distinct(c), lambda v: F.size(F.filter(c, lambda x: x == v)) > 1)
    aligned = aligned.withColumns({"all_i": F.transform("pairs", lambda p: p["i"]), "all_d": F.transform("pairs", lambda p: p["d"])})
    aligned = aligned.withColumns({"torn_i": repeated(F.col("all_i")), "torn_d": repeated(F.col("all_d"))})
    aligned = aligned.withColumn("at", F.filter("at", lambda a: ~F.exists(a["slots"], lambda s: F.array_contains("torn_i", s["i"]) | F.array_contains("torn_d", s["d"]))))
    covered = F.size(F.array_distinct(F.flatten(F.flatten(F.collect_list(F.transform("at", lambda a: F.sequence(a["item_at"], a["item_at"] + a["n"] - 1)))))))
    found = aligned.groupBy("doc_id", "item_id").agg(covered.alias("covered"), F.max("units").alias("units"))
    return found.where((F.col("covered") >= MIN_COVER * F.col("units")) | (F.col("covered") >= RUN)).select("doc_id", "item_id", F.round(F.col("covered") / F.col("units"), 6).alias("share"))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates; the ids found are stored first, so that Spark knows their size and broadcasts them only if they are few."""
    gone = stored(contaminated(docs, benchmark).select(F.col("doc_id").alias("gone")).distinct(), work_dir(docs.sparkSession, "leaks"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")


def op2_template_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
