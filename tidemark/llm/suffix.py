"""Repeated passages by sparse suffix sorting: deep-shallow sort of the suffixes at content-chosen anchors.

The sort is sparse: not every suffix of the corpus is sorted, but no repeated run of MIN_WORDS words is lost by it (see below; the test compares with all pairs of places). A word is covered if it lies in a run of MIN_WORDS words that occurs at two or more places of the corpus. Sorting every suffix of the corpus isn't needed for that: of every MIN_WORDS words, the run of GRAM words with the least hash is an anchor, so two equal passages hold an anchor at the same place. Anchors are shuffled by hash; a hash met once ends there. Anchors whose whole surroundings (as far as a passage that holds the anchor can reach) are equal, by a second 64-bit hash, are covered at once; one of each kind goes on. For those the surroundings are fetched, and the suffixes of one hash are sorted deep-shallow: multikey quicksort on eight bytes at a time down to SHALLOW bytes, then a blind trie for each group that is still equal. Common prefixes of neighbours give the branching points; at each the longest common text to the left decides which suffixes share MIN_WORDS words.

The result has a row for each maximal covered span: doc_id, start_word, end_word (words are counted from 0, end exclusive; they are lower-case runs of letters and digits, so case, spaces and punctuation don't matter).

Defined cases: null texts, null ids and texts below MIN_WORDS words have no spans; rows that share doc_id and text count as one place; of rows that share only the doc_id each text is a document of its own, and the spans of all of them are listed under that doc_id; a passage that repeats inside one document is covered like any other; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.words import U, mix, windows, words
from tidemark.session import stored, table, tune, work_dir

MIN_WORDS, GRAM, SHALLOW = 50, 10, 96
_STEP = U(0xC2B2AE3D27D4EB4F)
_BACK = U(pow(int(_STEP), -1, 1 << 64))


# ---- deep-shallow sorting of byte strings


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8 if x else n


def _blind_trie(s: list[bytes], group: list[int]) -> list[int]:
    """The group in order. An inner node is [depth, {byte: child}]; -1 stands for a string that ends there."""
    root: list | int = [group[0]]
    for i in group[1:]:
        t, node = s[i], root
        while len(node) == 2:  # down blindly, to any leaf of the likeliest branch
            c = t[node[0]] if node[0] < len(t) else -1
            node = node[1].get(c) or next(iter(node[1].values()))
        other = s[node[0]]
        d = common(t, other)
        if d == len(t) == len(other):
            node.extend((None, i)) if len(node) == 1 else node.append(i)
            continue
        parent, key, node = None, None, root
        while len(node) == 2 and node[0] < d:
            parent, key = node, t[node[0]] if node[0] < len(t) else -1
            node = node[1][key]
        c = t[d] if d < len(t) else -1
        if len(node) == 2 and node[0] == d:
            node[1][c] = [i]
            continue
        split = [d, {c: [i], (other[d] if d < len(other) else -1): node}]
        if parent is None:
            root = split
        else:
            parent[1][key] = split
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 2:
            stack.extend(node[1][k] for k in sorted(node[1], reverse=True))
        else:
            out.append(node[0])
            out.extend(node[2:])
    return out


def deep_shallow(s: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices of s in byte order; equal strings in order of index."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(s))), 0)]
    while stack:
        group, d = stack.pop()
        if len(group) < 2:
            out.extend(group)
        elif len(group) == 2:
            a, b = group
            out.extend((b, a) if s[b] < s[a] else (a, b))
        elif d >= shallow:
            out.extend(_blind_trie(s, group))
        else:
            pivot = s[group[len(group) // 2]][d : d + 8]
            less, same, more = [], [], []
            for i in group:
                x = s[i][d : d + 8]
                (less if x < pivot else more if x > pivot else same).append(i)
            stack.append((more, d))
            if len(pivot) < 8:  # all of them end here
                stack.extend(([i], d) for i in reversed(same))
            else:
                stack.append((same, d + 8))
            stack.append((less, d))
    return out


def cover(contexts: list[tuple[bytes, bytes]], least: int = MIN_WORDS) -> list[tuple[int, int] | None]:
    """For each (left, right) how many words to the left and right are covered, over the pairs that share least words. left: the words before the anchor from the last to the first, each reversed and between spaces; right: the words from the anchor on, each followed by a space."""
    rights = [r for _, r in contexts]
    order = deep_shallow(rights)
    lcp = [rights[a][: common(rights[a], rights[b])].count(b" ") for a, b in zip(order, order[1:])]
    best: list[tuple[int, int] | None] = [None] * len(contexts)

    def node(i: int, j: int, depth: int) -> None:
        need = max(0, least - depth)
        members = order[i : j + 1]
        members.sort(key=lambda m: contexts[m][0])
        gaps = [max(0, contexts[a][0][: common(contexts[a][0], contexts[b][0])].count(b" ") - 1) for a, b in zip(members, members[1:])]
        for k, m in enumerate(members):
            left = max(gaps[k - 1] if k else -1, gaps[k] if k < len(gaps) else -1)
            if left >= need:
                old = best[m] or (0, 0)
                best[m] = (max(old[0], left), max(old[1], depth))

    stack: list[tuple[int, int]] = []  # (depth, first position) of the open branching points
    for k, d in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            node(first, k, depth)
        if d >= 0 and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return best


# ---- the passes over the corpus


def _least(x: np.ndarray, n: int, how) -> np.ndarray:
    """how (minimum or maximum) of x[i : i + n], for each i with that many."""
    done = 1
    out = x
    while done * 2 <= n:
        out = how(out[:-done], out[done:])
        done *= 2
    return how(out[: len(x) - n + 1], out[n - done :]) if n > done else out


def _anchors(least: int, gram: int):
    """hash, surroundings' hash, doc_id, word, and the words of the surroundings to the left and right, of each anchor."""
    span = least - gram + 1

    def run(batches):
        for b in batches:
            w = words(b.column("text"))
            n = len(w.hash)
            if n < least:
                continue
            with np.errstate(over="ignore"):
                at, h = windows(w, gram)
                g = np.full(n, ~U(0), dtype=np.uint64)
                g[at] = h | U(1)
                low = _least(g, span, np.minimum)[: n - least + 1]
                whole = w.row[: n - least + 1] == w.row[least - 1 :]
                high = _least(np.concatenate([np.zeros(span - 1, np.uint64), np.where(whole, low, U(0)), np.zeros(n - len(low), np.uint64)]), span, np.maximum)
                p = np.flatnonzero(high == g)
                rows = w.row[p]
                a = np.maximum(p - (least - gram), w.first[rows])
                z = np.minimum(p + least, w.first[rows + 1])
                power = np.full(n + 1, _STEP, dtype=np.uint64)
                power[0] = 1
                power = np.cumprod(power)
                back = np.full(n + 1, _BACK, dtype=np.uint64)
                back[0] = 1
                back = np.cumprod(back)
                total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash) * power[:n])])
                around = mix((total[z] - total[a]) * back[a] + mix((z - a).astype(np.uint64)) * U(3) + (p - a).astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(g[p].view(np.int64)),
                    pa.array(around.view(np.int64)),
                    b.column("doc").take(pa.array(rows)),
                    pa.array((p - w.first[rows]).astype(np.int32)),
                    pa.array((p - a).astype(np.int16)),
                    pa.array((z - p).astype(np.int16)),
                ],
                names=["hash", "around", "doc", "word", "before", "after"],
            )

    return run


def _fetch(batches):
    """The surroundings of the wanted anchors, as two byte strings."""
    for b in batches:
        w = words(b.column("text"))
        size = w.end - w.start
        inside = np.repeat(w.start - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else np.zeros(0, np.int64)
        out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
        out[np.arange(len(inside)) + np.repeat(np.arange(len(size)), size)] = w.data[inside]
        text, cut = out.tobytes(), np.concatenate([[0], np.cumsum(size + 1)])
        wanted = b.column("wanted")
        row = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
        f = wanted.flatten()
        p = f.field("word").to_numpy() + w.first[row]
        a, m, z = cut[p - f.field("before").to_numpy()], cut[p], cut[p + f.field("after").to_numpy()]
        left = [b" " + text[i:j] for i, j in zip(a.tolist(), m.tolist())]
        yield pa.RecordBatch.from_arrays(
            [f.field("hash"), b.column("doc").take(pa.array(row)), f.field("word"), f.field("single"), pa.array([x[::-1] for x in left], pa.binary()), pa.array([text[i:j] for i, j in zip(m.tolist(), z.tolist())], pa.binary())],
            names=["hash", "doc", "word", "single", "left", "right"],
        )


def _compare(least: int):
    def run(batches):
        """Covered spans from rows sorted by hash; a group may go on in the next batch. A place that comes twice counts once."""
        now, group = None, {}
        out: list[tuple[int, int, int, int]] = []

        def close():
            for (doc, th, word), single, c in zip(group, (x[0] for x in group.values()), cover([x[1:] for x in group.values()], least) if len(group) > 1 else []):
                if single and c:
                    out.append((doc, th, word - c[0], word + c[1]))

        def batch():
            a, b, c, d = (pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32())))
            return pa.RecordBatch.from_arrays([a, b, c, d], names=["id", "th", "a", "z"])

        for b in batches:
            for h, doc, th, word, *x in zip(*(b.column(c).to_pylist() for c in ("hash", "id", "th", "word", "single", "left", "right"))):
                if h != now:
                    close()
                    now, group = h, {}
                group[doc, th, word] = tuple(x)
            if len(out) > 20_000:
                yield batch()
                out.clear()
        close()
        yield batch()

    return run


def repeated_spans(docs: DataFrame, least: int = MIN_WORDS, gram: int = GRAM) -> DataFrame:
    """doc_id, start_word, end_word of each maximal span of words that lie in a repeated run of least words."""
    spark = tune(docs.sparkSession)
    work = work_dir(spark, "suffix")
    doc = "id long, th long"
    own = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("th")).alias("doc"), "text")
    found = own.mapInArrow(_anchors(least, gram), "hash long, around long, doc struct<id: long, th: long>, word int, before short, after short")
    same, kind = Window.partitionBy("hash"), Window.partitionBy("hash", "around")
    place = F.struct("doc", "word")
    kinds = (
        found.withColumn("k0", F.min("around").over(same))
        .withColumn("k1", F.max("around").over(same))
        .withColumn("p0", F.min(place).over(kind))
        .withColumn("p1", F.max(place).over(kind))
        .where("k0 != k1 OR p0 != p1")
        .select("hash", "doc", "word", "before", "after", (F.col("p0") == F.col("p1")).alias("single"), ((F.col("k0") != F.col("k1")) & (F.col("p0") == place)).alias("fetch"))
    )
    kinds = stored(kinds, f"{work}/anchors")
    whole = kinds.where("NOT single").select("doc.*", (F.col("word") - F.col("before")).alias("a"), (F.col("word") + F.col("after")).alias("z"))
    wanted = kinds.where("fetch").groupBy("doc").agg(F.collect_set(F.struct("hash", "word", "before", "after", "single")).alias("wanted"))
    rows = own.join(wanted, "doc").select("doc", "text", "wanted").mapInArrow(_fetch, "hash long, doc struct<id: long, th: long>, word int, single boolean, left binary, right binary")
    part = rows.select("hash", "doc.*", "word", "single", "left", "right").repartition("hash").sortWithinPartitions("hash").mapInArrow(_compare(least), f"{doc}, a int, z int")
    spans = whole.unionByName(part)
    order = Window.partitionBy("id", "th").orderBy("a", "z")
    reach = F.max("z").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isles = spans.withColumn("new", F.when(F.col("a") <= reach, 0).otherwise(1)).withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return isles.groupBy("id", "th", "isle").agg(F.min("a").alias("start_word"), F.max("z").alias("end_word")).select(F.col("id").alias("doc_id"), "start_word", "end_word")


def op6_suffix_dedup(spark, sf_dir):
    return repeated_spans(table(spark, sf_dir, "documents"))
