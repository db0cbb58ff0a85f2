import random

import numpy as np
import pytest

from tidemark.llm import near_dup as nd
from tidemark.session import stored, work_dir


def shingles(text):
    w = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in text.lower()).split()
    return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()


def corpus(r):
    text = lambda n: [f"w{r.randint(0, 3000)}" for _ in range(n)]
    rows, i = [], 0
    for _ in range(60):
        base = text(r.randint(20, 200))
        for _ in range(r.choice([1, 1, 2, 3, 8])):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 2, len(t) // 40])):
                t[r.randint(0, len(t) - 1)] = f"w{r.randint(0, 3000)}"
            rows.append((i, " ".join(t)))
            i += 1
    return rows


def groups(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_groups_against_all_pairs(spark):
    rows = corpus(random.Random(4))
    got = {(r.doc_id, r.duplicate_of) for r in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    s = {i: shingles(t) for i, t in rows}
    jaccard = lambda a, b: len(s[a] & s[b]) / len(s[a] | s[b])
    pairs = [(a, b) for a in s for b in s if a < b]
    sure = groups([p for p in pairs if jaccard(*p) >= 0.6], s)
    most = groups([p for p in pairs if jaccard(*p) >= 0.3], s)
    want = {(n, g) for n, g in sure.items() if n != g}
    assert len(want) > 50 and len(got & want) >= 0.95 * len(want)
    assert all(most[a] == most[b] for a, b in got)


def test_estimate_is_close():
    r = random.Random(2)
    words = [f"w{i}" for i in range(400)]
    a = words[:300]
    for share in (30, 100, 200):
        b = words[share:][:300]
        ha, hb = (np.array([hash(x) & (2**64 - 1) for x in s], dtype=np.uint64) for s in (a, b))
        h, rows = np.concatenate([ha, hb]), np.repeat([0, 1], [len(ha), len(hb)])
        with np.errstate(over="ignore"):
            sig, some = nd.signatures(rows, nd.mix(h), 2)
        assert some.all()
        real = len(set(a) & set(b)) / len(set(a) | set(b))
        assert abs((sig[0] == sig[1]).mean() - real) < 0.15
    assert r


def test_pairs_are_linear_in_a_bucket_of_unlike_documents(spark):
    n = 2000
    rng = np.random.default_rng(5)
    sig = rng.integers(0, 1 << 16, (n, nd.BINS), dtype=np.uint16)
    sig[:, :4] = 7  # all share one band, nothing else
    frame = spark.createDataFrame([(i, 0, bytearray(x.astype(">u2").tobytes())) for i, x in enumerate(sig)], "id long, th long, sig binary").selectExpr("struct(id, th) AS v", "sig")
    pairs = nd.candidates(frame)
    assert n - 1 <= pairs.count() <= 2 * (n - 1)
    edges = nd.similar_edges(stored(frame, work_dir(spark, "t") + "/s"), work_dir(spark, "t"))
    assert edges.count() == 0


def test_unlike_centre_loses_no_copies(spark):
    """All documents share a passage, so that buckets hold many unlike ones; a pair of near copies is found all the same."""
    r = random.Random(8)
    text = lambda n: [f"w{r.randint(0, 10**6)}" for _ in range(n)]
    passage = text(60)
    rows = [(i, " ".join(passage + text(100))) for i in range(300)]
    twin = passage + text(100)
    rows += [(400, " ".join(twin)), (500, " ".join(twin[:150] + text(3)))]
    assert {tuple(x) for x in nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {(500, 400)}


def test_cases(spark):
    long = " ".join(f"v{i}" for i in range(200_000))
    rows = [(1, "one two three four five", {"a": 1}, 1), (2, "One two, three four five!", {"a": 2}, 1), (2, "One two, three four five!", {"a": 2}, 1), (3, None, None, 1), (4, "", None, 1), (None, "one two three four five", None, 1), (5, "x", None, 1), (6, "y", None, 1), (7, "X.", None, 1), (8, long, None, 1), (9, long + " end", None, 1), (1, "another text for the same number", None, 1), (10, "!!!", None, 1), (10, "!!!", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, v map<string,int>, `sig.x` int")
    assert sorted(tuple(x) for x in nd.near_duplicates(docs).distinct().collect()) == [(2, 1), (7, 5), (9, 8)]
    left = nd.keep_one(docs)
    assert left.columns == docs.columns
    # rows without words stay, even twice
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted([(1, rows[0][1]), (3, ""), (4, ""), (0, rows[5][1]), (5, "x"), (6, "y"), (8, long), (1, rows[11][1]), (10, "!!!"), (10, "!!!")])
    assert nd.near_duplicates(docs.limit(0)).count() == 0 and nd.keep_one(docs.limit(0)).count() == 0


def test_repeated_rows_leave_one(spark):
    docs = spark.createDataFrame([(1, "one two three four", 2), (1, "one two three four", 1), (1, "one two three four", 2)], "doc_id long, text string, n int")
    assert [tuple(r) for r in nd.keep_one(docs).collect()] == [(1, "one two three four", 1)]


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_a_path(spark, n):
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    got = nd.components(edges, work_dir(spark, "path"))
    assert sorted(tuple(r) for r in got.collect()) == [(i, 0) for i in range(1, n + 1)]
