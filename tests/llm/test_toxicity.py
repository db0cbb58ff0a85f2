import random

import numpy as np
import pytest

from tidemark.llm import toxicity as tox

BAD = ["grolm", "vexxit", "plarn"]


def corpus(n=600, seed=1):
    """A fifth of the documents is rude, by one of three words; these make low quality likelier."""
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 400)}" for _ in range(r.randint(5, 80))]
        toxic = r.random() < 0.2
        if toxic:
            w[r.randint(0, len(w) - 1)] = r.choice(BAD)
        low = r.random() < (0.7 if toxic else 0.1)
        if low:
            w += ["filler"] * 3
        rows.append((i, " ".join(w)))
        labels.append((i, int(low), int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, low_quality int, toxic int")


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    docs, known = frames(spark, rows, labels[:400])
    got = {r.doc_id for r in tox.toxic_documents(docs, known).collect()}
    held = [x for x in labels if x[0] >= 400]
    caught = np.mean([x[0] in got for x in held if x[2]])
    left = np.mean([x[0] not in got for x in held if not x[2]])
    assert caught >= 0.95 and left >= 0.98


def test_later_models_see_earlier_categories():
    """The second category is the first one again, but its own rows have no sign: only the chain can tell."""
    r = np.random.default_rng(3)
    first = (r.random(900) < 0.4).astype(float)
    signs = [np.unique(np.append(r.integers(0, 1000, 20), [5000] if f and r.random() < 0.9 else [6000])) for f in first]
    chain = tox.fit_chain(("a", "b"), signs, np.stack([first, first], axis=1), np.arange(900)[:, None] * np.ones((1, 5), np.int64))
    assert chain.betas[1][-2] > 0.5  # the weight of the earlier probability


def test_no_labels_reject_nothing(spark):
    rows, labels = corpus(50)
    for known in ([], [(0, 0, 0)], [(0, 1, 1)], [(i, 0, 1) for i in range(50)], [(3, None, 1), (4, 0, 7), (None, 1, 1)]):
        docs, k = frames(spark, rows, known)
        assert tox.drop_toxic(docs, docs, k).count() == 50
        assert tox.toxic_documents(docs, k).count() == 0


def test_copies_share_a_vote():
    """A sign that only the copies of one passage have isn't learnt."""
    base = [np.array([1, 2, 3])] * 50 + [np.array([10 + i % 7, 50 + i % 5]) for i in range(200)]
    y = np.array([[1.0]] * 50 + [[float(i % 2)] for i in range(200)])
    copies = np.array([[1] * 5] * 50 + [[1000 + i] * 5 for i in range(200)])
    assert not np.isin([1, 2, 3], tox.fit_chain(("t",), base, y, copies).chosen).any()


def test_cases(spark):
    rows, labels = corpus(300)
    more = [(1000, None), (1001, ""), (None, BAD[0]), (1002, f"{BAD[0]} " + "w1 " * 300_000), (1003, "x " * 300_000), rows[0], rows[0]]
    docs, known = frames(spark, rows + more, labels + labels[:20] + [(None, 1, 1)])
    docs = docs.selectExpr("*", "1 AS toxic", "2 AS signs", "3 AS `a.b`")
    left = tox.drop_toxic(docs, docs, known)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert {1000, 1001, 1003} <= set(ids) and None not in ids
    assert tox.toxic_documents(docs.limit(0), known).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_query_against_scores_of_single_texts(spark, sf):
    at = f"/root/testdata/{sf}"
    docs = spark.read.parquet(f"{at}/documents.parquet").select("doc_id", "text")
    chain = tox.train(docs, tox.labelled(spark, at))
    import pyarrow as pa

    want = {}
    for r in docs.collect():
        rows, s, _ = tox.signs(pa.array([r.text]))
        p = chain.score(rows, s, 1)[0]
        if p[-1] >= tox.REJECT_AT:
            want[r.doc_id] = tuple(np.round(p, 6))
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in tox.op4_toxicity_chain(spark, at).collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=2e-6) for k in got)
