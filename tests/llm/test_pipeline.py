import corpus_pipeline
from tidemark.llm import bpe


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "bpe"]


def test_repeated_lines_and_leaks_go_and_ids_come_out(spark):
    at = "/root/testdata/sf0.001"
    item = spark.read.parquet(f"{at}/benchmark.parquet").orderBy("item_id").first().text
    line = "one line that both documents hold"
    docs = spark.createDataFrame([(1, f"{line}\nfirst"), (2, f"{line}\nsecond"), (3, item)], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        if name not in ("toxicity", "near_duplicates"):
            docs = stage(spark, docs, at)
    codec = bpe.Codec(bpe.read_ranks())
    assert {r.doc_id: codec.decode(r.tokens).decode() for r in docs.collect()} == {1: f"{line}\nfirst", 2: "second"}


def test_stages_on_odd_rows(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing names, through every stage; then an empty table."""
    at = "/root/testdata/sf0.001"
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, "some words that stand here alone", 1), (1, "some words that stand here alone", 1), (2, None, 2), (3, "", 3), (None, "a text without a number of its own", 4), (4, long, 5), (5, long + " end", 6), (6, "!!!", 7), (7, "another one here", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "1 AS row", "map('a', 1) AS v", "2 AS `x.y`", "3 AS id", "'t' AS tokens")
    for first in (docs, docs.limit(0)):
        out = first
        for name, stage in corpus_pipeline.STAGES:
            before, out = out.columns, stage(spark, out, at)
            if name != "bpe":
                assert out.columns == before
        left = out.collect()
        if first is docs:
            assert sorted((r.doc_id or 0) for r in left) == [0, 1, 2, 3, 4, 6, 7] and all(r.exact in (True, None) for r in left)
        else:
            assert left == []


def test_run_against_brute_force(spark):
    """Each stage's result, held against a plain version of it on the stage's own input."""
    import numpy as np
    import pyarrow as pa

    from tests.llm.test_decontam import brute as leaks
    from tests.llm.test_line_dedup import brute as lines
    from tests.llm.test_near_dup import groups
    from tidemark.llm import near_dup as nd
    from tidemark.llm import toxicity as tox
    from tidemark.llm.words import shingles, words

    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    pairs = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    stage, now = dict(corpus_pipeline.STAGES), pairs(docs)

    chain = tox.train(docs, tox.labelled(spark, at))
    rude = lambda t: chain.score(*tox.signs(pa.array([t]))[:2], 1)[0][-1] >= tox.REJECT_AT
    want = [x for x in now if not rude(x[1])]
    out = stage["toxicity"](spark, docs, at)
    assert pairs(out) == want and len(want) < len(now)

    now, docs = want, spark.createDataFrame(out.collect(), docs.schema)
    want, out = lines(now), stage["line_dedup"](spark, docs, at)
    assert pairs(out) == sorted(want, key=str)

    now, docs = sorted(want), spark.createDataFrame(out.collect(), docs.schema)
    w = words(pa.array([t for _, t in now]))
    sig, some = nd.signatures(*shingles(w, nd.SHINGLE), len(now))
    sig = sig.astype(np.uint16)
    near = [(i, j) for i in range(len(now)) for j in range(i) if some[i] and some[j] and (sig[i] == sig[j]).mean() >= nd.THRESHOLD]
    first = groups(near, range(len(now)))
    want = [x for k, x in enumerate(now) if first[k] == k]
    out = stage["near_duplicates"](spark, docs, at)
    # banding may miss a pair just above the threshold, and never joins one below it
    gone, found = set(now) - set(want), set(now) - set(pairs(out))
    assert found <= gone and len(found) >= 0.9 * len(gone) > 0

    now, docs = pairs(out), spark.createDataFrame(out.collect(), docs.schema)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{at}/benchmark.parquet").collect()]
    out = stage["decontamination"](spark, docs, at)
    verbatim = {d for d, _, _ in leaks(now, items)}
    kept = {d for d, _ in pairs(out)}
    assert verbatim and not verbatim & kept and kept == {d for d, _ in now} - verbatim

    codec = bpe.Codec(bpe.read_ranks())
    want = {d: codec.encode(t).tolist() for d, t in pairs(out)}
    assert {r.doc_id: r.tokens for r in stage["bpe"](spark, out, at).collect()} == want
    assert {r.doc_id: r.tokens for r in corpus_pipeline.run(spark, at).collect()} == want
