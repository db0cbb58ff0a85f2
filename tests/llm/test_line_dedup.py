import random
import time

import pytest

from tidemark.llm.line_dedup import dedup_lines, repeated_lines


def brute(rows):
    """One pass over all lines in order; Spark's text hash orders texts of one number, so tests with such texts only look at what doesn't depend on it."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    seen, cut = {}, {}
    for k in order:
        d, t = rows[k]
        if t is None:
            continue
        out = []
        for i, line in enumerate(t.split("\n")):
            key = line.strip(" \t\r")
            if key and seen.setdefault(key, (d, t, i)) != (d, t, i):
                continue
            out.append(line)
        cut[k] = out
    left = []
    for k, (d, t) in enumerate(rows):
        if t is None or cut[k] == t.split("\n"):
            left.append((d, t))
        elif any(x.strip(" \t\r") for x in cut[k]):
            left.append((d, "\n".join(cut[k])))
    return sorted(left, key=str)


@pytest.mark.parametrize("batches, fanout", [(1, 2), (4, 3), (9, 2)])
def test_against_one_pass(spark, batches, fanout):
    r = random.Random(batches)
    lines = [f"line {i}" for i in range(40)] + ["", "  ", "\tline 3 ", "line 4\r"]
    rows = [(i, "\n".join(r.choices(lines, k=r.randint(0, 9)) + [f"own {r.randint(0, 60)}"] * r.randint(0, 2))) for i in range(80)]
    rows += [(200, None), (201, ""), (None, "line 1\nnull's own"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((x.doc_id, x.text) for x in dedup_lines(docs, batches, fanout).collect()), key=str) == brute(rows)


def test_names_counts_and_rows_that_share_a_number(spark):
    rows = [(1, "a\nb", 3, {"x": 1}, 5, 6), (1, "b\nc", 3, {"x": 2}, 5, 6), (2, "a\nd", 3, None, 5, 6), (3, "a\nb", 3, None, 5, 6)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars long, lines map<string,int>, __id int, `x.y` int")
    out = dedup_lines(docs)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text, r.n_chars) for r in out.collect()}
    # one of the two texts of number 1 keeps line b
    assert got - {(1, "a\nb", 3), (1, "c", 1), (1, "a", 1), (1, "b\nc", 3)} == {(2, "d", 1)} and len(got) == 3


def test_no_tables_stay_behind(spark):
    before = len(spark.catalog.listTables())
    repeated_lines(spark.createDataFrame([(1, "a\na")], "doc_id long, text string")).count()
    assert len(spark.catalog.listTables()) == before


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_time_is_linear_in_a_text(spark):
    def took(n):
        text = "\n".join(f"line {i} of the text" for i in range(n))
        t = time.time()
        assert [(r.doc_id, r.text) for r in dedup_lines(spark.createDataFrame([(1, text), (2, text + "\nown")], "doc_id long, text string")).collect()] == [(1, text), (2, "own")]
        return time.time() - t

    took(100)
    assert took(64_000) < 8 * took(4_000) + 8
