import random

import pytest

from tidemark.llm import suffix


def words(text):
    return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split()


def brute(rows, least):
    """Every run of least words at every place, compared with all others."""
    docs = sorted({(d, t) for d, t in rows if d is not None and t is not None})
    places = {}
    for k, (_, t) in enumerate(docs):
        w = words(t)
        for i in range(len(w) - least + 1):
            places.setdefault(tuple(w[i : i + least]), []).append((k, i))
    covered = {}
    for at in places.values():
        for k, i in at if len(at) > 1 else []:
            covered.setdefault(k, set()).update(range(i, i + least))
    out = []
    for k, own in covered.items():
        start = None
        for i in range(max(own) + 2):
            if i in own and start is None:
                start = i
            elif i not in own and start is not None:
                out.append((docs[k][0], start, i))
                start = None
    return sorted(out)


def found(spark, rows, least, gram):
    return sorted(map(tuple, suffix.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS `doc.id`"), least, gram).collect()))


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs_of_places(spark, seed):
    r = random.Random(seed)
    few = ["ab", "cd", "ef"] if seed == 0 else [f"w{i}" for i in range(40)]
    passages = [" ".join(r.choices(few, k=r.randint(3, 30))) for _ in range(8)]
    rows = []
    for d in range(40):
        parts = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(passages).split()
            a = r.randint(0, len(p) - 1)
            parts += p[a:] if r.random() < 0.5 else p
            parts += r.choices(few, k=r.randint(0, 12))
        rows.append((d, " ".join(parts).title()))
    rows += rows[:3] + [(5, rows[6][1] + " other"), (100, None), (101, ""), (None, rows[0][1])]
    assert found(spark, rows, 8, 3) == brute(rows, 8)


def test_row_stored_twice_is_one_place(spark):
    r = random.Random(1)
    text = lambda: [f"x{r.randint(0, 10**6)}" for _ in range(60)]
    shared = text()[:20]
    a, b = " ".join(text() + shared + text()), " ".join(text() + shared + text())
    assert found(spark, [(1, a), (1, a), (2, b)], 50, 10) == []
    assert found(spark, [(1, a), (1, b), (2, b)], 50, 10) == brute([(1, a), (1, b), (2, b)], 50) != []


def test_empty_table(spark):
    assert found(spark, [], 50, 10) == []


@pytest.mark.parametrize("shallow", [0, 8, 96])
def test_deep_shallow_sorts(shallow):
    r = random.Random(shallow)
    s = [bytes(r.choices(b"ab", k=r.randint(0, 40))) for _ in range(300)] + [b"", b"a" * 5000, b"a" * 5001, b"a" * 5000]
    order = suffix.deep_shallow(s, shallow)
    assert sorted(order) == list(range(len(s))) and [s[i] for i in order] == sorted(s)
