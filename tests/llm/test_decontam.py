import random

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm.decontam import FILTER_BITS, MIN_COVER, RUN, WINDOW, Template, bloom, clean_documents, contaminated

PEOPLE = "Alice buys apples at the market. Alice sells them near the old bridge. Alice keeps the rest for later."
SUM = "12 + 7 - 3 * 4 = 27 and 8 * 9 - 5 + 6 = 73"
LONG = "the farmer carried 12 baskets across the muddy field before dawn while rain fell on the silent village and nobody saw the 12 lanterns burning behind the closed shutters of the mill by the river"


@pytest.mark.parametrize(
    "item, text, found",
    [
        (PEOPLE, PEOPLE.replace("Alice", "Brenda"), True),
        (PEOPLE, PEOPLE.lower(), True),
        (PEOPLE, PEOPLE.title(), True),
        (PEOPLE, PEOPLE.replace(" ", "\n"), True),
        (SUM, "see: " + SUM, True),
        (SUM, SUM.replace("7", "5").replace("9", "4"), False),
        (LONG, LONG.replace("12", "30", 1), True),
        (LONG, "a wholly different text about ships that cross the sea in winter with grain and wool", False),
        # all windows hold a slot whose values disagree: another question
        ("add 3 to 4 and then take away 3 again now", "add 5 to 4 and then take away 6 again now", False),
        ("Tom buys 3 apples for 5 dollars", "Anna buys 7 apples for 9 dollars", True),
        # one value stands for two: another question
        ("Tom buys 3 apples for 5 dollars", "Anna buys 4 apples for 4 dollars", False),
        ("сколько яблок осталось у мальчика после долгой прогулки по старому лесу", "СКОЛЬКО ЯБЛОК ОСТАЛОСЬ У МАЛЬЧИКА ПОСЛЕ ДОЛГОЙ ПРОГУЛКИ ПО СТАРОМУ ЛЕСУ", True),
        ("вчера Иван купил 3 яблока и отнёс их домой через старый лес", "вчера Пётр купил 8 яблока и отнёс их домой через старый лес", True),
        ("İstanbul is the city that the sailors saw first from the ship at dawn", "İSTANBUL IS THE CITY THAT THE SAILORS SAW FIRST FROM THE SHIP AT DAWN", True),
    ],
)
def test_leaks(spark, item, text, found):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()] == ([(1, 7)] if found else [])


def brute(docs, items):
    """Verbatim windows compared pair by pair as lists of lower-case words, without hashes, filter and joins. For texts without slots."""
    words = lambda t: [] if t is None else "".join(c if c.isalnum() else " " for c in t.lower()).split()
    out = set()
    for d, t in docs:
        own = words(t)
        for i, u in items:
            item = words(u)
            n = min(WINDOW, len(item))
            if not n or d is None:
                continue
            seen = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            # covered units by alignment, as windows only count together along one shift, then all together
            covered = set()
            for k in range(len(item) - n + 1):
                if tuple(item[k : k + n]) in seen:
                    covered |= set(range(k, k + n))
            if len(covered) >= MIN_COVER * len(item) or len(covered) >= RUN:
                out.add((d, i, round(len(covered) / len(item), 6)))
    return out


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [w + x for w in "ka lo mi ru te no".split() for x in "ba di fo gu".split()]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    items = [(i, text(r.choice([3, 6, 8, 12, 30, 60]))) for i in range(25)]
    docs = []
    for d in range(60):
        parts = [text(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            t = r.choice(items)[1].split()
            a = r.randint(0, len(t) - 1)
            parts += [" ".join(t[a : a + r.randint(1, 60)]), text(r.randint(0, 20))]
        docs.append((d, " ".join(parts)))
    docs += [(100, None), (101, ""), (None, items[0][1]), (102, items[3][1]), (102, items[3][1])]
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {tuple(x) for x in got.collect()} == brute(docs, items)


def test_filter_holds_every_hash(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 1000)
    bits = bloom(spark.createDataFrame(pa.table({"hash": h})))
    u = h.view(np.uint64)
    for at in ((u >> np.uint64(64 - FILTER_BITS)), (u & np.uint64((1 << FILTER_BITS) - 1))):
        assert all(int(bits[int(a) >> 6]) >> (int(a) & 63) & 1 for a in at)


def test_cases(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(7, LONG), (7, LONG), (8, None), (9, ""), (None, LONG)], "item_id long, text string")
    assert contaminated(none, items).count() == 0
    docs = spark.createDataFrame([(1, LONG, 5, "x"), (2, "clean words only here", 6, "y"), (3, None, 7, "z"), (4, "x " * 400_000 + LONG, 8, "w"), (None, LONG, 9, "v")], "doc_id long, text string, hash int, `item.id` string")
    assert contaminated(docs, items.limit(0)).count() == 0
    assert sorted(tuple(r) for r in contaminated(docs, items).collect()) == [(1, 7, 1.0), (4, 7, 1.0)]
    left = clean_documents(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 2, 3]


def test_numbers_are_one_unit():
    t = Template(pa.array(["pay 1,000.50 now", None, ""]))
    assert t.kinds[0].tolist() == [0, 1, 0]
