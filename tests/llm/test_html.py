import random
from html.parser import HTMLParser

import numpy as np
import pytest

from tidemark.llm import html as h


class Flat(HTMLParser):
    """The same blocks by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.now, self.linked, self.a, self.skip = [], [], [], False, None

    def close_block(self):
        text = " ".join("".join(self.now).split())
        if text:
            self.out.append((text, len(text.split()), sum(len(x.split()) for x in self.linked)))
        self.now, self.linked = [], []

    def handle_starttag(self, tag, attrs):
        if self.skip:
            return
        if tag in h._BLOCK:
            self.close_block()
        elif tag == "a":
            self.a = True
        elif tag in h._SKIP:
            self.skip = tag

    def handle_endtag(self, tag):
        if self.skip:
            self.skip = None if tag == self.skip else self.skip
        elif tag in h._BLOCK:
            self.close_block()
        elif tag == "a":
            self.a = False

    def handle_data(self, data):
        if not self.skip:
            self.now.append(data)
            if self.a:
                self.linked.append(data)


def brute_blocks(page):
    p = Flat()
    p.feed(page)
    p.close()
    p.close_block()
    return p.out


def walk(tree, x):
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def brute(page, tree):
    b = brute_blocks(page)
    d = lambda k: (b[k][1], min(1.0, b[k][2] / max(1, b[k][1]))) if 0 <= k < len(b) else (0, 0.0)
    return "\n".join(b[k][0] for k in range(len(b)) if walk(tree, [*d(k - 1), *d(k), *d(k + 1)]) >= 0.5), len(b)


def test_query_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    x, y, _ = h.labelled_table()
    tree = h.fit_tree(x, y)
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = h.op1_html_extraction(spark, at).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.blocks) == brute(pages[r.page_id], tree)
        assert r.kept == (r.text.count("\n") + 1 if r.text else 0)


def test_tree_on_pages_left_out():
    x, y, page = h.labelled_table()
    right = sum(((h.predict(h.fit_tree(x[page != k], y[page != k]), x[page == k]) >= 0.5) == y[page == k]).sum() for k in range(page.max() + 1))
    assert right / len(y) >= 0.95


def test_first_split_is_the_best():
    r = np.random.default_rng(1)
    x = r.integers(0, 6, (60, 6)).astype(float)
    y = (x[:, 2] > 3).astype(float)
    gini = lambda m: sum(k.sum() * y[k].mean() * (1 - y[k].mean()) for k in (m, ~m) if k.any())
    j, t, *_ = h.fit_tree(x, y)
    assert gini(x[:, j] <= t) == min(gini(x[:, a] <= b) for a in range(6) for b in np.arange(0.5, 6)) == 0


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain & simple", [("plain & simple", 3, 0)]),
        ("<p>a <a href='x'>b c</a> d</p>e", [("a b c d", 4, 2), ("e", 1, 0)]),
        ("<p>wo<b>rd</b>&amp;&eacute;</p>", [("word&é", 1, 0)]),
        ("<script>var a = '<p>no</p>'</script>yes<!-- <p>no --><style>p{}</style>", [("yes", 1, 0)]),
        ("yes<script>never closed <p>no", [("yes", 1, 0)]),
        ("yes<!-- never closed", [("yes", 1, 0)]),
        ("1 < 2 <br> 3 > 2", [("1 < 2", 3, 0), ("3 > 2", 3, 0)]),
        ("<DIV>Upper</DIV><TiTlE>no</tItLe>", [("Upper", 1, 0)]),
    ],
)
def test_blocks(page, want):
    assert h.blocks(page) == want


def test_random_tags_against_the_parser():
    r = random.Random(4)
    parts = ["<p>", "</p>", "<div class='a b'>", "</div>", "<a href=\"/x?y=1\">", "</a>", "<b>", "</b>", " word ", "two words", "&amp;", "&lt;p&gt;", "<br/>", "<li>", "<!-- note -->", "<img src=x>", "\n"]
    for _ in range(300):
        page = "".join(r.choices(parts, k=30))
        assert h.blocks(page) == brute_blocks(page)


def test_cases(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "<p>" + "word " * 30, "x"), (3, "<p>" + "word " * 500_000, "x"), (3, "<p>" + "word " * 500_000, "x"), (4, "<" * 200_000, "x"), (5, "<a <b " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id int, html string, text string").selectExpr("*", "1 AS blocks", "2 AS `a.b`")
    got = {(r.page_id, r.text if r.text is None else len(r.text), r.blocks) for r in h.extract(pages).collect()}
    assert {(1, None, 0), (2, 0, 0), (None, 149, 1), (3, 2_499_999, 1)} <= got
    assert h.extract(pages.limit(0)).count() == 0
