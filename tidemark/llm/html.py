"""Main text of web pages: flat text blocks, classified by a decision tree on word counts and link densities.

A page is cut into a flat list of text blocks at block-level tags; inline tags are dropped, and what stands inside head, script, style and the like is no text. A block has a word count and a link density (the share of its words inside links). The tree sees both for the block and for its two neighbours. It is a CART trained on the driver from LABELLED, a small table of blocks of pages labelled by hand; the trained tree goes to the scan, where each batch's blocks are classified at once. There is no shuffle.

Defined cases: a null html gives a null text and no blocks, an empty one an empty text; a tag ends at its first ">" and holds no "<", other "<" are text; a comment or script that isn't closed reaches to the end of the page; rows with a null or repeated page_id are pages like others, each gives its row; extra columns are never read; an empty table gives an empty one.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import table, tune

#: Pages labelled by hand: their blocks as words/linked words, "+" for main text.
LABELLED = """
1/1 1/1 1/1 1/1 1/1 1/1 9/0 +9/0 +31/0 +44/0 +18/1 +52/0 7/0
1/1 1/1 2/2 1/1 1/1 1/1 12/0 +12/0 +8/0 +63/0 +4/0 +25/0 +71/0 +12/0 11/0
2/2 1/1 1/1 1/1 8/0 +6/0 +3/0 +2/0 +40/0 +5/0 +36/0 9/0
1/1 2/2 1/1 2/2 3/3 10/0 +11/0 +120/2 +96/1 +7/0 +150/3 +88/0 6/0
1/1 1/1 1/1 1/1 1/1 1/1 6/0 +15/0 +240/0 +180/0 10/0
1/1 1/1 1/1 1/1 1/1 1/1 11/0 +5/0 +1/0 +14/0 +2/0 8/0
3/3 2/2 2/2 +10/0 +55/0 +60/4 +33/0 5/5 6/6 4/4 8/2
2/2 2/2 4/4 +7/0 +9/0 +80/0 +45/0 +61/5 3/3 3/3 12/12 14/0
5/5 6/6 4/4 7/7 3/0 6/6 8/8 5/5 2/2 9/3
1/1 1/1 1/1 4/0 10/10 12/12 9/9 11/11 3/3 5/0
2/1 3/3 1/1 +8/0 +22/0 +17/0 +30/2 +26/0 2/2 1/1 4/2
+12/0 +70/0 +48/1 +53/0
+6/0 +38/0 +29/0 +64/0 2/2 2/2 7/0
1/1 1/1 2/2 1/1 1/1 2/2 7/0 +4/0 +9/0 +9/0 +11/0 +6/0 +45/0 9/0
1/1 1/1 1/1 1/1 1/1 1/1 13/0 +10/0 +300/0 7/0
1/1 1/1 1/1 1/1 1/1 1/1 9/0 +1/0 +2/0 12/0
1/1 1/1 1/1 10/0 +9/0 +41/0 +27/0 +66/1 15/0
1/1 1/1 2/2 1/1 8/0 +13/0 +7/0 +90/0 +3/0 +58/0 16/0
2/2 1/1 1/1 1/1 14/0 +8/0 +33/0 +21/0 +47/0 13/0
1/1 2/2 1/1 7/0 +11/0 +75/2 +15/0 +39/0 17/1
+9/0 +26/0 +41/0 +24/0
2/2 2/2 2/2 1/0 +9/0 +14/0 +77/3 +20/0 3/3 4/4 4/4 5/5 16/4
"""
DEPTH, LEAST_LEAF = 6, 2
FEATURES = ("words before", "density before", "words", "density", "words after", "density after")

_BLOCK = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
_SKIP = frozenset("head script style noscript template textarea title svg math iframe object select button".split())
_TOKEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/<>]*)[^<>]*>|[!?][^<>]*>)")
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in _SKIP}


def blocks(html: str) -> list[tuple[str, int, int]]:
    """(text, words, linked words) of each block with words, in order."""
    out: list[tuple[str, int, int]] = []
    now: list[str] = []
    linked: list[str] = []
    at, inside = 0, False

    def close() -> None:
        text = " ".join(unescape("".join(now)).split())
        if text:
            out.append((text, text.count(" ") + 1, sum(len(unescape(x).split()) for x in linked)))
        now.clear()
        linked.clear()

    def add(text: str) -> None:
        if text:
            now.append(text)
            if inside:
                linked.append(text)

    while m := _TOKEN.search(html, at):
        add(html[at : m.start()])
        at = m.end()
        if m[1]:
            end = html.find("-->", at)
            at = end + 3 if end >= 0 else len(html)
            continue
        tag = (m[3] or "").lower()
        if tag in _BLOCK:
            close()
        elif tag == "a":
            inside = not m[2]
        elif tag in _SKIP and not m[2] and not m[0].endswith("/>"):
            end = _CLOSE[tag].search(html, at)
            at = end.end() if end else len(html)
    add(html[at:])
    close()
    return out


def features(words: np.ndarray, linked: np.ndarray, page: np.ndarray) -> np.ndarray:
    """blocks x FEATURES; a neighbour beyond the page's end has no words and no links."""
    density = np.minimum(1.0, linked / np.maximum(words, 1))
    x = np.zeros((len(words), 6))
    x[:, 2], x[:, 3] = words, density
    same = np.flatnonzero(page[1:] == page[:-1])
    x[same + 1, 0], x[same + 1, 1] = words[same], density[same]
    x[same, 4], x[same, 5] = words[same + 1], density[same + 1]
    return x


def labelled_table(text: str = LABELLED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, labels, page) of the labelled blocks."""
    rows = [(k, *map(int, b.lstrip("+").split("/")), b[0] == "+") for k, line in enumerate(text.strip().splitlines()) for b in line.split()]
    page, words, linked, y = (np.array(c) for c in zip(*rows))
    return features(words, linked, page), y.astype(float), page


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int = DEPTH) -> tuple:
    """A CART: (share of 1,) or (feature, threshold, left, right); left holds values up to the threshold. Splits by least Gini impurity, ties by the first feature and least threshold."""
    share = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * LEAST_LEAF or share in (0.0, 1.0):
        return (share,)
    best = None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, t = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        ok = (v[1:] > v[:-1]) & (n >= LEAST_LEAF) & (len(y) - n >= LEAST_LEAF)
        if not ok.any():
            continue
        p, q = t[:-1] / n, (t[-1] - t[:-1]) / (len(y) - n)
        gini = np.where(ok, n * p * (1 - p) + (len(y) - n) * q * (1 - q), np.inf)
        k = int(gini.argmin())
        if best is None or gini[k] < best[0] - 1e-12:
            best = (gini[k], j, (v[k] + v[k + 1]) / 2)
    if best is None or best[0] >= len(y) * share * (1 - share) - 1e-12:
        return (share,)
    left = x[:, best[1]] <= best[2]
    return (best[1], float(best[2]), fit_tree(x[left], y[left], depth - 1), fit_tree(x[~left], y[~left], depth - 1))


def predict(tree: tuple, x: np.ndarray) -> np.ndarray:
    """The leaf's share for each row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0])
    left = x[:, tree[0]] <= tree[1]
    out = np.empty(len(x))
    out[left], out[~left] = predict(tree[2], x[left]), predict(tree[3], x[~left])
    return out


def _extract(tree: tuple):
    def run(batches):
        for b in batches:
            for part in (b.slice(i, 256) for i in range(0, b.num_rows, 256)):
                pages = [None if h is None else blocks(h) for h in part.column(1).to_pylist()]
                flat = [x for p in pages if p for x in p]
                count = np.array([len(p or ()) for p in pages], dtype=np.int32)
                page = np.repeat(np.arange(len(pages)), count)
                words, linked = (np.array([x[k] for x in flat], dtype=np.int64) for k in (1, 2))
                kept = predict(tree, features(words, linked, page)) >= 0.5
                first = np.concatenate([[0], np.cumsum(count)])
                text = [None if p is None else "\n".join(x[0] for x, k in zip(p, kept[first[i] : first[i + 1]]) if k) for i, p in enumerate(pages)]
                n_kept = np.bincount(page[kept], minlength=len(pages)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(count), pa.array(n_kept)], names=["page_id", "text", "blocks", "kept"])

    return run


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, text, blocks, kept) for every page: its main text, a block a line, and how many blocks it has and keeps."""
    tune(pages.sparkSession)
    x, y, _ = labelled_table()
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_extract(fit_tree(x, y)), "page_id long, text string, blocks int, kept int")


def op1_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
