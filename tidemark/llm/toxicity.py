"""Toxicity by a classifier chain.

Categories are predicted in a fixed order by logistic models. A later model sees the probabilities of the earlier categories; in training those are out-of-fold predictions, of models that chose their signs and weights without the fold, so it learns from probabilities as uncertain as the ones it gets later. Folds keep near copies together and near copies share one vote, so that a passage copied many times isn't learnt as a sign.

The labels table has two outcomes, so the query's chain is low_quality (quality = 0) and then toxic; any number of 0/1 columns may be given. Models are fitted on at most MAX_TRAIN labelled documents (those of least hash of doc_id, a bounded sample); every document is then scored on its whole text, inside the scan, without a shuffle.

Defined cases: a null or empty text gets the probabilities of a text without signs; a label that is null or outside 0/1 leaves its row out of training; of several labels of a doc_id the greatest counts; a category is only learnt if its labels have both classes: else its probability is 0 and rejects nothing (so with an empty labels table every document stays); rows that share a doc_id are scored each by its own text; extra columns stay untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.near_dup import band_keys, signatures
from tidemark.llm.words import U, mix, shingles, words
from tidemark.session import table, tune

BITS, STEM = 20, 6
#: Bound of the labelled sample.
MAX_TRAIN = 12_000
FOLDS, LEAST_Z, LEAST_SUPPORT, PENALTY = 3, 4.0, 4, 1.0
CHAIN = ("low_quality", "toxic")
REJECT_AT = 0.5


def signs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, object]:
    """(row, sign) of every word, of every longer word's first STEM bytes, and of two facts of the form: the text's length and its share of symbols, both in steps. A word's sign is a hash of BITS bits."""
    w = words(texts)
    n = len(texts)
    count = np.diff(w.first)
    used = np.zeros(n, np.int64)
    np.add.at(used, w.row, w.end - w.start)
    size = np.diff(w.offsets)
    length = np.log2(np.maximum(count, 1)).astype(np.int64)
    symbols = (10 * (1 - used / np.maximum(size, 1))).astype(np.int64)
    long = np.flatnonzero(w.end - w.start > STEM)
    stem = np.zeros(len(long), dtype=np.uint64)
    for j in range(STEM):
        stem = stem << U(8) | w.data[w.start[long] + j].astype(np.uint64)
    rows = np.concatenate([w.row, w.row[long], np.arange(n), np.arange(n)])
    return rows, np.concatenate([(h >> U(64 - BITS)).astype(np.int64) for h in (w.hash, mix(stem))] + [(1 << BITS) + length, (1 << BITS) + 64 + symbols]), w


_SPACE = (1 << BITS) + 128


def _features(batches):
    """doc_id, distinct signs (int32), copy keys for each labelled document."""
    for b in batches:
        n = b.num_rows
        rows, s, w = signs(b.column("text"))
        key = np.unique(rows * _SPACE + s)
        r = key // _SPACE
        cut = np.searchsorted(r, np.arange(n + 1)).astype(np.int32)
        sr, sh = shingles(w, 3)
        sig, _ = signatures(sr, sh, n, 15)
        keys = np.ascontiguousarray(band_keys(sig, 5))
        yield pa.RecordBatch.from_arrays(
            [
                b.column("doc_id"),
                b.column("y"),
                pa.ListArray.from_arrays(pa.array(cut), pa.array((key % _SPACE).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array((np.arange(n + 1) * 5).astype(np.int32)), pa.array(keys.ravel())),
            ],
            names=["doc_id", "y", "signs", "copies"],
        )


def _groups(keys: np.ndarray) -> np.ndarray:
    """A group number for each row: rows that share a key are in one group."""
    parent = np.arange(len(keys))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for column in keys.T:
        seen: dict[int, int] = {}
        for i, k in enumerate(column.tolist()):
            j = seen.setdefault(k, i)
            if j != i:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(len(keys))], dtype=np.int64)


#: The constant of a category that wasn't learnt: a probability of 0.
_NEVER = -np.inf


class _Table:
    """A table of 0 and 1 with n rows and m columns as its cells of 1 (row, column), then columns of numbers, then a column of ones."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, m: int, more: np.ndarray):
        self.n, self.m, self.more = n, m, more
        # cells in order of row, and in order of column; where each row's and column's begin
        by_row, by_column = np.lexsort((column, row)), np.lexsort((row, column))
        self.columns, self.rows = column[by_row], row[by_column]
        self.row_cuts, self.column_cuts = (np.searchsorted(k[by], np.arange(size + 1)) for k, by, size in ((row, by_row, n), (column, by_column, m)))

    @staticmethod
    def _sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0.0], np.cumsum(values)])[cuts])

    def times(self, v: np.ndarray) -> np.ndarray:
        return self._sums(v[self.columns], self.row_cuts) + self.more @ v[self.m : -1] + v[-1]

    def transposed_times(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([self._sums(u[self.rows], self.column_cuts), self.more.T @ u, [u.sum()]])

    def squares_times(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([self._sums(u[self.rows], self.column_cuts), (self.more**2).T @ u, [u.sum()]])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _solve(apply, b: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Conjugate gradients with a diagonal preconditioner, to a hundredth of b: Newton's next step mends the rest."""
    x, r = np.zeros_like(b), b.copy()
    z = r / diagonal
    p, rz, enough = z, r @ z, 1e-2 * np.linalg.norm(b)
    for _ in range(500):
        if np.linalg.norm(r) <= enough:
            break
        q = apply(p)
        a = rz / (p @ q)
        x, r = x + a * p, r - a * q
        z = r / diagonal
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x


def _fit(x: _Table, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's method; rows without weight don't count. The last coefficient is the constant."""
    beta, used = np.zeros(x.m + x.more.shape[1] + 1), weight > 0
    if not used.any() or y[used].min() == y[used].max():
        beta[-1] = _NEVER
        return beta
    share = float((weight * y).sum()) / float(weight.sum())
    beta[-1] = np.log(share / (1 - share))
    ridge = np.full(len(beta), PENALTY)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = _sigmoid(x.times(beta))
        d = weight * np.maximum(p * (1 - p), 1e-6)
        g = x.transposed_times(weight * (p - y)) + ridge * beta
        step = _solve(lambda v: x.transposed_times(d * x.times(v)) + ridge * v, g, x.squares_times(d) + ridge)
        beta -= step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return beta


def _predict(x: _Table, beta: np.ndarray) -> np.ndarray:
    return np.zeros(x.n) if beta[-1] == _NEVER else _sigmoid(x.times(beta))


def _choose(rows: np.ndarray, s: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Signs whose share among the category's documents differs by LEAST_Z standard errors."""
    pos, neg = weight * y, weight * (1 - y)
    a, b = np.bincount(s, pos[rows], _SPACE), np.bincount(s, neg[rows], _SPACE)
    np_, nn = pos.sum(), neg.sum()
    if min(np_, nn) < 1:
        return np.zeros(0, np.int64)
    share = (a + b) / (np_ + nn)
    z = (a / np_ - b / nn) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / np_ + 1 / nn))
    ok = np.flatnonzero((a + b >= LEAST_SUPPORT) & (np.abs(z) >= LEAST_Z))
    return ok


def _cells(rows: np.ndarray, s: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cells (row, number of the chosen sign), each once."""
    at = np.full(_SPACE, -1, dtype=np.int32)
    at[chosen] = np.arange(len(chosen))
    f = at[s]
    hit = f >= 0
    cell = np.unique(rows[hit] * max(1, len(chosen)) + f[hit])
    return cell // max(1, len(chosen)), cell % max(1, len(chosen))


class Chain:
    """names, signs (sorted sign numbers) and a coefficient vector for each category."""

    def __init__(self, names, chosen, betas):
        self.names, self.chosen, self.betas = tuple(names), chosen, betas

    def score(self, rows: np.ndarray, s: np.ndarray, n: int) -> np.ndarray:
        """n x categories probabilities."""
        row, column = _cells(rows, s, self.chosen)
        out = np.zeros((n, len(self.names)))
        for j, beta in enumerate(self.betas):
            out[:, j] = _predict(_Table(row, column, n, len(self.chosen), out[:, :j]), beta)
        return out


def fit_chain(names, sign_lists: list[np.ndarray], y: np.ndarray, copies: np.ndarray) -> Chain:
    """y: rows x categories of 0/1; copies: rows x keys that near copies share."""
    n = len(sign_lists)
    if not n:
        return Chain(names, np.zeros(0, np.int64), [np.append(np.zeros(j), _NEVER) for j in range(len(names))])
    rows = np.repeat(np.arange(n), [len(s) for s in sign_lists])
    s = np.concatenate(sign_lists).astype(np.int64)
    group = _groups(copies)
    weight = 1 / np.bincount(group, minlength=n)[group]
    fold = np.unique(group, return_inverse=True)[1] * 2654435761 % 1_000_003 % FOLDS

    def signs_of(own: np.ndarray) -> np.ndarray:
        """The signs chosen on own rows."""
        part = own[rows]
        return np.unique(np.concatenate([_choose(rows[part], s[part], y[:, j], weight * own) for j in range(len(names))]))

    def table_of(chosen: np.ndarray, earlier: np.ndarray) -> _Table:
        return _Table(*_cells(rows, s, chosen), n, len(chosen), earlier)

    chosen = signs_of(np.ones(n, dtype=bool))
    betas, earlier = [], np.zeros((n, 0))
    for j in range(len(names)):
        held = np.zeros(n)
        for k in range(FOLDS) if j + 1 < len(names) else []:
            own = fold == k
            x = table_of(signs_of(~own), earlier)
            held[own] = _predict(x, _fit(x, y[:, j], weight * ~own))[own]
        betas.append(_fit(table_of(chosen, earlier), y[:, j], weight))
        earlier = np.hstack([earlier, held[:, None]])
    return Chain(names, chosen, betas)


def train(docs: DataFrame, labels: DataFrame, names=CHAIN, max_train: int = MAX_TRAIN) -> Chain:
    """The chain, from documents joined with 0/1 label columns named as the categories."""
    tune(docs.sparkSession)
    known = labels.where(" AND ".join(f"{c} IN (0, 1)" for c in names)).where("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.max(c).cast("int").alias(c) for c in names])
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most MAX_TRAIN rows of numbers
    rows = sample.select("doc_id", F.array(*names).alias("y"), "text").mapInArrow(_features, "doc_id long, y array<int>, signs array<int>, copies array<long>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    take = lambda c: [x.values.to_numpy() for x in rows[c]]
    if not len(order):
        return fit_chain(names, [], np.zeros((0, len(names))), np.zeros((0, 5)))
    s, y, k = take("signs"), np.stack(take("y")).astype(float), np.stack(take("copies"))
    return fit_chain(names, [s[i] for i in order], y[order], k[order])


def scorer(chain: Chain):
    """A column function: text to an array of the categories' probabilities."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def score(texts: pa.Array) -> pa.Array:
        rows, s, _ = signs(texts)
        p = chain.score(rows, s, len(texts))
        return pa.ListArray.from_arrays(pa.array((np.arange(len(texts) + 1) * len(chain.names)).astype(np.int32)), pa.array(p.ravel()))

    return score


def labelled(spark, sf_dir: str) -> DataFrame:
    """The labels table as 0/1 columns of the chain's categories."""
    return table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")


def toxic_documents(docs: DataFrame, labels: DataFrame, names=CHAIN, at: float = REJECT_AT) -> DataFrame:
    """doc_id and the chain's probabilities of each document whose last category reaches the bound."""
    score = scorer(train(docs, labels, names))
    scored = docs.select("doc_id", score("text").alias("__p"))
    return scored.where(F.col("__p")[len(names) - 1] >= at).select("doc_id", *[F.round(F.col("__p")[j], 6).alias(f"p_{c}") for j, c in enumerate(names)])


def drop_toxic(docs: DataFrame, train_on: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the chain doesn't reject, with all their columns."""
    score = scorer(train(train_on, labels))
    return docs.where(score("text")[len(CHAIN) - 1] < REJECT_AT)


def op4_toxicity_chain(spark, sf_dir):
    return toxic_documents(table(spark, sf_dir, "documents"), labelled(spark, sf_dir))
