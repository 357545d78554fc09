"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each logistic model sees the words of the text, a few figures on its
characters and the log-odds that the earlier models gave. For training, the earlier categories' probabilities
are out-of-fold: they come from models that did not see the row, as at prediction time.

Words, and the first 4 and 5 bytes of longer words, enter as present or absent, by 64-bit hash, so long texts
weigh no more than short ones and no two words share a weight. A model keeps the words whose likelihood-ratio statistic with its category is high.

Training takes at most `sample_rows` labelled documents, those with the smallest hashes of their ids: this bound
holds the fitted model's cost; everything else goes over all documents, in one narrow pass.

Null or empty text: no words; it gets the probability of the other figures. A null label: the row does not train
that category. Rows of the same id are scored each for itself; in training they count once for each label row.
With no labels of both kinds, a category's model is its mean. Extra columns stay or are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binaries, document_words, slices, tidy

SAMPLE_ROWS = 3000
#: A word of fewer training rows cannot reach LEAST_G.
LEAST_ROWS = 5
FOLDS = 5
MOST_WORDS, LEAST_G = 400, 40.0
#: Bytes of the word beginnings that are features of their own.
PREFIXES = (4, 5)
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def figures(texts: Sequence[bytes], counts: np.ndarray) -> np.ndarray:
    share = lambda t, drop: (len(t) - len(t.translate(None, drop))) / max(1, len(t))
    return np.array([[np.log1p(n), share(t, _UPPER), share(t, _DIGITS), share(t, _MARKS)] for t, n in zip(texts, counts, strict=True)]).reshape(-1, 4)


def rows_of(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of each text as (text, word) pairs, and the texts' figures."""
    words, bounds, *more = document_words(texts, PREFIXES)
    counts = np.diff(bounds)
    owner = np.repeat(np.arange(len(texts)), counts)
    there = [m != 0 for m in more]
    return np.concatenate([owner, *(owner[t] for t in there)]), np.concatenate([words, *(m[t] for m, t in zip(more, there, strict=True))]), figures(texts, counts)


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


@dataclass
class Linear:
    """Logistic model over chosen words and scaled dense columns."""

    words: np.ndarray
    weights: np.ndarray
    dense: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    bias: float

    def predict(self, owner: np.ndarray, words: np.ndarray, dense: np.ndarray) -> np.ndarray:
        z = self.bias + ((dense - self.mean) / self.scale) @ self.dense
        if len(self.words) and len(words):
            i = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
            there = self.words[i] == words
            pairs = np.unique(owner[there] * len(self.words) + i[there])
            z = z + np.bincount(pairs // len(self.words), self.weights[pairs % len(self.words)], len(dense))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit_linear(owner: np.ndarray, index: np.ndarray, terms: np.ndarray, dense: np.ndarray, y: np.ndarray, l2: float = 0.2, steps: int = 30) -> Linear:
    """Newton's method on the penalised likelihood. owner, index: distinct pairs of row and place in terms."""
    n, positive = len(y), int(y.sum())
    mean, scale = dense.mean(axis=0) if n else np.zeros(dense.shape[1]), np.maximum(dense.std(axis=0) if n else np.ones(dense.shape[1]), 1e-9)
    if not 0 < positive < n:
        return Linear(np.zeros(0, np.uint64), np.zeros(0), np.zeros(dense.shape[1]), mean, scale, float(logit(np.array((positive + 0.5) / (n + 1)))))
    pos = np.bincount(index, y[owner], len(terms))
    df = np.bincount(index, minlength=len(terms)).astype(float)
    cells = [(pos, positive), (df - pos, n - positive), (positive - pos, positive), (n - positive - df + pos, n - positive)]
    rate = [df / n, df / n, 1 - df / n, 1 - df / n]
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(o > 0, o * np.log(o / (r * m)), 0) for (o, m), r in zip(cells, rate, strict=True))
    chosen = np.sort(np.argsort(-g, kind="stable")[:MOST_WORDS])
    chosen = chosen[g[chosen] >= LEAST_G]
    place = np.full(len(terms), -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen) + dense.shape[1] + 1))
    x[owner[place[index] >= 0], place[index][place[index] >= 0]] = 1
    x[:, len(chosen) : -1] = (dense - mean) / scale
    x[:, -1] = 1
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w[-1] = logit(np.array(positive / n))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - y @ (x @ w) + (penalty * w * w).sum() / 2
    now = loss(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        size = 1.0
        while size > 1e-4 and (then := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, gain, now = w - size * step, now - then, then
        if gain < 1e-7 * max(1, now):
            break
    k = len(chosen)
    return Linear(terms[chosen], w[:k], w[k:-1], mean, scale, float(w[-1]))


def common_rows(texts: Sequence[bytes], step: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, word) pairs without words that are too rare to be kept, slice by slice to hold memory down.

    A first pass counts words by 22 bits of their hash; what stays under LEAST_ROWS there is rare for certain.
    """

    def parts() -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for a in range(0, len(texts), step):
            owner, words, dense = rows_of(texts[a : a + step])
            order = np.lexsort((words, owner))
            owner, words = owner[order], words[order]
            new = np.ones(len(owner), bool)
            new[1:] = (owner[1:] != owner[:-1]) | (words[1:] != words[:-1])
            yield a, owner[new], words[new], dense

    bits = np.uint64((1 << 22) - 1)
    seen = np.zeros(1 << 22, np.int32)
    for _, _, words, _ in parts():
        seen += np.bincount((words & bits).astype(np.int64), minlength=1 << 22).astype(np.int32)
    owners, kept, figures_ = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)], [np.zeros((0, 4))]
    for a, owner, words, dense in parts():
        go = seen[(words & bits).astype(np.int64)] >= LEAST_ROWS
        owners.append((owner[go] + a).astype(np.int32))
        kept.append(words[go])
        figures_.append(dense)
    return np.concatenate(owners), np.concatenate(kept), np.concatenate(figures_)


@dataclass
class Chain:
    categories: list[str]
    models: list[Linear] = field(default_factory=list)

    def predict(self, texts: Sequence[bytes]) -> list[np.ndarray]:
        owner, words, dense = rows_of(texts)
        out: list[np.ndarray] = []
        for m in self.models:
            out.append(m.predict(owner, words, np.column_stack([dense, *map(logit, out)])))
        return out


def fit_chain(texts: Sequence[bytes], labels: dict[str, np.ndarray], folds: np.ndarray) -> Chain:
    """labels: by category, 0, 1 or NaN for each text; folds: a fold number for each."""
    owner, words, dense = common_rows(texts)
    terms, index = np.unique(words, return_inverse=True)
    keep = (np.bincount(index, minlength=len(terms)) >= LEAST_ROWS)[index]
    terms, index = np.unique(words[keep], return_inverse=True)
    owner = owner[keep]
    chain, earlier = Chain(list(labels)), []

    def part(rows: np.ndarray, x: np.ndarray, fitting: bool) -> tuple[np.ndarray, ...]:
        place = np.full(len(texts), -1)
        place[rows] = np.arange(len(rows))
        keep = place[owner] >= 0
        own, i = place[owner[keep]], index[keep]
        return (own, i, terms, x[rows]) if fitting else (own, terms[i], x[rows])

    for name in labels:
        y, x = labels[name], np.column_stack([dense, *map(logit, earlier)])
        known = np.isfinite(y)
        out = np.full(len(texts), 0.5)
        for k in np.unique(folds):
            inside, held = np.flatnonzero(known & (folds != k)), np.flatnonzero(folds == k)
            out[held] = fit_linear(*part(inside, x, True), y[inside]).predict(*part(held, x, False))
        rows = np.flatnonzero(known)
        chain.models.append(fit_linear(*part(rows, x, True), y[rows]))
        earlier.append(out)
    return chain


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, object], sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id") -> Chain:
    """categories: name to a column expression over `labels` that is 0, 1 or null, in the order of the chain."""
    names = list(categories)
    marked = labels.select(F.col(id_col).cast("long").alias("__id"), *[F.expr(c).cast("double").alias(f"__y{i}") if isinstance(c, str) else c.cast("double").alias(f"__y{i}") for i, c in enumerate(categories.values())])
    sample = marked.where(F.col("__id").isNotNull()).orderBy(F.xxhash64("__id"), *[f"__y{i}" for i in range(len(names))]).limit(sample_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col("text").alias("__text")).join(F.broadcast(sample), "__id")
    frame = texts.toPandas().sort_values(["__id", "__text"], na_position="first")
    folds = (np.array([hash_id(i) for i in frame["__id"]], np.int64) % FOLDS) if len(frame) else np.zeros(0, np.int64)
    return fit_chain([t.encode() if isinstance(t, str) else b"" for t in frame["__text"]], {n: frame[f"__y{i}"].to_numpy(float) for i, n in enumerate(names)}, folds)


def hash_id(i: int) -> int:
    return int(np.random.default_rng(int(i) & (2**63 - 1)).integers(1 << 30))


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id") -> DataFrame:
    """doc_id and p_<category> of every document."""
    model = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            yield pa.record_batch([b.column(0), *(pa.array(p, pa.float64()) for p in model.value.predict(binaries(b.column(1))))], names=[id_col, *names])

    return docs.select(F.col(id_col).cast("long"), F.col("text").alias("__text")).mapInArrow(tidy(run), ", ".join([f"{id_col} long", *(f"{n} double" for n in names)]))


def drop_toxic(docs: DataFrame, chain: Chain, category: str = "toxic", threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, that the chain does not reject."""
    model, at, which = docs.sparkSession.sparkContext.broadcast(chain), docs.columns.index("text"), chain.categories.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield b.filter(pa.array(model.value.predict(binaries(b.column(at)))[which] < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
