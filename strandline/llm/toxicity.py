"""Toxicity: a factorization machine over hashed terms.

The score of a document is the logistic of w0 + sum(w_i) + sum over pairs of <v_i, v_j>, over the distinct terms it has: its words,
stripped of punctuation, and their first five bytes. Pairs let an insult weigh otherwise beside a mention of a group than alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, fold, labelled_sample, table

BITS = 22
CLEAR = bytes.maketrans(b".,;:!?\"'()[]{}<>*_-|", b" " * 20)


def hashed_terms(text: str | None) -> np.ndarray:
    """Buckets of the terms of a text, with repeats. Null is empty."""
    parts = (text or "").encode("utf-8", "replace").lower().translate(CLEAR).split()
    n = len(parts)
    whole = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, n)
    heads = np.fromiter((xxhash.xxh64_intdigest(p[:5], 1) for p in parts), np.uint64, n)
    return (np.concatenate([whole, heads]) >> np.uint64(64 - BITS)).astype(np.int32)


@dataclass
class Machine:
    """buckets: the hashed terms that have weights; w0, w and v: bias, weights and factors."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margin(self, term: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """term: positions in buckets, distinct within a document; bounds: where documents start, and the end."""

        def by_doc(x: np.ndarray) -> np.ndarray:
            upto = np.concatenate([np.zeros((1, *x.shape[1:])), np.cumsum(x, 0, dtype=np.float64)])
            return upto[bounds[1:]] - upto[bounds[:-1]]

        v = self.v[term]
        return self.w0 + by_doc(self.w[term]) + 0.5 * (by_doc(v) ** 2 - by_doc(v * v)).sum(1)


def fit(docs: list[np.ndarray], y: np.ndarray, rank: int = 8, least_docs: int = 5, epochs: int = 15, batch: int = 400, rate: float = 0.03, z_weight: float = 3.0, z_factor: float = 4.0, rounds: int = 200, l2: float = 3e-5, bands: tuple[int, ...] = (256, 512, 1024), seed: int = 11) -> Machine:
    """Fits by Adam on the logistic loss, in batches of documents. docs: distinct buckets of each document.

    Every term of least_docs documents or more starts with factors, whether its share differs between the labels or not: pairs may tell
    what single terms don't. Each pair of synonyms is rare, so the factors start from what many pairs say together (see paired). A weight, or
    the factors of a term as a group, shrink by so many standard errors of their gradient, so that terms which tell nothing, alone and in
    pairs, end at zero and leave the machine. The others are then fitted without shrinking, in
    rounds over all documents. Without both labels the machine says 0.5.
    """
    y = np.asarray(y, float)
    none = Machine(np.empty(0, np.int32), 0.0, np.empty(0), np.empty((0, rank)))
    if not len(y) or y.min() == y.max():
        return none
    sizes = np.array([len(d) for d in docs])
    every = np.concatenate(docs)
    held = np.bincount(every, minlength=1 << BITS)
    buckets = np.flatnonzero(held >= least_docs)
    spread = np.sqrt(held[buckets]) / len(docs)  # of a term's gradient, for an error of 1
    term, bounds = placed(every, np.append(0, np.cumsum(sizes)), buckets, 1 << BITS)
    m = len(buckets)
    rng = np.random.default_rng(seed)
    theta = np.hstack([np.zeros((m, 1)), rng.normal(0, 0.01, (m, rank))])  # a weight and the factors of each term
    width = rank // len(bands)
    for k, most in enumerate(bands):
        own, factors = paired(term, bounds, y, m, most, width)
        theta[own, 1 + k * width : 1 + k * width + factors.shape[1]] += factors
    w0 = float(np.log(y.sum() / (1 - y).sum()))
    first, second, turn = np.zeros_like(theta), np.zeros_like(theta), 0
    for epoch in range(epochs):
        order = rng.permutation(len(docs))
        for part in np.array_split(order, max(1, len(docs) // batch)):
            turn += 1
            err, grad, total = slope(theta, w0, y, term, bounds, part)
            first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
            scale = second / (1 - 0.99**turn)
            scale[:, 1:] = scale[:, 1:].mean(1, keepdims=True)  # the factors of a term move as one
            step = np.where(scale > 0, rate / (np.sqrt(scale) + 1e-6), 0)  # a term that no batch had yet stays as it is
            theta = theta + step * (first / (1 - 0.9**turn))
            off = spread * np.sqrt((err**2).mean())
            theta[:, 0] = np.sign(theta[:, 0]) * np.maximum(np.abs(theta[:, 0]) - step[:, 0] * z_weight * off, 0)
            length = np.sqrt((theta[:, 1:] ** 2).sum(1))
            less = step[:, 1] * z_factor * off * np.sqrt((total[:, 1:] ** 2).sum(1).mean())
            theta[:, 1:] *= np.maximum(1 - less / np.maximum(length, 1e-12), 0)[:, None]
            w0 += rate * float(err.mean())
        if epoch >= 3 or epoch == epochs - 1:  # what is at zero by then stays there
            live = np.flatnonzero(theta.any(1))
            term, bounds = placed(term, bounds, live, len(theta))
            theta, first, second, spread, buckets = theta[live], first[live], second[live], spread[live], buckets[live]
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    parts = np.array_split(np.arange(len(docs)), max(1, len(docs) // batch))
    for turn in range(1, rounds + 1):
        found = [slope(theta, w0, y, term, bounds, part) for part in parts]
        grad = sum(g * len(part) for (_, g, _), part in zip(found, parts, strict=True)) / len(docs) - l2 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**turn)) / (np.sqrt(second / (1 - 0.99**turn)) + 1e-6)
        w0 += 10 * rate * float(sum(err.sum() for err, _, _ in found)) / len(docs)
    return Machine(buckets, w0, theta[:, 0].copy(), theta[:, 1:].copy())


def paired(term: np.ndarray, bounds: np.ndarray, y: np.ndarray, m: int, most: int, rank: int, scale: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent terms, so many at most, and factors that start them: the leading directions of how far their pairs, beyond the terms
    alone, go with the label.

    Synonyms share a direction though each pair of them is rare, so that what many words say together is found at once.
    """
    docs = len(y)
    held = np.bincount(term, minlength=m)
    own = np.flatnonzero((held > 0) & (held < docs))
    own = np.sort(own[np.lexsort((own, -held[own]))[:most]])
    if len(own) < 2:
        return own, np.zeros((len(own), 0))
    place = np.full(m, -1)
    place[own] = np.arange(len(own))
    doc = np.repeat(np.arange(docs), np.diff(bounds))
    at = place[term]
    x = np.zeros((docs, len(own)), np.float32)
    x[doc[at >= 0], at[at >= 0]] = 1
    p = x.mean(0)
    x = (x - p) / np.sqrt(p * (1 - p))
    rest = (y - y.mean()).astype(np.float32)
    pairs = (x * rest[:, None]).T @ x / np.sqrt(docs)
    np.fill_diagonal(pairs, 0)
    value, vector = np.linalg.eigh(pairs)
    chance = 2 * rest.std() * np.sqrt(len(own)) * (1 + len(own) / (3 * docs))  # the largest that labels dealt at random reach
    lead = np.argsort(-value)[:rank]
    lead = lead[value[lead] > 1.12 * chance]
    v = np.zeros((len(own), len(lead)))
    for k, w in enumerate(vector[:, lead].T):
        # chance leaves a little on every term: those that stand out are taken, and make the direction anew
        clear = np.flatnonzero(np.abs(w) > 4.5 * np.median(np.abs(w)))
        if len(clear) > 1:
            again = np.linalg.eigh(pairs[np.ix_(clear, clear)])[1]
            v[clear, k] = again[:, np.abs(w[clear] @ again).argmax()]
    v /= np.sqrt(p * (1 - p))[:, None]
    size = np.abs(v).max(0)
    return own, scale * v / np.where(size > 0, size, 1)


def placed(term: np.ndarray, bounds: np.ndarray, kept: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Terms of documents, one after the other, as their places in kept, others left out; and where documents start then, and the end."""
    place = np.full(width, -1, np.int32)
    place[kept] = np.arange(len(kept))
    term = place[term]
    return term[term >= 0], np.append(0, np.cumsum(term >= 0))[bounds]


def slope(theta: np.ndarray, w0: float, y: np.ndarray, term: np.ndarray, bounds: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some documents: errors, mean gradient of the log likelihood, and sums of weights and factors."""
    size = bounds[part + 1] - bounds[part]
    own = np.repeat(np.arange(len(part)), size)
    at = term[np.repeat(bounds[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    x = theta[at]
    width = theta.shape[1]
    total = np.stack([np.bincount(own, x[:, k], len(part)) for k in range(width)], 1)
    square = np.bincount(own, (x[:, 1:] ** 2).sum(1), len(part))
    margin = w0 + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(1) - square)
    err = y[part] - 1 / (1 + np.exp(-np.clip(margin, -40, 40)))
    each = err[own] / len(part)
    grad = np.empty_like(theta)
    grad[:, 0] = np.bincount(at, each, len(theta))
    for k in range(1, width):
        grad[:, k] = np.bincount(at, each * (total[own, k] - x[:, k]), len(theta))
    return err, grad, total


def score_texts(model: Machine, texts: list[str | None], place: np.ndarray) -> np.ndarray:
    """place: position of each bucket in the model, -1 if it has none."""
    out = []
    m = max(len(model.buckets), 1)
    for i, j in batches_of([t or "" for t in texts], 4_000_000):
        rows = [hashed_terms(t) for t in texts[i:j]]
        doc = np.repeat(np.arange(j - i), [len(r) for r in rows])
        term = place[np.concatenate(rows)]
        key = np.unique(doc[term >= 0] * m + term[term >= 0])
        out.append(model.margin(key % m, np.searchsorted(key // m, np.arange(j - i + 1))))
    return 1 / (1 + np.exp(-np.clip(np.concatenate(out), -40, 40))) if out else np.empty(0)


def train_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 4000, most_bytes: int = 32 << 20, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """Fits the machine on a bounded sample: at most per_class documents and most_bytes of text of each label (see labelled_sample).

    Executors make the terms. Null and empty texts are documents without terms; rows without an id are never in the sample.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pd.DataFrame({"y": pdf.y.to_numpy(), "terms": [np.unique(hashed_terms(t)).tobytes() for t in pdf.text]})

    rows = labelled_sample(docs, labels, label, usable, per_class, most_bytes, F.octet_length(F.col(text_col)), id_col, text_col).mapInPandas(run, "y int, terms binary").collect()
    rows.sort(key=lambda r: (r.y, bytes(r.terms)))
    return fit([np.frombuffer(r.terms, np.int32) for r in rows], np.array([r.y for r in rows]))


def toxicity_score(model: Machine, text: Column) -> Column:
    """Score of a text, 0 to 1. Null and empty texts have no terms and get the score of the bias."""
    held = [model]

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        place = np.full(1 << BITS, -1, np.int32)
        place[held[0].buckets] = np.arange(len(held[0].buckets))
        for s in it:
            yield pd.Series(score_texts(held[0], s.tolist(), place))

    return score(text)


def op3_factorization(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the fold crc32 mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), toxicity_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
