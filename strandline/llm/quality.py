"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is tagged good or bad from features of itself and its neighbours; the forward-backward marginals, weighted by line
length, are the quality of the document. Only documents have labels; those of lines are hidden. Training starts from lines that all bear
their document's label and goes on by expectation and maximization: lines are tagged by the field so far, held to a share of good lines that
fits the label, and the field, transitions between good and bad included, is fitted to those tags.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, fold, labelled_sample, table

COUNTS = [re.compile(p) for p in (r"[A-ZÀ-ÖØ-Þ]", r"[a-zß-öø-ÿ]", r"\d", r"[!?]", r"[#$%&*@^~]", r"[|<>{}\[\]=_/\\]", r"[.,;:]", r"[^\x00-\xff]")]
OWN = 2 * len(COUNTS) + 7
WIDTH = 3 * OWN + 3
CHAIN = 256  # lines; longer documents are several chains in training, and one in scoring
GOOD_SHARE, BAD_SHARE = 0.8, 0.5  # of a good document's text that is good at least, of a bad one's at most


def own_features(lines: list[str]) -> np.ndarray:
    """Features of each line of one document, between 0 and about 1."""
    out = np.zeros((len(lines), OWN), np.float32)
    seen: set[str] = set()
    for i, line in enumerate(lines):
        n = max(len(line), 1)
        parts = line.split()
        k = max(len(parts), 1)
        c = [len(p.findall(line)) for p in COUNTS]
        out[i, : len(COUNTS)] = [x / n for x in c]
        out[i, len(COUNTS) : 2 * len(COUNTS)] = [min(x / k, 2) / 2 for x in c]
        same = sum(a == b for a, b in zip(parts, parts[1:], strict=False))
        out[i, 2 * len(COUNTS) :] = (
            min(len(line) / k, 20) / 20,
            min(np.log1p(k), 8) / 8,
            len(set(parts)) / k,
            same / k,
            line in seen,
            sum(len(p) <= 3 for p in parts) / k,
            sum(p[-1] in "!#$%&*@|" for p in parts) / k,
        )
        if parts:
            seen.add(line)
    return out


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, and line lengths. Null and empty texts have one empty line."""
    lines = (text or "").split("\n")
    own = own_features(lines)
    edge = np.zeros((1, OWN), np.float32)
    ends = np.zeros((len(lines), 3), np.float32)
    ends[0, 0] = ends[-1, 1] = ends[:, 2] = 1
    return np.hstack([own, np.vstack([edge, own[:-1]]), np.vstack([own[1:], edge]), ends]), np.array([len(x) + 1 for x in lines], np.float64)


@dataclass
class LineField:
    """Weights of good against bad, mean and spread of the features, transition scores [from, to], and the slope and offset that turn a share of good text into a score."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    step: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.spread) @ self.weights


def marginals(unary: np.ndarray, sizes: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) of each line, expected transitions [from, to], log partition of each chain. Chains advance side by side.

    unary: score of good against bad, chain after chain; sizes: lines of each chain.
    """
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    left = sizes[order]
    n = len(unary)
    u = np.stack([np.zeros(n), unary], 1)
    a, b = np.empty((n, 2)), np.empty((n, 2))
    alive = [int(k) for k in np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")] if len(left) else []
    for t, k in enumerate(alive):
        at = start[:k] + t
        a[at] = u[at] if t == 0 else u[at] + np.logaddexp(a[at - 1, 0, None] + step[0], a[at - 1, 1, None] + step[1])
    last = start + left - 1
    b[last] = 0
    for t in range(len(alive) - 2, -1, -1):
        at = start[: alive[t + 1]] + t
        nxt = u[at + 1] + b[at + 1]
        b[at] = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
    z = np.logaddexp(a[last, 0], a[last, 1])
    z_line = np.empty(n)
    back = np.empty(len(sizes))
    back[order] = z
    z_line[:] = np.repeat(back, sizes)
    inner = np.ones(n, bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    moves = np.array([[np.exp(a[at, i] + step[i, j] + u[at + 1, j] + b[at + 1, j] - z_line[at]).sum() for j in (0, 1)] for i in (0, 1)])
    return 1 / (1 + np.exp(np.clip(a[:, 0] + b[:, 0] - a[:, 1] - b[:, 1], -60, 60))), moves, back


def good_share(p: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Share of good text in each chain, from the lines' marginals weighted by length."""
    at = np.cumsum(sizes) - sizes
    return np.add.reduceat(p * length, at) / np.add.reduceat(length, at)


def hidden_tags(unary: np.ndarray, step: np.ndarray, y: np.ndarray, length: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals and expected transitions of the field, each chain shifted as far as its label's bound of good text asks for. y: labels of chains."""
    least, most = np.where(y == 1, GOOD_SHARE, 0.0), np.where(y == 1, 1.0, BAD_SHARE)
    share = good_share(marginals(unary, sizes, step)[0], length, sizes)
    low = np.where(share > most, -30.0, 0.0)
    high = np.where(share < least, 30.0, 0.0)
    aim = np.where(share > most, most, least)
    for _ in range(12):
        middle = (low + high) / 2
        over = good_share(marginals(unary + np.repeat(middle, sizes), sizes, step)[0], length, sizes) > aim
        low, high = np.where(over, low, middle), np.where(over, middle, high)
    shift = np.where((share > most) | (share < least), (low + high) / 2, 0.0)
    p, moves, _ = marginals(unary + np.repeat(shift, sizes), sizes, step)
    return p, moves


def climb(model: LineField, z: np.ndarray, tags: np.ndarray, moves: np.ndarray | None, sizes: np.ndarray, rounds: int, rate: float = 0.1, l2: float = 1e-3) -> None:
    """Raises the expected log likelihood of tags and transitions (null: transitions stay at zero) by Adam."""
    theta = np.append(model.weights, model.step.ravel())
    m, v = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for t in range(1, rounds + 1):
        p, now, _ = marginals(z @ theta[:WIDTH], sizes, theta[WIDTH:].reshape(2, 2))
        g = np.append(z.T @ (tags - p), (moves - now).ravel() if moves is not None else np.zeros(4)) / len(sizes) - l2 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    model.weights, model.step = theta[:WIDTH].copy(), theta[WIDTH:].reshape(2, 2).copy()


def log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-4, 1 - 1e-4)
    return np.log(share / (1 - share))


def calibrated(share: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope, never negative, and offset of the logistic of a share's log odds that fits the labels best."""
    x, w = np.stack([log_odds(share), np.ones(len(y))], 1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag([0.05, 0.05]), x.T @ (y - p) - 0.05 * (w - [1.0, 0.0]))
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def fit(x: np.ndarray, y: np.ndarray, length: np.ndarray, sizes: np.ndarray, turns: int = 5, rounds: int = 25) -> LineField:
    """Fits the field. x: line features and length: line lengths, chain after chain; y: labels of chains. Without both labels the field says 0.5."""
    model = LineField(np.zeros(WIDTH), np.zeros(WIDTH), np.ones(WIDTH), np.zeros((2, 2)))
    if not len(y) or len(set(y.tolist())) < 2:
        return model
    model.mean, model.spread = x.mean(0, dtype=np.float64), x.std(0, dtype=np.float64) + 0.05
    model.mean[-1], model.spread[-1] = 0, 1
    z = (x - model.mean) / model.spread
    # what tells a line from its neighbours must come from its own features first
    own = np.where(np.arange(WIDTH) < OWN, z, 0)
    own[:, -1] = z[:, -1]
    climb(model, own, np.repeat(y, sizes), None, sizes, 2 * rounds)
    for _ in range(turns):
        tags, moves = hidden_tags(z @ model.weights, model.step, y, length, sizes)
        climb(model, z, tags, moves, sizes, rounds)
    model.slope, model.offset = calibrated(good_share(marginals(z @ model.weights, sizes, model.step)[0], length, sizes), y)
    return model


def line_tags(model: LineField, text: str | None) -> np.ndarray:
    """Probability of each line to be good, by the forward-backward pass over the whole text."""
    f, length = line_features(text)
    return marginals(model.unary(f), np.array([len(length)]), model.step)[0]


def score_texts(model: LineField, texts: list[str | None]) -> np.ndarray:
    out = []
    for i, j in batches_of([t or "" for t in texts], 8_000_000):
        parts = [line_features(t) for t in texts[i:j]]
        sizes = np.array([len(w) for _, w in parts])
        p, _, _ = marginals(model.unary(np.vstack([f for f, _ in parts])), sizes, model.step)
        share = good_share(p, np.concatenate([w for _, w in parts]), sizes)
        out.append(1 / (1 + np.exp(-np.clip(model.slope * log_odds(share) + model.offset, -40, 40))))
    return np.concatenate(out) if out else np.empty(0)


FEATURES = "y int, lines int, x binary, length binary"


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, per_class: int = 1500, most_lines: int = 100_000, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> LineField:
    """Fits the field on a bounded sample: at most per_class documents and most_lines lines of each label (see labelled_sample).

    Executors make the features; the driver gets 300 bytes for each line of the sample. Labels must be 0 or 1; without both, the field says 0.5.
    Null and empty texts are one empty line; rows without an id are never in the sample.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for y, t in zip(pdf.y, pdf.text, strict=True):
                f, length = line_features(t)
                for i in range(0, len(length), CHAIN):
                    part = length[i : i + CHAIN]
                    out.append((y, len(part), f[i : i + CHAIN].astype(np.float32).tobytes(), part.astype(np.float32).tobytes()))
            yield pd.DataFrame(out, columns=["y", "lines", "x", "length"])

    lines = F.length(F.col(text_col)) - F.length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1
    rows = labelled_sample(docs, labels, label, usable, per_class, most_lines, lines, id_col, text_col).mapInPandas(run, FEATURES).collect()
    rows.sort(key=lambda r: (r.y, r.lines, bytes(r.x)))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(-1, WIDTH)
    length = np.frombuffer(b"".join(bytes(r.length) for r in rows), np.float32).astype(float)
    return fit(x, np.array([r.y for r in rows], float), length, np.array([r.lines for r in rows], np.int64))


def quality_score(model: LineField, text: Column) -> Column:
    """Score of a text, 0 to 1. Null and empty texts count as one empty line."""
    held = [model]

    @F.pandas_udf("double")
    def score(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(score_texts(held[0], s.tolist()))

    return score(text)


def op6_line_field(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the fold crc32 mod 4 = 2 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    scored = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))
