"""Secret scan: fixed patterns, and a linear-chain conditional random field that tags tokens as begin, inside or outside.

Tokens are runs of word characters or of punctuation. Their scores come from their shape, hashed spelling, the shape and spelling of
their neighbours, and features of the whole text; Viterbi decodes all texts of a batch at once, in blocks of tokens.
The patterns' own matches in a bounded sample of documents are the examples that the field learns from.
"""

from __future__ import annotations

import hashlib
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, labelled_sample, mix, table

# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "field")

Span = tuple[int, int, int]  # start, kind, end: their order is that of the lists


def base_spans(text: str) -> list[tuple[Span, int]]:
    """Base spans with the place where the secret itself starts. Null is not allowed here."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYS):
        found += [((m.start(), 0, m.end()), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= 12]
    if "AKIA" in text:
        found += [((m.start(), 1, m.end()), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [((m.start(), 2, m.end()), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


BLANK, WORD, SIGN, BREAK = 0, 1, 2, 3
SHAPES, SPELLINGS, FILES = 770, 4096, 16
COLUMNS = (SHAPES, SPELLINGS, SHAPES, SHAPES, SPELLINGS, SPELLINGS, FILES)  # own shape and spelling, shape before and after, spelling before and two before, file
OFFSETS = np.cumsum((0, *COLUMNS))


def tables() -> dict[str, np.ndarray]:
    c = np.arange(256)
    kind = np.full(256, SIGN, np.uint8)
    digit, upper, lower = (c >= 48) & (c <= 57), (c >= 65) & (c <= 90), (c >= 97) & (c <= 122)
    kind[digit | upper | lower | (c >= 128) | np.isin(c, [43, 45, 47, 95])] = WORD
    kind[[32, *range(9, 14)]] = BLANK
    kind[0] = BREAK
    fold = np.where(upper, c + 32, c).astype(np.uint64)
    return {"kind": kind, "digit": digit, "upper": upper, "lower": lower, "far": (lower & (c > 102)) | (upper & (c > 70)), "fold": mix(fold + np.uint64(17))}


TABLES = tables()


def tokens(texts: list[str]) -> dict[str, np.ndarray]:
    """Tokens of all texts, a break after each: doc, start and end within the text, and a row of feature numbers for each column."""
    joined = "\n\0\n".join(t.replace("\0", " ") for t in texts) + "\n\0\n"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.minimum(cp, 255)
    t = TABLES
    kind = t["kind"][c]
    edge = np.flatnonzero(np.append(True, kind[1:] != kind[:-1]))
    end = np.append(edge[1:], len(c))
    keep = kind[edge] != BLANK
    start, end = edge[keep], end[keep]
    k = kind[start]
    size = end - start

    def count(x: np.ndarray) -> np.ndarray:
        upto = np.append(0, np.cumsum(x, dtype=np.int32))
        return upto[end] - upto[start]

    digits = count(t["digit"][c])
    share = np.select([digits == 0, 4 * digits < size, 10 * digits < 6 * size, digits < size], [0, 1, 2, 3], 4)
    shape = np.searchsorted([2, 4, 7, 12, 16, 20, 32], size, side="right") * 5 + share
    for x in (t["upper"][c], t["lower"][c], t["far"][c], c >= 128):
        shape = shape * 2 + (count(x) > 0)
    shape = np.where(k == WORD, shape, np.where(k == SIGN, 640 + np.minimum(c[start], 127), 768))
    rolled = np.append(np.uint64(0), np.cumsum(t["fold"][c] * POWERS(len(c)), dtype=np.uint64))
    spelled = mix((rolled[end] - rolled[start]) * UNPOWERS(len(c))[start])
    spelled = (spelled >> np.uint64(52)).astype(np.int64)
    stop = k == BREAK
    doc = np.cumsum(stop) - stop
    total = np.bincount(doc, minlength=len(texts)).astype(float)
    marks = np.bincount(doc, np.isin(c[start], [58, 61, 34, 123]), len(texts)) / total
    file = np.searchsorted([0.001, 0.01, 0.05], marks) * 4 + np.searchsorted([50, 300, 2000], total)
    blank = lambda x, by, none: np.concatenate([np.full(by, none, x.dtype), x])[: len(x)]
    cols = [shape, spelled, blank(shape, 1, 769), np.append(shape[1:], 769), blank(spelled, 1, 0), blank(spelled, 2, 0), file[doc]]
    bounds = np.cumsum([0, *(len(x) + 3 for x in texts)])
    return {"doc": doc, "start": start - bounds[doc], "end": end - bounds[doc], "stop": stop, "features": np.stack([x.astype(np.int32) + o for x, o in zip(cols, OFFSETS, strict=False)])}


BASE = 0x9E3779B97F4A7C15


def POWERS(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, np.uint64(BASE)))


def UNPOWERS(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, np.uint64(pow(BASE, -1, 2**64))))


NEVER = np.float32(-1e6)


@dataclass
class TagField:
    """Scores of each feature for outside, begin, inside; transitions [from, to]."""

    weights: np.ndarray
    step: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[0]]
        for row in features[1:]:
            out += self.weights[row]
        return out


def viterbi(score: np.ndarray, step: np.ndarray, block: int = 64) -> np.ndarray:
    """The best tags of one chain that starts and ends outside: each block is solved for every tag before it, then the blocks are joined."""
    n = len(score)
    blocks = -(-n // block)
    padded = np.zeros((blocks * block, 3), np.float32)
    padded[n:, 1:] = NEVER
    padded[:n] = score
    e = padded.reshape(blocks, block, 3)
    best = np.where(np.eye(3, dtype=bool), np.float32(0), NEVER)[None].repeat(blocks, 0)  # [block, tag before, tag now]
    back = np.empty((block, blocks, 3, 3), np.int8)
    for t in range(block):
        moves = best[:, :, :, None] + step[None, None]
        back[t] = moves.argmax(2)
        best = np.take_along_axis(moves, back[t][:, :, None, :].astype(np.intp), 2)[:, :, 0] + e[:, t, None, :]
    now, came = np.array([0, NEVER, NEVER], np.float32), np.empty((blocks, 3), np.int8)
    for i in range(blocks):
        total = now[:, None] + best[i]
        came[i] = total.argmax(0)
        now = total.max(0)
        now -= now.max()
    first, last = np.empty(blocks, np.intp), np.empty(blocks, np.intp)
    tag = int(now.argmax())
    for i in range(blocks - 1, -1, -1):
        last[i] = tag
        tag = first[i] = came[i, tag]
    tags = np.empty((block, blocks), np.int8)
    at, now_tag = np.arange(blocks), last
    for t in range(block - 1, -1, -1):
        tags[t] = now_tag
        now_tag = back[t][at, first, now_tag].astype(np.intp)
    return tags.T.ravel()[:n]


def field_spans(model: TagField, texts: list[str]) -> list[list[tuple[int, int]]]:
    """(start, end) of what the field tags as secret in each text."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not texts or not model.weights.any():
        return out
    t = tokens(texts)
    score = model.scores(t["features"])
    score[t["stop"], 1:] = NEVER
    tag = viterbi(score, model.step)
    for i in np.flatnonzero(tag == 1).tolist():
        j = i
        while tag[j + 1] == 2:
            j += 1
        out[t["doc"][i]].append((int(t["start"][i]), int(t["end"][j])))
    return out


def scan(model: TagField, texts: list[str | None]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text; what the field finds beside or around base spans is a span of its own kind.

    Spans of the field that lie within a base span are that span found again. Null is an empty text and has no span.
    """
    out = []
    texts = [t or "" for t in texts]
    for a, b in batches_of(texts, 2_000_000):
        part = texts[a:b]
        for text, more in zip(part, field_spans(model, part), strict=True):
            base = [s for s, _ in base_spans(text)]
            own = [(s, 3, e) for s, e in more if not any(x[0] <= s and e <= x[2] for x in base)]
            out.append((base, sorted(base + own)))
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


WINDOW = 25


def windows(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature numbers and tags of windows of tokens: around each base span, and one in each text without. Short texts are filled up with their break."""
    texts = [t or "" for t in texts]
    if not texts:
        return
    t = tokens(texts)
    bounds = np.searchsorted(t["doc"], np.arange(len(texts) + 1))
    for d, text in enumerate(texts):
        lo, hi = int(bounds[d]), int(bounds[d + 1]) - 1
        tag = np.zeros(hi - lo, np.int8)
        starts, ends = t["start"][lo:hi], t["end"][lo:hi]
        centres = []
        for (_, _, end), secret in base_spans(text):
            i, j = np.searchsorted(ends, secret, side="right"), np.searchsorted(starts, end)
            if i < j and tag[i] == 0:
                tag[i : max(j, i + 1)] = 2
                tag[i] = 1
                centres.append(i)
        rows = t["features"][:, lo:hi]
        if (less := WINDOW - (hi - lo)) > 0:
            rows, tag = np.hstack([rows, np.repeat(t["features"][:, hi : hi + 1], less, 1)]), np.append(tag, np.zeros(less, np.int8))
        for i in centres or [(hi - lo) * 7 // 13]:
            a = min(max(i - WINDOW // 2, 0), len(tag) - WINDOW)
            yield rows[:, a : a + WINDOW], tag[a : a + WINDOW]


def fit(features: np.ndarray, tags: np.ndarray, rounds: int = 60, rate: float = 0.2, l2: float = 1e-4) -> TagField:
    """Maximum conditional likelihood by Adam. features: [window, column, token]; tags: [window, token]. Without a secret the field tags nothing.

    In a half of the windows each, spellings are hidden, so that shapes and places must tell a secret whose key was never met.
    """
    width = int(OFFSETS[-1])
    step0 = np.array([[0, 0, NEVER], [0, 0, 0], [0, 0, 0]], np.float32)
    model = TagField(np.zeros((width, 3), np.float32), step0.copy())
    if not len(tags) or not tags.any():
        return model
    n, m = tags.shape
    rng = np.random.default_rng(17)
    features = features.copy()
    for k in np.flatnonzero(np.array(COLUMNS) == SPELLINGS):
        features[rng.random(n) < 0.5, k] = OFFSETS[k]
    gold = np.eye(3)[tags]
    flat = features.transpose(1, 0, 2).reshape(len(COLUMNS), -1)
    w, step = np.zeros((width, 3)), step0.astype(float)
    seen = np.zeros((3, 3))
    np.add.at(seen, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros((3, 3)), np.zeros((3, 3))]

    def total(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis, keepdims=True)
        return (np.log(np.exp(x - top).sum(axis, keepdims=True)) + top).squeeze(axis)

    for r in range(1, rounds + 1):
        e = sum(w[row] for row in flat).reshape(n, m, 3)
        a, b = np.empty((n, m, 3)), np.zeros((n, m, 3))
        a[:, 0] = e[:, 0]
        for t in range(1, m):
            a[:, t] = e[:, t] + total(a[:, t - 1, :, None] + step, 1)
        for t in range(m - 2, -1, -1):
            b[:, t] = total(step + (e[:, t + 1] + b[:, t + 1])[:, None], 2)
        z = total(a[:, -1], 1)
        p = np.exp(a + b - z[:, None, None])
        moves = np.exp(np.clip(a[:, :-1, :, None] + step + (e[:, 1:] + b[:, 1:])[:, :, None] - z[:, None, None, None], -700, 0)).sum((0, 1))
        err = (gold - p).reshape(-1, 3)
        g = np.stack([sum(np.bincount(row, err[:, k], width) for row in flat) for k in range(3)], 1) / n - l2 * w
        gs = (seen - moves) / n
        for x, grad, i in ((w, g, 0), (step, gs, 2)):
            state[i][:], state[i + 1][:] = 0.9 * state[i] + 0.1 * grad, 0.99 * state[i + 1] + 0.01 * grad**2
            x += rate * (state[i] / (1 - 0.9**r)) / (np.sqrt(state[i + 1] / (1 - 0.99**r)) + 1e-6)
        step[0, 2] = NEVER
    return TagField(w.astype(np.float32), step.astype(np.float32))


def examples(text: Column) -> Column:
    """Whether a text has a match of a base kind, by built-in functions."""
    long = "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]{12,}"
    low = F.lower(text)
    keyed = reduce(Column.__or__, (low.contains(k) for k in KEYS))  # far cheaper, and false for most texts
    return F.coalesce(keyed & text.rlike(long) | text.contains("AKIA") & text.rlike("AKIA[A-Z0-9]{14,}") | text.rlike("[0-9a-f]{16}"), F.lit(False))


def train_secrets(docs: DataFrame, most_docs: int = 8000, most_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> TagField:
    """Fits the field on the windows of at most most_docs documents and most_bytes of text, half of them from those with base spans, half from those without.

    All documents are looked through for base spans first, so that the examples don't get fewer as other documents get more; within each half
    the first by a hash of the id are taken (see labelled_sample), of any length. Executors make the features. Rows without an id are never in
    the sample. Without an example the field tags nothing, and a warning says so.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            texts = [t or "" for t in pdf.text]
            for a, b in batches_of(texts, 2_000_000):
                found = list(windows(texts[a:b]))
                yield pd.DataFrame({"x": [np.ascontiguousarray(x, np.int32).tobytes() for x, _ in found], "y": [y.tobytes() for _, y in found]})

    held = docs.select(F.col(id_col).alias(id_col), examples(F.col(text_col)).cast("int").alias("y"))
    chosen = labelled_sample(docs, held, "y", F.lit(True), most_docs // 2, most_bytes // 2, F.octet_length(F.col(text_col)), id_col, text_col)
    got = sorted((bytes(r.x), bytes(r.y)) for r in chosen.select("text").mapInPandas(run, "x binary, y binary").collect())
    x = np.frombuffer(b"".join(a for a, _ in got), np.int32).reshape(-1, len(COLUMNS), WINDOW)
    y = np.frombuffer(b"".join(b for _, b in got), np.int8).reshape(-1, WINDOW)
    if not y.any():
        warnings.warn("no document has a secret to learn from: the field tags nothing", stacklevel=2)
    return fit(x, y)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def find_secrets(docs: DataFrame, model: TagField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their places, all spans as kind:start:end. Null and empty texts have none."""
    held = [model]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            got = scan(held[0], pdf.t.tolist())
            counts = [[sum(s[1] == k for s in base) for base, _ in got] for k in range(3)]
            yield pd.DataFrame({"doc_id": pdf.d, "n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2], "base_sha256": [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got], "spans": [joined(every) for _, every in got]})

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInPandas(run, FOUND)


def redacted(model: TagField, text: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced by the mark; a text without spans, null included, as it is."""
    held = [model]

    def clean(text: str | None, spans: list[Span]) -> str | None:
        if not spans:
            return text
        out, at = [], 0
        for s, _, e in spans:
            if e > at:
                if s >= at:
                    out += [text[at:s], mark]
                at = e
        return "".join([*out, text[at:]])

    @F.pandas_udf("string")
    def redact(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = s.tolist()
            yield pd.Series([clean(t, every) for t, (_, every) in zip(texts, scan(held[0], texts), strict=True)], dtype=object)

    return redact(text)


def op4_tag_field(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_secrets(docs, train_secrets(docs))
