"""Language-model scoring: a hierarchical Pitman-Yor model with Chinese-restaurant seating, sampled by Gibbs.

Restaurants stand in a chain of three levels: those of the whole word before, of its last byte, which they share as parents, and one for
all contexts, whose base is even over the vocabulary and one unknown word. A table of a restaurant is a customer of its parent. At first
each dish has one table everywhere. A sweep takes all customers of every dish out of their restaurant and seats them anew, given all
other dishes: what it costs goes with dishes and tables, not with tokens. Predictive probabilities are averaged over the sweeps after the
first few.

Tokens are gathered in blocks of documents. A block sends each bucket of words its tokens there: their context and document. All
restaurants of a word are in its bucket. What words share, the customers and tables of contexts, lies in parts by context: after a sweep
a bucket tells each part the tables of its contexts, and gets the sums back before the next one; all are of the sweep before. Only the
totals of last bytes and the most frequent words, CONTEXTS at most, go through the driver; those words are sent by rank, others by hash.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import fold, mix, table, word_hashes, words, written, written_by

BLOCK_TOKENS = 1_600_000
BUCKET_DOCS = 4096
BUCKETS_A_PART = 8
COUNTED = 400_000  # distinct words that a task counts together
CONTEXTS = 1 << 19  # words at most that are sent by rank
START = 65535  # the context of a first word; no word ends in byte 255
END = np.uint64(0x2545F4914F6CDD1D)
BYTES = 256
BURN_IN, SAMPLES = 2, 3
FEW = 32  # customers up to which the distribution of tables is tabulated
TRIES = 4
ONE_BY_ONE = 8192  # customers up to which a proposal seats each in turn
DRAWN = 1 << 18  # numbers that a proposal draws at once
FAR = 1e12  # customers of a base that own tables don't change
STRENGTH = 1.0


def squeeze(*arrays: np.ndarray) -> bytes:
    """Arrays behind each other, byte by byte of their numbers, compressed; sizes and types come first."""
    head = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    planes = (np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=1).compress(len(head).to_bytes(4, "little") + head + b"".join(planes))


def expand(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bytes(raw))
    n = int.from_bytes(raw[:4], "little")
    at, out = 4 + n, []
    for part in raw[4:at].decode().split(","):
        kind, size = part.split(":")
        kind, size = np.dtype(kind), int(size)
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += planes.nbytes
    return out


def steps(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Runs of so many ascending numbers as the first and the steps from each to the next."""
    out = np.diff(x, prepend=0)
    at = (np.cumsum(size) - size)[size > 0]
    out[at] = x[at]
    return out.astype(np.uint32)


def unstepped(step: np.ndarray, size: np.ndarray) -> np.ndarray:
    upto, size = np.cumsum(step, dtype=np.int64), size.astype(np.int64)
    at = (np.cumsum(size) - size)[size > 0]
    return upto - np.repeat(upto[at] - step[at], size[size > 0])


def word_keys(parts: list[bytes]) -> np.ndarray:
    """A hash of each word in 56 bits, then its last byte."""
    last = np.fromiter(map(itemgetter(-1), parts), np.uint64, len(parts))
    return word_hashes(parts) >> np.uint64(8) << np.uint64(8) | last


def numbering() -> defaultdict:
    """Gives each new key the next number."""
    number = defaultdict()
    number.default_factory = number.__len__
    return number


def block_tokens(texts: list[np.ndarray], distinct: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each text, keys of the distinct words (the end is the last), and the number of each token's word among them. Texts are numbers of words."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    here = np.ones(int(sizes.sum()), bool)
    here[np.cumsum(sizes) - 1] = False
    token = np.full(len(here), len(distinct), np.int32)
    token[here] = np.concatenate(texts)
    return sizes, np.append(word_keys(distinct), END), token


def packed_order(*keys: np.ndarray) -> np.ndarray:
    """The order by keys, none below 0, the first above all, equal ones as they lie."""
    bits = [int(k.max()).bit_length() if len(k) else 0 for k in keys]
    if sum(bits) > 63:
        return np.lexsort(keys[::-1])
    code = np.zeros(len(keys[0]), np.int64)
    for k, b in zip(keys, bits, strict=True):
        code = code << b | k
    return np.argsort(code, kind="stable")


@dataclass
class Frequent:
    """The most frequent words of the training texts: keys in ascending order and counts; tokens and words of all these texts."""

    keys: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int

    def base(self, counts: np.ndarray) -> np.ndarray:
        """Base log10 probability of words of these counts."""
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.types + 1)))

    def place(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)


class Coder:
    """Contexts as small numbers: frequent words by rank, the most frequent first, then START, then words that a message names."""

    def __init__(self, frequent: Frequent):
        order = np.argsort(-frequent.counts, kind="stable")
        self.frequent, self.ranked = frequent, np.append(frequent.keys[order], np.uint64(START))
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """-1: to be named."""
        place = self.frequent.place(keys)
        out = np.full(len(keys), -1)
        out[place >= 0] = self.rank[place[place >= 0]]
        return out


def block_rows(block: int, ids: list[int], train: list[bool], texts: list[np.ndarray], distinct: list[bytes], buckets: int, coder: Coder) -> pd.DataFrame:
    """A block's tokens by bucket: words, tokens of each, contexts and documents of these, and contexts by name. Documents of training come first, the first
    so many. One row carries what the block knows of its documents: ids, flags, sizes, and the number and base score of their frequent words."""
    order = sorted(range(len(ids)), key=lambda i: not train[i])
    ids, train, texts = ([x[i] for i in order] for x in (ids, train, texts))
    sizes, distinct, back = block_tokens(texts, distinct)
    doc = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    place = coder.frequent.place(distinct)
    logs = np.zeros(len(distinct))
    logs[place >= 0] = coder.frequent.base(coder.frequent.counts[place[place >= 0]])
    own = squeeze(np.array(ids, np.int64), np.array(train, np.uint8), sizes, np.bincount(doc, (place >= 0)[back], len(sizes)).astype(np.int64), np.bincount(doc, logs[back], len(sizes)))
    bucket = (mix(distinct) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    code = coder.codes(distinct).astype(np.int32)
    base = len(coder.ranked)
    rare = distinct[code < 0]
    code[code < 0] = base + np.arange(len(rare))
    before = np.full(len(back), base - 1, np.int32)
    before[1:] = code[back[:-1]]
    before[(np.cumsum(sizes) - sizes)] = base - 1
    place = rank[back]
    order_of = packed_order(place, before)
    each = np.bincount(place, minlength=len(distinct))
    code, doc = before[order_of], doc[order_of]
    del back, place, before, order_of
    at = np.searchsorted(bucket[order], np.arange(buckets + 1))
    upto = np.append(0, np.cumsum(each))
    present = np.flatnonzero(np.diff(at))
    home, out = present[block % len(present)], []
    for b in present.tolist():
        i, j = int(at[b]), int(at[b + 1])
        c = code[upto[i] : upto[j]]
        some, c_rare = np.unique(c[c >= base], return_inverse=True)
        c[c >= base] = base + c_rare
        payload = squeeze(distinct[order[i:j]], each[i:j].astype(np.uint32), steps(c, each[i:j]), doc[upto[i] : upto[j]].astype(np.uint32), rare[some - base])
        out.append((block, b, sum(train), payload, own if b == home else None))
    return pd.DataFrame(out, columns=["block", "bucket", "known", "payload", "own"])


def word_counts(docs: DataFrame) -> DataFrame:
    """Words of the training texts among documents d, t, train: key (as signed number) and count."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count, ends = Counter(), 0
        for pdf in it:
            for t in pdf.t:
                count.update(words(t))
                ends += 1
            if len(count) > COUNTED:
                yield keyed(count)
                count = Counter()
        yield keyed(count)
        yield pd.DataFrame({"key": END.reshape(1).view(np.int64), "n": [ends]}).head(min(ends, 1))

    return docs.filter("train").select("t").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def keyed(count: Counter) -> pd.DataFrame:
    return pd.DataFrame({"key": word_keys(list(count)).view(np.int64), "n": np.fromiter(count.values(), np.int64, len(count))})


def frequent_words(counts: DataFrame, tokens: int, types: int) -> Frequent:
    """All words that occur at least so often that there are no more than CONTEXTS of them."""
    least, upto = 1, 0
    for r in counts.groupBy("n").count().orderBy(F.desc("n")).collect():
        upto += r["count"]
        if upto > CONTEXTS:
            least = r.n + 1
            break
    got = counts.filter(F.col("n") >= least).select("key", "n").toArrow()
    key, n = got["key"].to_numpy().view(np.uint64), got["n"].to_numpy()
    order = np.argsort(key)
    return Frequent(key[order], n[order].astype(np.int64), tokens, types)


def blocks(docs: DataFrame, buckets: int, frequent: Frequent) -> DataFrame:
    """Rows of all blocks of documents d, t, train."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, coder = TaskContext.get().partitionId() << 24, Coder(frequent)
        ids, train, texts, total, words_of = [], [], [], 0, numbering()
        for pdf in it:
            for i, t, known in zip(pdf.d, pdf.t, pdf.train, strict=True):
                w = words(t)
                ids.append(i)
                train.append(known)
                texts.append(np.fromiter(map(words_of.__getitem__, w), np.int32, len(w)))
                total += len(w) + 1
                if total >= BLOCK_TOKENS:
                    yield block_rows(number, ids, train, texts, list(words_of), buckets, coder)
                    number += 1
                    ids, train, texts, total, words_of = [], [], [], 0, numbering()
        if ids:
            yield block_rows(number, ids, train, texts, list(words_of), buckets, coder)

    return docs.mapInPandas(run, "block long, bucket int, known int, payload binary, own binary")


def bucket_model(key: tuple, pdf: pd.DataFrame, coder: Coder) -> pd.DataFrame:
    """A bucket: pairs of each word, their contexts and counts in training; contexts, by last byte; the pair and document of each block's tokens; counts of all words
    that are not frequent; and the rows of blocks that came along."""
    found = [expand(p) for p in pdf.payload]
    vocabulary, back = np.unique(np.concatenate([p[0] for p in found]), return_inverse=True)
    own = np.repeat(back, np.concatenate([p[1] for p in found]))
    base = len(coder.ranked)
    codes = [unstepped(p[2], p[1]) for p in found]
    here = np.zeros(base, bool)
    for c in codes:
        here[c[c < base]] = True
    rare, named = np.unique(np.concatenate([p[4] for p in found]), return_inverse=True)
    contexts = np.concatenate([coder.ranked[here], rare])
    order = np.argsort(turned(contexts))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    number, ends = np.cumsum(here) - 1, np.cumsum([len(p[4]) for p in found])
    for k, (p, c) in enumerate(zip(found, codes, strict=True)):
        among = np.append(number, int(here.sum()) + named[ends[k] - len(p[4]) : ends[k]])
        codes[k] = rank[among[c]]
    pairs, place = np.unique(own * len(contexts) + np.concatenate(codes), return_inverse=True)
    sizes = np.array([len(p[3]) for p in found])
    message = np.repeat(np.arange(len(found)), sizes)
    doc = np.concatenate([p[3] for p in found])
    count = np.bincount(place, doc < np.repeat(pdf.known.to_numpy(np.int64), sizes), len(pairs)).astype(np.int64)
    order_of = packed_order(message, place)
    own, ctx = pairs // len(contexts), pairs % len(contexts)
    each = np.bincount(own, minlength=len(vocabulary))
    home = pdf[pdf.own.notna()]
    return pd.DataFrame({
        "bucket": [key[0]],
        "model": [squeeze(each.astype(np.uint32), steps(ctx, each), count.astype(np.uint32), contexts[order])],
        "asked": [squeeze(pdf.block.to_numpy(np.int64), sizes.astype(np.int64), steps(place[order_of], sizes), doc[order_of], (coder.frequent.place(vocabulary) < 0).astype(np.uint8))],
        "homes": [home.block.tolist()], "owns": [home.own.tolist()], "once": [int((count == 1).sum())], "twice": [int((count == 2).sum())],
    })


MODEL = "bucket int, model binary, asked binary, homes array<long>, owns array<binary>, once long, twice long"


def turned(contexts: np.ndarray) -> np.ndarray:
    """The last byte first: as numbers ascend, so do last bytes. Buckets and parts keep contexts in this order."""
    return contexts << np.uint64(56) | contexts >> np.uint64(8)


def part_of(contexts: np.ndarray, parts: int) -> np.ndarray:
    return (mix(contexts ^ END) % np.uint64(parts)).astype(np.int64)


def opened(model: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and count of each pair, and the contexts."""
    each, step, count, contexts = expand(model)
    return np.repeat(np.arange(len(each)), each), unstepped(step, each), count.astype(np.int64), contexts


def by_part(contexts: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Parts that have any of these contexts, and which."""
    part = part_of(contexts, parts)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
    return ((p, order[i:j]) for p, (i, j) in enumerate(zip(at, at[1:], strict=False)) if i < j)


def context_parts(model: DataFrame, parts: int) -> DataFrame:
    """A row for each part: buckets that have contexts there, how many and which of the part's, and the customers of these contexts."""

    def names(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.to_dict("records"):
                _, ctx, count, contexts = opened(r["model"])
                customers = np.bincount(ctx, count, len(contexts)).astype(np.int64)
                rows = [(p, r["bucket"], squeeze(contexts[i], customers[i])) for p, i in by_part(contexts, parts)]
                yield pd.DataFrame(rows, columns=["part", "bucket", "names"])

    def gather(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        names, n = zip(*(expand(x) for x in pdf.names), strict=True)
        distinct, place = np.unique(turned(np.concatenate(names)), return_inverse=True)
        customers = np.bincount(place, np.concatenate(n), len(distinct)).astype(np.int64)
        sizes = np.array([len(x) for x in names])
        return pd.DataFrame({"part": [key[0]], "places": [squeeze(pdf.bucket.to_numpy(np.int64), sizes, steps(place, sizes), customers)]})

    return model.select("bucket", "model").mapInPandas(names, "part int, bucket int, names binary").groupBy("part").applyInPandas(gather, "part int, places binary")


def context_totals(state: DataFrame, places: DataFrame, number: int) -> DataFrame:
    """What buckets need of their contexts after a sweep: customers and tables; a row for each bucket and part."""

    def run(key: tuple, known: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        buckets, sizes, step, customers = expand(known.places[0])
        place = unstepped(step, sizes)
        sent = sent.sort_values("bucket")
        tables = np.bincount(place, np.concatenate([expand(x)[0] for x in sent.payload]), len(customers)).astype(np.int64)
        ends = np.cumsum(sizes)
        rows = [(b, key[0], number, squeeze(narrow(customers[place[i:j]]), narrow(tables[place[i:j]]))) for b, i, j in zip(buckets.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True)]
        return pd.DataFrame(rows, columns=["bucket", "part", "number", "payload"])

    sent = state.filter("part >= 0").select("bucket", "part", "payload")
    return places.groupBy("part").cogroup(sent.groupBy("part")).applyInPandas(run, TOLD)


TOLD = "bucket int, part int, number int, payload binary"


def narrow(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint32) if not len(x) or x.max() < 1 << 32 else x


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive numbers, to about 1e-10."""
    x = np.asarray(x, np.float64)
    if x.size and x.min() > 12:
        return (x - 0.5) * np.log(x) - x + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x
    rising = x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6)
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / 1260 / (y * y)) / (y * y)) / y - np.log(rising)


@lru_cache(maxsize=8)
def log_stirling(d: float) -> np.ndarray:
    """Logs of the weights of all seatings of c customers at t tables, for c up to FEW: generalized Stirling numbers."""
    out = np.zeros((FEW + 1, FEW + 1))
    out[1, 1] = 1
    for c in range(1, FEW):
        t = np.arange(1, FEW + 1)
        out[c + 1, 1:] = out[c, :-1] + np.maximum(c - t * d, 0) * out[c, 1:]
    with np.errstate(divide="ignore"):
        return np.log(out)


@dataclass
class Opening:
    """What opening a table weighs for each dish with j tables already: (a + discount j) (b + s j) / (e + j). a: of the restaurant, without the dish's
    own tables; (b + s j) / (e + j): the dish's probability in the parent, where each own table is a customer."""

    a: np.ndarray
    b: np.ndarray
    s: np.ndarray
    e: np.ndarray

    def of(self, i: np.ndarray | tuple) -> Opening:
        return Opening(self.a[i], self.b[i], self.s[i], self.e[i])

    def at(self, j: np.ndarray, discount: float) -> np.ndarray:
        return (self.a + discount * j) * (self.b + self.s * j) / (self.e + j)


class Restaurants:
    """Dishes in restaurants: customers c, at tables t."""

    def __init__(self, c: np.ndarray, t: np.ndarray | None = None):
        """One table for each dish that has customers, unless it is known."""
        self.c = c.astype(np.int64)
        self.t = np.minimum(self.c, 1) if t is None else np.clip(t, np.minimum(self.c, 1), self.c).astype(np.int64)

    def recount(self, c: np.ndarray) -> None:
        """The dishes have c customers by now."""
        self.c = c.astype(np.int64)
        self.t = np.clip(self.t, np.minimum(self.c, 1), self.c)

    def open(self) -> np.ndarray:
        """Dishes of two customers and more; others have as many tables as customers."""
        return np.flatnonzero(self.c > 1)

    def reseat(self, opening: Opening, d: float, rng: np.random.Generator, dishes: np.ndarray | None = None) -> None:
        """Takes out all customers of every dish, or of these (the opening is theirs), and seats them anew.

        For a few customers the number of tables is drawn from its distribution. More are seated one after the other as a restaurant of like
        strength would, very many by leaps, TRIES times, and one of these seatings and the present one is taken by what they weigh over
        what they were proposed with. Work goes with tables, not with customers.
        """
        if dishes is not None:
            part = Restaurants(self.c[dishes], self.t[dishes])
            part.reseat(opening, d, rng)
            self.t[dishes] = part.t
            return
        few, many = np.flatnonzero((self.c > 0) & (self.c <= FEW)), np.flatnonzero(self.c > FEW)
        self.t[few] = tables_of_few(self.c[few], opening.of(few), d, rng)
        if len(many):
            n, o = self.c[many], opening.of(many)
            strength = like_strength(n, o, d)
            found = [self.t[many], *seated(np.tile(n, TRIES), np.tile(strength, TRIES), d, rng).reshape(TRIES, -1)]
            weight = np.stack([log_ratio(t, o, strength, d) for t in found])
            upto = np.cumsum(np.exp(weight - weight.max(0)), 0)
            self.t[many] = np.stack(found)[(upto < rng.random(len(many)) * upto[-1]).sum(0), np.arange(len(many))]


def like_strength(c: np.ndarray, opening: Opening, d: float) -> np.ndarray:
    """The strength at which a restaurant of c customers opens a table as these dishes do where both have the same number of tables, about."""
    t = np.ones(len(c))
    for _ in range(8):
        strength = np.maximum(opening.at(t, d) - d * t, -0.9 * d)
        mean = np.exp(log_gamma(strength + 1) - log_gamma(strength + d) + log_gamma(strength + d + c) - log_gamma(strength + c)) / d - strength / d
        t = np.clip((t + mean) / 2, 1, c)
    return strength


def one_by_one(c: np.ndarray, strength: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of restaurants after c customers; the next customer of all of them is seated at once."""
    order = np.argsort(-c, kind="stable")
    n, w, t = c[order], strength[order], np.ones(len(c))
    left = np.searchsorted(-n, -np.arange(1, n.max(initial=1))).tolist()
    k = 0
    while k < len(left):
        m = left[k]
        some = left[k : k + max(1, DRAWN // m)]
        least = needed(np.arange(k + 1, k + 1 + len(some))[:, None], w[:m], d, rng.random((len(some), m)))
        for m, x in zip(some, least, strict=True):
            t[:m] += x[:m] < t[:m]
        k += len(some)
    out = np.empty(len(c), np.int64)
    out[order] = t
    return out


def needed(k: np.ndarray, strength: np.ndarray | float, d: float, chance: np.ndarray) -> np.ndarray:
    """Tables that there must be more of for customer k to open one, which has the chance (strength + d tables) / (strength + k)."""
    return (chance * (strength + k) - strength) / d


def by_leaps(n: int, strength: float, d: float, rng: np.random.Generator) -> int:
    """Tables of a restaurant after n customers, of whom only some are looked at. While there are no more tables than most, nobody from k on opens one by more
    than chance p: whoever draws less than p is a candidate, and candidates draw again for what they have of it. Beyond most, a quarter more customers, or the last candidate drawn, p is set anew."""
    k, t = 1, 1
    while k < n:
        most = t + int(0.3 * (strength / d + t)) + 32
        end = min(n, k + max(256, k // 4))
        p = min(1.0, (strength + d * most) / (strength + k))
        at = np.arange(k, min(end, k + DRAWN)) if p == 1 else k - 1 + np.cumsum(rng.geometric(p, min(int(1.1 * p * (end - k)) + 32, DRAWN)))
        k = min(end, int(at[-1]) + 1)
        at = at[at < end]
        for i, x in enumerate(needed(at, strength, d, p * rng.random(len(at))).tolist()):
            if x < t:
                t += 1
                if t > most:
                    k = int(at[i]) + 1
                    break
    return t


def seated(c: np.ndarray, strength: np.ndarray, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of restaurants after c customers. Customer k opens one by strength + d tables against k - d tables."""
    tables = np.ones(len(c), np.int64)
    some = np.flatnonzero(c <= ONE_BY_ONE)
    tables[some] = one_by_one(c[some], strength[some], d, rng)
    for i in np.flatnonzero(c > ONE_BY_ONE).tolist():
        tables[i] = by_leaps(int(c[i]), float(strength[i]), d, rng)
    return tables


def log_ratio(t: np.ndarray, opening: Opening, strength: np.ndarray, d: float) -> np.ndarray:
    """Log of what t tables weigh over what a restaurant of this strength would give them; the seatings themselves weigh the same."""

    def product(start: np.ndarray, step: np.ndarray) -> np.ndarray:
        """Log of (start + step)(start + 2 step)... up to t - 1 steps."""
        far = start > 1e7 * step
        x = np.where(far, 1.0, start / np.where(far, 1.0, step))
        near = (t - 1) * np.log(np.where(far, 1.0, step)) + log_gamma(x + t) - log_gamma(x + 1)
        return np.where(far, (t - 1) * np.log(np.maximum(start + step * t / 2, 1e-300)), near)

    each = np.full(len(t), d)
    return product(opening.a, each) + product(opening.b, opening.s) - product(opening.e, np.ones(len(t))) - product(strength, each)


def tables_of_few(c: np.ndarray, opening: Opening, d: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with FEW customers at most, each from its distribution."""
    out = np.ones(len(c), np.int64)
    order = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[order], np.arange(1, FEW + 2))
    for k in range(2, FEW + 1):
        for i in range(int(bounds[k - 1]), int(bounds[k]), 1 << 16):
            rows = order[i : min(i + (1 << 16), int(bounds[k]))]
            o = opening.of(rows)
            ln = np.cumsum(np.log(o.of((slice(None), None)).at(np.arange(k, dtype=np.float64), d)), 1) + log_stirling(d)[k, 1 : k + 1]
            upto = np.cumsum(np.exp(ln - ln.max(1, keepdims=True)), 1)
            out[rows] = 1 + (upto < rng.random(len(rows))[:, None] * upto[:, -1:]).sum(1).clip(0, k - 1)
    return out


@dataclass
class Hall:
    """What all restaurants share in a sweep: customers and tables of contexts (those of a bucket), of their last bytes, and of the root, and the discounts of
    the three levels."""

    customers: np.ndarray
    tables: np.ndarray
    byte_customers: np.ndarray
    byte_tables: np.ndarray
    root_customers: float
    root_tables: float
    types: int
    discounts: tuple[float, float, float]

    def root(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.discounts[2] * t, 0) + self.root_room() / (self.types + 1)) / (STRENGTH + self.root_customers)

    def root_room(self) -> float:
        return STRENGTH + self.discounts[2] * self.root_tables

    def byte(self, k: np.ndarray, c: np.ndarray, t: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.discounts[1] * t, 0) + self.byte_room(k) * root) / (STRENGTH + self.byte_customers[k])

    def byte_room(self, k: np.ndarray) -> np.ndarray:
        return STRENGTH + self.discounts[1] * self.byte_tables[k]

    def pair(self, ctx: np.ndarray, c: np.ndarray, t: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return (np.maximum(c - self.discounts[0] * t, 0) + self.room(ctx) * byte) / (STRENGTH + self.customers[ctx])

    def room(self, ctx: np.ndarray) -> np.ndarray:
        return STRENGTH + self.discounts[0] * self.tables[ctx]


class Tree:
    """All restaurants of the words of a bucket: pairs (word, context), groups (word, last byte) and words.

    own, ctx, count: of each pair, by word; seats: what held() gave after the sweep before, none before the first; last: the last byte of each
    context, where contexts' numbers don't end in it.
    """

    def __init__(self, own: np.ndarray, ctx: np.ndarray, count: np.ndarray, seats: list[np.ndarray] | None = None, last: np.ndarray | None = None):
        self.own, self.ctx, self.count = own.astype(np.int64), ctx.astype(np.int64), count.astype(np.int64)
        code = self.own * BYTES + (self.ctx & 255 if last is None else last[self.ctx])
        new = np.diff(code, prepend=-1)
        if len(code) and new.min() >= 0:  # pairs lie by group
            groups, self.group = code[new > 0], np.cumsum(new > 0) - 1
        else:
            groups, self.group = np.unique(code, return_inverse=True)
        self.group_own, self.byte = groups // BYTES, groups % BYTES
        n = int(self.own[-1]) + 1 if len(own) else 0
        known = seats or [None] * 3
        self.pairs = Restaurants(self.count, known[0])
        self.groups = Restaurants(self.tables_by_group(len(groups)), known[1])
        self.words = Restaurants(np.bincount(self.group_own, self.groups.t, n), known[2])

    def tables_by_group(self, n: int) -> np.ndarray:
        return np.bincount(self.group, self.pairs.t, n).astype(np.int64)

    def held(self) -> list[np.ndarray]:
        """Tables of all dishes, level by level."""
        return [x.t.astype(np.int32) for x in (self.pairs, self.groups, self.words)]

    def predict(self, hall: Hall) -> np.ndarray:
        """Probability of each pair's word in its context."""
        root = hall.root(self.words.c, self.words.t)
        byte = hall.byte(self.byte, self.groups.c, self.groups.t, root[self.group_own])
        return hall.pair(self.ctx, self.count, self.pairs.t, byte[self.group])

    def sweep(self, hall: Hall, rng: np.random.Generator) -> None:
        """Seats all customers anew, level by level from below; a level's tables are the customers of the next."""
        d = hall.discounts
        root, room = hall.root(self.words.c, self.words.t), hall.byte_room(self.byte)
        i = self.pairs.open()
        group, own = self.group[i], self.pairs.t[i]
        rest, each = without_own(group, own, self.groups, d[1])
        grand = (room * root[self.group_own])[group]
        customers = STRENGTH + hall.byte_customers[self.byte][group] - own
        self.pairs.reseat(Opening(hall.room(self.ctx[i]) - d[0] * own, rest + grand, each, customers), d[0], rng, i)
        self.groups.recount(self.tables_by_group(len(self.group_own)))
        i = self.groups.open()
        own = self.groups.t[i]
        rest, each = without_own(self.group_own[i], own, self.words, d[2])
        customers = STRENGTH + hall.root_customers - own
        self.groups.reseat(Opening(room[i] - d[1] * own, rest + hall.root_room() / (hall.types + 1), each, customers), d[1], rng, i)
        n = len(self.words.c)
        self.words.recount(np.bincount(self.group_own, self.groups.t, n))
        even, never = np.full(n, FAR / (hall.types + 1)), np.zeros(n)
        self.words.reseat(Opening(hall.root_room() - d[2] * self.words.t, even, never, np.full(n, FAR)), d[2], rng)


def without_own(parent: np.ndarray, own: np.ndarray, above: Restaurants, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each dish, what its parent's customers but its own tables weigh there, and what each own one adds; tables of the parent are shared alike."""
    c, t = above.c[parent], above.t[parent]
    share = t / np.maximum(c, 1)
    return (c - own) * (1 - d * share), 1 - d * share


SWEPT = "bucket int, part int, payload binary, customers long, tables long, group_once long, group_twice long, once long, twice long, bytes array<long>"


def report(bucket: int, tree: Tree, contexts: np.ndarray, parts: int) -> pd.DataFrame:
    """Rows of a bucket after a sweep: its seats, what it adds to the totals of last bytes and of the root, in part -1, and tables of contexts for each part."""
    total = np.concatenate([np.bincount(tree.byte, x, BYTES) for x in (tree.groups.c, tree.groups.t)]).astype(np.int64)
    g, w = tree.groups.c, tree.words.c
    own = (bucket, -1, squeeze(*tree.held()), int(w.sum()), int(tree.words.t.sum()), *(int((x == k).sum()) for x in (g, w) for k in (1, 2)), total)
    tables = np.bincount(tree.ctx, tree.pairs.t, len(contexts)).astype(np.int64)
    return pd.DataFrame([own, *((bucket, p, squeeze(narrow(tables[i])), *[0] * 6, None) for p, i in by_part(contexts, parts))], columns=[x.split()[0] for x in SWEPT.split(", ")])


def first_state(model: DataFrame, parts: int) -> DataFrame:
    """Every dish at one table."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.to_dict("records"):
                *pairs, contexts = opened(r["model"])
                yield report(r["bucket"], Tree(*pairs, last=last_bytes(contexts)), contexts, parts)

    return model.select("bucket", "model").mapInPandas(run, SWEPT)


def last_bytes(contexts: np.ndarray) -> np.ndarray:
    return (contexts & np.uint64(255)).astype(np.int64)


def seats_of(state: DataFrame, places: DataFrame, number: int) -> DataFrame:
    """What a bucket starts its next sweep from: its seats (part -1) and the totals of its contexts."""
    own = state.filter("part < 0").select("bucket", "part", F.lit(number).cast("int").alias("number"), "payload")
    return own.unionByName(context_totals(state, places, number))


def started(told: pd.DataFrame, hall: Hall, contexts: np.ndarray, parts: int) -> tuple[list[np.ndarray], Hall]:
    """Seats of a bucket, and the hall with the totals of its contexts."""
    raw = dict(zip(told.part, told.payload, strict=True))
    customers, tables = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64)
    for p, i in by_part(contexts, parts):
        customers[i], tables[i] = expand(raw[p])
    return expand(raw[-1]), replace(hall, customers=customers, tables=tables)


def sweep(model: DataFrame, told: DataFrame, hall: Hall, number: int, parts: int) -> DataFrame:
    """The state of every bucket after a sweep."""

    def run(key: tuple, known: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        *pairs, contexts = opened(known.model[0])
        seats, own = started(told, hall, contexts, parts)
        tree = Tree(*pairs, seats, last_bytes(contexts))
        tree.sweep(own, np.random.default_rng([key[0], number]))
        return report(key[0], tree, contexts, parts)

    return model.select("bucket", "model").groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(run, SWEPT)


def discount_of(once: int, twice: int) -> float:
    """The usual estimate from counts of one and two; kept inside (0, 1)."""
    return min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base score and the model's log10 probability of each text, learned from those that train holds for.

    Null and empty texts are one end token. Words never seen in training get the base measure's share. Repeated ids count each for itself;
    rows without an id are left out. Without a training text every token has the even base probability.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"), F.coalesce(train, F.lit(False)).alias("train")).filter("d is not null")
    buckets = max(4, -(-docs.count() // BUCKET_DOCS))
    parts = max(4, buckets // BUCKETS_A_PART)
    counts = written(word_counts(rows), "counts")
    n_train, n_types = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    coder = Coder(frequent_words(counts, n_train, n_types))
    gathered = blocks(rows, buckets, coder.frequent)
    model = written_by(gathered.groupBy("bucket").applyInPandas(lambda key, pdf: bucket_model(key, pdf, coder), MODEL), "model", "bucket", 2 * buckets)
    places = written_by(context_parts(model, parts), "places", "part", 2 * parts)
    first = discount_of(*model.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("once", "twice"))).first())

    def hall_of(done: DataFrame) -> Hall:
        own = done.filter("part < 0")
        now = own.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("customers", "tables", "group_once", "group_twice", "once", "twice"))).first()
        total = np.zeros(2 * BYTES)
        for r in own.select(F.posexplode("bytes").alias("at", "n")).groupBy("at").agg(F.sum("n").alias("n")).collect():
            total[r["at"]] = r["n"]
        discounts = first, discount_of(now.group_once, now.group_twice), discount_of(now.once, now.twice)
        none = np.zeros(0)
        return Hall(none, none, total[:BYTES], total[BYTES:], now.customers, now.tables, n_types, discounts)

    state = written(first_state(model, parts), "sweep")
    hall, halls, kept = hall_of(state), {}, None
    for number in range(1, BURN_IN + SAMPLES + 1):
        state = written(sweep(model, seats_of(state, places, number - 1), hall, number, parts), "sweep")
        hall = hall_of(state)
        if number > BURN_IN:
            told = seats_of(state, places, number)
            halls[number], kept = hall, told if kept is None else kept.unionByName(told)

    def answer(key: tuple, known: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        r = known.iloc[0]
        *pairs, contexts = opened(r.model)
        p = np.zeros(len(pairs[0]))
        for number, h in halls.items():
            seats, own = started(told[told.number == number], h, contexts, parts)
            p += Tree(*pairs, seats, last_bytes(contexts)).predict(own)
        logs = np.log10(p / len(halls))
        block, sizes, step, doc, rare = expand(r.asked)
        place, ends = unstepped(step, sizes), np.cumsum(sizes)
        c_word = np.bincount(pairs[0], pairs[2], len(rare))
        homes, out = dict(zip(r.homes, r.owns, strict=True)), []
        for b, i, j in zip(block.tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
            at, docs = place[i:j], doc[i:j]
            some = np.flatnonzero(np.bincount(docs))
            score = np.bincount(docs, logs[at])[some].astype(np.float32)
            w = pairs[0][at]
            left, theirs = np.unique(docs[rare[w] > 0], return_inverse=True)
            c = c_word[w[rare[w] > 0]]
            every = np.array([len(some)])
            both = steps(some.astype(np.int64), every), score, steps(left.astype(np.int64), np.array([len(left)])), np.bincount(theirs, c > 0, len(left)).astype(np.uint32), np.bincount(theirs, coder.frequent.base(c), len(left))
            out.append((b, squeeze(*both), homes.get(b)))
        return pd.DataFrame(out, columns=["block", "answers", "own"])

    asked = model.select("bucket", "model", "asked", "homes", "owns")
    answers = asked.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInPandas(answer, "block long, answers binary, own binary")

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, known, sizes, n_known, base = (x.copy() for x in expand(pdf.own.dropna().iloc[0]))
        score = np.zeros(len(ids))
        for raw in pdf.answers.sort_values():
            some, logs, left, n, c = expand(raw)
            score[np.cumsum(some, dtype=np.int64)] += logs
            at = np.cumsum(left, dtype=np.int64)
            n_known[at] += n
            base[at] += c
        return pd.DataFrame({"doc_id": ids, "held_out": known == 0, "n_tokens": sizes, "n_known": n_known, "train_tokens": n_train, "base_score": base, "score": score})

    return answers.groupBy("block").applyInPandas(total, SCORES)


def op8_pitman_yor(spark, sf_dir: str) -> DataFrame:
    """Scores of every document; the fold crc32 mod 5 = 1 is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_documents(docs, fold("doc_id", 5) != 1)
