"""Alignment of two tokenizers over whitespace-token anchors.

Every text is tokenized whole by both. Where both have a token end and the next token of either opens with a space, the document is cut:
such an anchor is certain, as the bytes of both sides are compared first. Between two anchors lies a window of token ids, mostly one word,
and words repeat: what a window's alignment looks like depends on its ids alone, so it is worked out once for each pair of id tuples that a task meets
and looked up ever after.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import Memo, batches_of, mix, slices, table, written
from strandline.llm.token_store import PIECE_BYTES, PlaneEncoder

MEMO_BYTES = 64 << 20  # of id tuples and alignments that a task keeps
HELD_PAIRS = 4_000_000  # distinct pairs whose counts may go to every task, 12 bytes each
B_BITS = 20


def entry_bytes() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable ones stand for themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of every id: their lengths, their first bytes, and all of them in a row."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.length) - self.length
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.spaced = np.fromiter((t[:1] == b" " for t in tokens), bool, len(tokens))

    def spelled(self, ids: np.ndarray) -> np.ndarray:
        """The ids' bytes, one after the other."""
        return self.pool[slices(self.start[ids], self.length[ids])]


@lru_cache(maxsize=1)
def byte_level(path: str):
    """The byte-level tokenizer, with strings of special tokens as plain text, and its vocabulary."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.encode_special_tokens = True
    code = entry_bytes()
    tokens = [b""] * (max(model.get_vocab().values()) + 1)
    for entry, i in model.get_vocab().items():
        tokens[i] = bytes(code[c] for c in entry) if all(c in code for c in entry) else entry.encode()
    return model, Vocabulary(tokens)


@lru_cache(maxsize=1)
def pieces(path: str):
    """The piece tokenizer and its vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        tokens.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())
    return model, Vocabulary(tokens)


class PieceCoder(PlaneEncoder):
    """The piece tokenizer, with a text's words encoded once each.

    No piece has a space mark behind another character (which is checked), so no merge crosses from a word into the spaces before the next,
    and spaces with the word behind them are encoded alike wherever they are. Texts with other characters than Latin go to the library whole.
    """

    def __init__(self, model, most: int):
        if any("▁" in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size())):
            raise ValueError("pieces of this model cross words")
        self.model, self.special = model, ["▁"]
        self.tables(most)

    def cuts(self, cp: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(cp)
        space = cp == 0x20
        run = first[:n].copy()
        run[1:] |= space[1:] & ~space[:-1]
        # spaces that end a text belong to the word before
        at = np.flatnonzero(run & space & ~first[:n])
        other = np.append(np.flatnonzero(~space | first[:n]), n)
        stop = other[np.searchsorted(other, at + 1)]
        run[at[first[stop]]] = False
        return np.flatnonzero(run)

    def pieces_ids(self, pieces: list[str]) -> list[np.ndarray]:
        return [np.array(x, np.uint32) for x in self.model.encode([p[1:] for p in pieces], num_threads=1)]

    def whole_ids(self, texts: list[str]) -> list[np.ndarray]:
        return self.pieces_ids(texts)


DIGITS = [str(i).encode() for i in range(1 << 16)]
DIGIT_POOL = np.frombuffer(b"".join(DIGITS), np.uint8)
DIGIT_SIZE = np.fromiter(map(len, DIGITS), np.int64, len(DIGITS))
DIGIT_START = np.cumsum(DIGIT_SIZE) - DIGIT_SIZE


def aligned(a: np.ndarray, b: np.ndarray, a_size: np.ndarray, b_size: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Alignments of windows, one after the other: text of the groups, each closed by ';', as bytes and how many of each window; linked pairs and how
    many of each; groups of each. a, b: ids, whose sizes in bytes agree window by window; a_n, b_n: ids of each window."""
    a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
    ends = np.union1d(a_end, b_end)
    i, j = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    pairs = a[i].astype(np.int64) << B_BITS | b[j]
    shared = ends[(a_end[i] == ends) & (b_end[j] == ends)]
    # where a window ends, so does a group
    last = np.append(0, a_end)[np.cumsum(a_n)]
    links, groups = np.diff(np.searchsorted(ends, last, "right"), prepend=0), np.diff(np.searchsorted(shared, last, "right"), prepend=0)
    group = np.concatenate([np.searchsorted(shared, a_end), np.searchsorted(shared, b_end)])
    side = np.repeat([0, 1], [len(a), len(b)])
    order = np.argsort(2 * group + side, kind="stable")
    ids, group, side = np.concatenate([a, b]).astype(np.int64)[order], group[order], side[order]
    size = DIGIT_SIZE[ids] + 1
    upto = np.cumsum(size)
    text = np.empty(upto[-1] if len(upto) else 0, np.uint8)
    stop = np.append((group[1:] != group[:-1]) | (side[1:] != side[:-1]), True)[: len(ids)]
    closing = np.where(stop, np.where(side == 0, ord("|"), ord(";")), ord(","))
    mark = np.zeros(len(text), bool)
    mark[upto - 1] = True
    text[mark] = closing
    text[~mark] = DIGIT_POOL[slices(DIGIT_START[ids], size - 1)]
    return text, np.diff(np.append(0, upto)[np.cumsum(a_n + b_n)], prepend=0), pairs, links, groups


class Windows:
    """Aligns batches of texts; knows the windows that it met, up to so many bytes."""

    def __init__(self, a_path: str, b_path: str, memo_bytes: int = MEMO_BYTES):
        self.a_model, self.a = byte_level(a_path)
        self.b_model, self.b = pieces(b_path)
        if max(len(self.a.length), len(self.b.length)) > len(DIGITS):
            raise ValueError("ids of 16 bits at most")
        self.coder, self.piece_coder = PlaneEncoder(a_path), PieceCoder(self.b_model, PIECE_BYTES)
        self.coder.model, self.coder.special = self.a_model, []
        rng = np.random.default_rng(11)
        noise = rng.integers(1, 2**63, (2, len(DIGITS)), dtype=np.uint64) | np.uint64(1)
        self.a_noise, self.b_noise = noise
        self.base = 0x9E3779B97F4A7C15
        self.power = self.unpower = np.empty(0, np.uint64)
        #: ids of either side, groups as text, linked pairs, number of groups
        self.memo = Memo(np.uint16, np.uint16, np.uint8, np.int64, np.int32, most=memo_bytes)
        self.worked = 0  # windows whose alignment was worked out

    def rolled(self, noise: np.ndarray, ids: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of each slice of ids."""
        n = len(ids)
        if len(self.power) <= n:
            self.power = np.cumprod(np.full(2 * n + 2, self.base, np.uint64))
            self.unpower = np.cumprod(np.full(2 * n + 2, pow(self.base, -1, 2**64), np.uint64))
        upto = np.zeros(n + 1, np.uint64)
        np.cumsum(noise[ids] * self.power[:n], out=upto[1:])
        return mix((upto[end] - upto[start]) * self.unpower[start] + (end - start).astype(np.uint64))

    def worked_out(self, a: np.ndarray, b: np.ndarray, a_n: np.ndarray, b_n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Values and numbers, as the memo has them, of windows whose ids stand one after the other."""
        self.worked += len(a_n)
        text, text_n, pairs, links, groups = aligned(a, b, self.a.length[a], self.b.length[b], a_n, b_n)
        return [(a, a_n), (b, b_n), (text, text_n), (pairs, links), (groups, np.ones(len(groups), np.int64))]

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and their numbers of each text, and which texts both sides spell out; the others have none."""
        whole = [" " + t for t in texts]
        a, a_n = self.coder.encode(whole)
        b, b_n = self.piece_coder.encode(whole)
        a, b = a.astype(np.int64), b.astype(np.int64)
        raw = [t.encode("utf-8", "replace") if len(t) > 1 else b"" for t in whole]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        said, ok = np.frombuffer(b"".join(raw), np.uint8), size > 0
        for ids, n, vocabulary in ((a, a_n, self.a), (b, b_n, self.b)):
            spelled = vocabulary.spelled(ids)
            got = np.diff(np.append(0, np.cumsum(vocabulary.length[ids]))[np.cumsum(n)], prepend=0)
            if np.array_equal(got, size) and np.array_equal(spelled, said):
                continue
            at, mine = np.cumsum(size) - size, np.cumsum(got) - got
            for i in range(len(texts)):
                ok[i] &= got[i] == size[i] and np.array_equal(spelled[mine[i] : mine[i] + got[i]], said[at[i] : at[i] + size[i]])
        if not ok.all():
            a, b = a[np.repeat(ok, a_n)], b[np.repeat(ok, b_n)]
            a_n, b_n = np.where(ok, a_n, 0), np.where(ok, b_n, 0)
        return a, a_n, b, b_n, ok

    def windows(self, a: np.ndarray, a_n: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end on either side: at shared ends before space-marked tokens of both, and at the ends of texts."""
        a_end, b_end = np.cumsum(self.a.length[a]), np.cumsum(self.b.length[b])
        _, i, j = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
        last = np.zeros(len(a) + 1, bool)
        last[np.cumsum(a_n)] = True
        x, y = np.append(self.a.spaced[a], False), np.append(self.b.spaced[b], False)
        cut = last[i + 1] | (x[i + 1] & y[j + 1])
        return i[cut] + 1, j[cut] + 1

    def align(self, texts: list[str]) -> dict:
        """For each text: n_a, n_b, n_groups, n_links, groups; and doc, pair, times: the distinct pairs of each text and how often each links."""
        if self.memo.full():
            self.memo.forget()
        a, a_n, b, b_n, ok = self.tokens(texts)
        a_to, b_to = self.windows(a, a_n, b)
        a_from, b_from = np.append(0, a_to)[: len(a_to)], np.append(0, b_to)[: len(b_to)]
        key = mix(self.rolled(self.a_noise, a, a_from, a_to) + np.uint64(0x632BE59BD9B4E019) * self.rolled(self.b_noise, b, b_from, b_to))
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        new = self.memo.find(distinct) < 0
        if new.any():
            w = where[new]
            x, y = a_to[w] - a_from[w], b_to[w] - b_from[w]
            self.memo.add(distinct[new], *self.worked_out(a[slices(a_from[w], x)], b[slices(b_from[w], y)], x, y))
        at = self.memo.find(distinct)[back]
        kinds = [self.memo.get(k, at) for k in range(5)]
        if not all(np.array_equal(n, to - start) and np.array_equal(ids, own) for (ids, n), own, start, to in ((kinds[0], a, a_from, a_to), (kinds[1], b, b_from, b_to))):
            kinds = self.worked_out(a, b, a_to - a_from, b_to - b_from)  # two windows share a hash
        bounds = np.searchsorted(a_to, np.append(0, np.cumsum(a_n)), "right")  # windows before each text
        per = lambda n: np.append(0, np.cumsum(n))[bounds]
        (text, text_n), (pair, links), (groups, _) = kinds[2:]
        text_at, n_links, said = per(text_n), np.diff(per(links)), text.tobytes()
        both, times = np.unique(np.repeat(np.arange(len(texts)), n_links) << 2 * B_BITS | pair, return_counts=True)
        return {
            "ok": ok, "n_a": a_n, "n_b": b_n, "n_groups": np.diff(per(groups)), "n_links": n_links, "groups": [said[s : max(s, e - 1)] for s, e in zip(text_at[:-1].tolist(), text_at[1:].tolist(), strict=True)],
            "doc": both >> 2 * B_BITS, "pair": both & (1 << 2 * B_BITS) - 1, "times": times,
        }


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def align_documents(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """A row for each document: its numbers, the checksum of its groups (and the groups), and its distinct linked pairs (a << 20 | b, little-endian
    64-bit) with their times (32-bit), in order.

    Null and empty texts, and those whose tokens don't spell out space and text, have no tokens: zeros, '' and no pairs. Every row is a
    document of its own, repeated and null ids too. Other columns are not read.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        windows = Windows(a_path, b_path)
        for pdf in it:
            texts = [t or "" for t in pdf.t.tolist()]
            for s, e in batches_of(texts, 1_000_000):
                x = windows.align(texts[s:e])
                upto = np.searchsorted(x["doc"], np.arange(e - s + 1))
                pair, times = x["pair"].astype("<i8"), x["times"].astype("<u4")
                parts = list(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))
                out = {k: x[k] for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [hashlib.sha256(g).hexdigest() if ok else "" for g, ok in zip(x["groups"], x["ok"].tolist(), strict=True)]}
                out |= {"pairs": [pair[p:q].tobytes() for p, q in parts], "times": [times[p:q].tobytes() for p, q in parts]}
                if with_groups:
                    out["groups"] = [g.decode() for g in x["groups"]]
                yield pd.DataFrame({"doc_id": pdf.d.iloc[s:e].astype("Int64").to_numpy(), **out})

    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t"))
    return rows.mapInPandas(run, ALIGNED + (", groups string" if with_groups else ""))


def pair_counts(rows: DataFrame) -> DataFrame:
    """a, b, n: in how many of the documents each pair is linked. Each task sums up its documents before anything is sent."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for pdf in it:
            held += [np.frombuffer(x, "<i8") for x in pdf.pairs]
            size += sum(map(len, pdf.pairs)) // 8
            if size > 4_000_000:
                pair, n = np.unique(np.concatenate(held), return_counts=True)
                yield pd.DataFrame({"pair": pair, "n": n})
                held, size = [], 0
        if held:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            yield pd.DataFrame({"pair": pair, "n": n})

    sums = rows.select("pairs").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    return sums.select(F.shiftright("pair", B_BITS).alias("a"), (F.col("pair").bitwiseAND((1 << B_BITS) - 1)).alias("b"), "n")


def with_highest(counts: DataFrame) -> DataFrame:
    """pair, n, best: whether no pair of the same a has a higher count."""
    top = counts.groupBy("a").agg(F.max("n").alias("top"))
    return counts.join(top, "a").select((F.shiftleft("a", B_BITS).bitwiseOR(F.col("b"))).alias("pair"), "n", (F.col("n") == F.col("top")).alias("best"))


def score_links(rows: DataFrame, counts: DataFrame, most: int = HELD_PAIRS) -> DataFrame:
    """The rows of align_documents with n_best and count_sum, from the pairs' counts over the corpus.

    Counts of so many pairs at most go to every task; more are joined by pair, each document's links being summed up after.
    """
    judged = written(with_highest(counts), "pair_counts")
    if judged.limit(most + 1).count() <= most:
        table_ = judged.toPandas().sort_values("pair")
        shipped = rows.sparkSession.sparkContext.broadcast((table_.pair.to_numpy(np.int64), np.where(table_.best.to_numpy(bool), -1, 1) * table_.n.to_numpy(np.int64)))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            pair, n = shipped.value
            for pdf in it:
                size = np.array([len(x) // 8 for x in pdf.pairs], np.int64)
                at = n[np.searchsorted(pair, np.frombuffer(b"".join(pdf.pairs), "<i8"))] if size.sum() else np.empty(0, np.int64)
                times = np.frombuffer(b"".join(pdf.times), "<u4").astype(np.int64)
                upto = np.append(0, np.cumsum(size))
                sums = [np.append(0, np.cumsum(x))[upto] for x in (np.where(at < 0, times, 0), np.abs(at) * times)]
                yield pdf.drop(columns=["pairs", "times"]).assign(doc_id=pdf.doc_id.astype("Int64"), n_best=np.diff(sums[0]), count_sum=np.diff(sums[1]))

        return rows.mapInPandas(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
    return joined_links(rows, judged)


def joined_links(rows: DataFrame, judged: DataFrame) -> DataFrame:
    """What score_links returns, by a join of every document's pairs."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            size = np.array([len(x) // 8 for x in pdf.pairs], np.int64)
            if size.sum():
                yield pd.DataFrame({"key": np.repeat(pdf.key.to_numpy(), size), "pair": np.frombuffer(b"".join(pdf.pairs), "<i8"), "times": np.frombuffer(b"".join(pdf.times), "<u4").astype(np.int64)})

    keyed = written(rows.withColumn("key", F.expr("uuid()")), "keyed")
    links = keyed.select("key", "pairs", "times").mapInPandas(run, "key string, pair long, times long")
    sums = links.join(judged, "pair").groupBy("key").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    out = keyed.drop("pairs", "times").join(sums, "key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", *zero)


def op11_space_anchors(spark, sf_dir: str) -> DataFrame:
    """Groups and links of every document under both tokenizers, and the corpus counts of its links."""
    docs = table(spark, sf_dir, "documents")
    rows = written(align_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "aligned")
    return score_links(rows, pair_counts(rows))
