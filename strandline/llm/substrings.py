"""Substring deduplication: seed and extend.

Seeds are winnowed anchors: in each window of LENGTH words the smallest hash of SEED words, the rightmost of equal ones, so that equal
windows have the same anchor at the same place. An occurrence is an anchor with the run of windows that chose it. Occurrences of one
anchor meet in one partition, in order; those that agree with an earlier one in their whole run are repeats at once, and where
runs of one anchor differ, the match is extended word by word by comparing the windows left and right of the anchor. Repeated
windows that follow each other make up a maximal repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import mix, ngrams, table, word_hashes, words, written

LENGTH, SEED = 20, 8
STEP = np.uint64(0xD6E8FEB86659FD93)
UNSTEP = np.uint64(pow(0xD6E8FEB86659FD93, -1, 2**64))


class Rolled:
    """Hashes of any span of a sequence of word hashes."""

    def __init__(self, h: np.ndarray):
        n = len(h)
        self.unpower = np.cumprod(np.append(np.uint64(1), np.full(n, UNSTEP)))
        self.upto = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(h) * np.cumprod(np.append(np.uint64(1), np.full(max(n - 1, 0), STEP)))[:n], out=self.upto[1:])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.upto[end] - self.upto[start]) * self.unpower[start])


def runs(flag: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position and length of runs of neighbours that are flagged and have the same key."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at
    new = np.append(True, (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]]))
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at)))


OCCURRENCE = "anchor long, context long, doc long, start int, windows int, repeat boolean"


def occurrences(ids: np.ndarray, docs: list[list[bytes]], length: int = LENGTH, seed: int = SEED) -> pd.DataFrame:
    """Occurrences of some documents, those of smaller ids first. Windows that repeat within them are set aside as repeats here."""
    sizes = np.array([len(d) for d in docs])
    h = word_hashes([w for d in docs for w in d])
    n = len(h) - length + 1
    none = pd.DataFrame({"anchor": np.empty(0, np.int64), "context": np.empty(0, np.int64), "doc": np.empty(0, np.int64), "start": np.empty(0, np.int32), "windows": np.empty(0, np.int32), "repeat": np.empty(0, bool)})
    if n <= 0:
        return none
    bounds = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(docs)), sizes)
    whole = doc[:n] == doc[length - 1 :]
    rolled = Rolled(h)
    at = np.flatnonzero(whole)
    if not len(at):
        return none
    _, first, back = np.unique(rolled.span(at, at + length), return_index=True, return_inverse=True)
    again = np.zeros(n, bool)
    again[at] = first[back] != np.arange(len(at))
    grams = ngrams(h, seed)
    wide = length - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, wide)[:, ::-1]
    anchor = np.arange(n) + wide - 1 - view.argmin(1)
    s1, k1 = runs(again, doc[:n])
    s2, k2 = runs(whole & ~again, anchor)
    a2 = anchor[s2]
    context = mix(rolled.span(s2, s2 + k2 - 1 + length) + mix((k2 * 64 + a2 - s2).astype(np.uint64)))
    apart = mix(ids[doc[s1]].astype(np.uint64) * np.uint64(3) + mix((s1 - bounds[doc[s1]]).astype(np.uint64)))  # repeats need no meeting: they are spread
    s = np.concatenate([s1, s2])
    d = doc[s]
    return pd.DataFrame({
        "anchor": np.concatenate([apart, grams[a2]]).view(np.int64), "context": np.concatenate([apart, context]).view(np.int64), "doc": ids[d],
        "start": (s - bounds[d]).astype(np.int32), "windows": np.concatenate([k1, k2]).astype(np.int32), "repeat": np.arange(len(s)) < len(s1),
    })


def seeds(docs: DataFrame) -> DataFrame:
    """Occurrences of documents d, t; in groups of about a million words."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[int, list[bytes]]] = []
        total = 0

        def close() -> pd.DataFrame:
            held.sort(key=lambda x: x[0])
            out = occurrences(np.array([i for i, _ in held], np.int64), [w for _, w in held])
            held.clear()
            return out

        for pdf in it:
            for i, t in zip(pdf.d, pdf.t, strict=True):
                w = words(t, lower=False)
                if len(w) >= LENGTH:
                    held.append((i, w))
                    total += len(w)
                if total >= 1_000_000:
                    yield close()
                    total = 0
        if held:
            yield close()

    return docs.mapInPandas(run, OCCURRENCE)


MARK = "doc long, start int, windows int, repeat boolean"


def meet(found: DataFrame) -> DataFrame:
    """Occurrences that repeat an earlier one, and the first of each run where runs of one anchor differ; the rest drops out.

    Rows come in the order of anchor, context, doc, start; one row at most is held from batch to batch.
    """

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, held = None, None  # the last row's anchor and context; the first row of an anchor that has one context so far
        for pdf in it:
            if not len(pdf):
                continue
            a, c = pdf.anchor.to_numpy(), pdf.context.to_numpy()
            same_a, same_c = np.empty(len(a), bool), np.empty(len(a), bool)
            same_a[1:], same_c[1:] = a[1:] == a[:-1], c[1:] == c[:-1]
            same_a[0] = before is not None and before[0] == a[0]
            same_c[0] = before is not None and before[1] == c[0]
            repeat = pdf.repeat.to_numpy() | (same_a & same_c)
            other = same_a & ~same_c  # a further context of its anchor
            opens = np.flatnonzero(~same_a)
            group = np.cumsum(~same_a)  # 0: goes on from the last batch
            differs = np.bincount(group, other, len(opens) + 1) > 0
            keep = repeat | other
            keep[opens] |= differs[1:]
            out = [pdf.loc[keep, ["doc", "start", "windows"]].assign(repeat=repeat[keep])]
            if differs[0] and held is not None:
                out.append(held)
            if differs[0] or len(opens):
                held = None
            if len(opens) and not differs[-1]:
                i = opens[-1]
                held = pdf.iloc[[i]][["doc", "start", "windows"]].assign(repeat=False) if not repeat[i] else None
            before = (a[-1], c[-1])
            yield pd.concat(out)

    return found.repartition("anchor").sortWithinPartitions("anchor", "context", "doc", "start").mapInPandas(run, MARK)


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def finished(doc_id: int, parts: list[bytes], starts: np.ndarray, ends: np.ndarray) -> tuple:
    """The row of a document, from the spans of words that go."""
    cover = np.zeros(len(parts) + 1, np.int32)
    np.add.at(cover, np.minimum(starts, len(parts)), 1)
    np.add.at(cover, np.minimum(ends, len(parts)), -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    kept = b" ".join(w for w, g in zip(parts, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(parts)
    return doc_id, len(parts), int(gone.sum()), hashlib.sha256(kept).hexdigest(), [{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and spans of removed words of each document.

    A word goes if it lies in a window of 20 words whose words also start earlier: in a document of smaller id, or before in the same
    one. Null and empty texts have no words; texts under 20 words keep all. Rows of one id count as copies of one document: what goes
    from one of them goes from the same place of each. Rows without an id are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null")
    marks = meet(seeds(rows)).groupBy("doc").agg(F.collect_list(F.struct("start", "windows", "repeat")).alias("marks"))

    def first_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, t, marks in zip(pdf.d, pdf.t, pdf.marks, strict=True):
                parts = words(t, lower=False)
                marks = marks if marks is not None else []
                gone = np.array([(m["start"], m["start"] + m["windows"] + LENGTH - 1) for m in marks if m["repeat"]], np.int64).reshape(-1, 2)
                open_runs = [(m["start"], m["windows"]) for m in marks if not m["repeat"] and m["start"] + m["windows"] + LENGTH - 1 <= len(parts)]
                if not open_runs:
                    out.append((*finished(i, parts, gone[:, 0], gone[:, 1]), None, None, None, None))
                    continue
                at = np.unique(np.concatenate([np.arange(s, s + k) for s, k in open_runs]))
                keys = Rolled(word_hashes(parts)).span(at, at + LENGTH)
                out.append((i, len(parts), 0, None, None, t, gone.astype("<i4").tobytes(), keys.view(np.int64).tolist(), at.tolist()))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text", "gone", "keys", "at"])

    step = written(rows.join(marks, F.col("d") == F.col("doc"), "left").select("d", "t", "marks").mapInPandas(first_pass, RESULT + ", text string, gone binary, keys array<long>, at array<int>"), "repeats")
    windows = step.filter("text is not null").select("doc_id", F.explode(F.arrays_zip("keys", "at")).alias("w")).select("doc_id", "w.keys", "w.at")
    first = windows.groupBy("keys").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = windows.join(first, "keys").filter(F.struct("doc_id", "at") != F.col("first")).groupBy(F.col("doc_id").alias("doc")).agg(F.collect_set("at").alias("later"))

    def second_pass(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, t, gone, later in zip(pdf.doc_id, pdf.text, pdf.gone, pdf.later, strict=True):
                known = np.frombuffer(gone, "<i4").reshape(-1, 2)
                more = np.array(later if later is not None else [], np.int64)
                out.append(finished(i, words(t, lower=False), np.append(known[:, 0], more), np.append(known[:, 1], more + LENGTH)))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    ready = step.filter("text is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "spans")
    rest = step.filter("text is not null").select("doc_id", "text", "gone").join(later, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "gone", "later")
    return ready.unionByName(rest.mapInPandas(second_pass, RESULT))


def op9_seed_extend(spark, sf_dir: str) -> DataFrame:
    """Words left in every document after repeats of 20 words and more."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP9_SQL = r"""
WITH w AS (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(text, '[^\x20\x09-\x0D]+') END AS ws FROM documents),
win AS (SELECT doc_id, s, array_to_string(list_slice(ws, s, s + 19), ' ') AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20)),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(s, s + 20)) AS p FROM dup)),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
