"""Benchmark decontamination: rare n-gram seeds lead to test items, Smith-Waterman alignment scores the passages around them.

A seed is a run of SEED words of an item. One that is unlikely to come together by chance, as the product of its words' shares of
the corpus is small, leads to an alignment alone; any others do where two that share no word meet in one passage. The shares are counted
over all documents, as if PRIOR words more had been read that no item has; the same rule holds at every size. How often a passage is
copied doesn't make its seeds common. The window that is aligned around a seed holds every alignment that could score enough.
Items go to the executors in blocks of a checked size, each block against all documents; words are counted once for all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, ngrams, table, word_hashes
from strandline.llm.common import words as split


def words(text: str | None) -> list[bytes]:
    """Words in lower case, of every alphabet."""
    return split(text.lower() if text else text)


SEED = 3
RARE = 1e-6  # chance of a seed at a given place
PRIOR = 1_000_000
BLOCK_WORDS = 1_000_000
MATCH, MISMATCH, GAP = 2, 1, 1
LEAK = 0.5  # of the score of the item aligned with itself
SLOTS = 22


@dataclass
class Block:
    """Items of a block: ids, words, and seeds sorted by hash with the item and place of each, and whether it leads alone."""

    ids: np.ndarray
    items: list[np.ndarray]
    sizes: list[int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list[list[tuple[int, str]]]:
    """Items, by blocks of at most BLOCK_WORDS words (a longer item alone); nulls and empty items are left out."""
    rows = items.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("i is not null and t is not null")
    out: list[list[tuple[int, str]]] = []
    size = BLOCK_WORDS
    for r in rows.orderBy("i", "t").toLocalIterator():
        n = len(words(r.t))
        if not n:
            continue
        if size + n > BLOCK_WORDS:
            out.append([])
            size = 0
        out[-1].append((r.i, r.t))
        size += n
    return out


def word_shares(docs: DataFrame, vocabulary: np.ndarray, text_col: str = "text") -> tuple[dict[int, int], int]:
    """Counts over all documents of the words (sorted hashes) asked for, and of all words."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts = 0, np.zeros(len(vocabulary), np.int64)
        for pdf in it:
            for t in pdf.t:
                h = word_hashes(words(t))
                total += len(h)
                at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                counts += np.bincount(at[vocabulary[at] == h], minlength=len(vocabulary))
        some = np.flatnonzero(counts)
        yield pd.DataFrame({"w": np.append(some, -1), "n": np.append(counts[some], total)})

    got = {r.w: r.n for r in docs.select(F.col(text_col).alias("t")).mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {int(vocabulary[w]): n for w, n in got.items() if w >= 0}, got.get(-1, 0)


def block_of(rows: list[tuple[int, str]], counts: dict[int, int], total: int) -> Block:
    items = [word_hashes(words(t)) for _, t in rows]
    seeds: dict[int, list] = {}
    for k, h in enumerate(items):
        n = min(SEED, len(h))
        share = np.log10([(counts.get(int(w), 0) + 1) / (total + PRIOR) for w in h])
        chance = sum(share[i : len(h) - n + 1 + i] for i in range(n))
        # an item of one seed has nothing else to be found by
        seeds.setdefault(n, []).append((ngrams(h, n), np.full(len(chance), k), np.arange(len(chance)), (chance < np.log10(RARE)) | (len(h) < 2 * SEED)))
    done = {}
    for n, parts in seeds.items():
        key, item, place, alone = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(key, kind="stable")
        done[n] = key[order], item[order], place[order], alone[order]
    return Block(np.array([i for i, _ in rows]), items, [len(h) for h in items], done)


def best_end(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """Score of the best local alignment of words, and where in the text it ends."""
    row = np.zeros(len(text) + 1, np.int64)
    ramp = np.arange(len(text) + 1) * GAP
    best, end = 0, 0
    for w in item:
        step = np.where(text == w, MATCH, -MISMATCH)
        here = np.maximum(row - GAP, 0)
        here[1:] = np.maximum(here[1:], row[:-1] + step)
        row = np.maximum.accumulate(here + ramp) - ramp
        top = int(row.argmax())
        if row[top] > best:
            best, end = int(row[top]), top
    return best, end


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of words: score, and start and end of the text's part in it."""
    best, end = best_end(item, text)
    return best, end - best_end(item[::-1], text[:end][::-1])[1] if best else end, end


def reach(size: int) -> int:
    """Words that the text of an alignment with LEAK of the best score can have more than the item of this size: each costs a gap."""
    return int(MATCH * (1 - LEAK) * size / GAP) + 1


def leaks(block: Block, texts: list[str | None]) -> list[list[dict]]:
    """For each text the items it holds: item, score, start and end in words; the best passage of each item."""
    out: list[list[dict]] = [[] for _ in texts]
    full = [words(t) for t in texts]
    sizes = np.array([len(w) for w in full])
    h = word_hashes([w for d in full for w in d])
    starts = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = []
    for n, (key, item, place, alone) in block.seeds.items():
        slots = np.zeros(1 << SLOTS, bool)
        slots[key >> np.uint64(64 - SLOTS)] = True
        g = ngrams(h, n)
        at = np.flatnonzero(slots[g >> np.uint64(64 - SLOTS)])
        at = at[doc[at] == doc[at + n - 1]]
        lo, hi = np.searchsorted(key, g[at], side="left"), np.searchsorted(key, g[at], side="right")
        k = hi - lo
        j = np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())
        pos = np.repeat(at, k)
        found.append((doc[pos], item[j], pos - place[j], place[j], alone[j]))
    if not found:
        return out
    d, item, begin, place, alone = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(d):
        return out
    order = np.lexsort((begin, item, d))
    d, item, begin, place, alone = d[order], item[order], begin[order], place[order], alone[order]
    # seeds of one item whose passages would overlap are one passage
    length = np.array([n + reach(n) for n in block.sizes])[item]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (begin[1:] > begin[:-1] + length[:-1])
    first = np.flatnonzero(new)
    apart = np.maximum.reduceat(place, first) - np.minimum.reduceat(place, first) >= SEED
    led = np.logical_or.reduceat(alone, first) | apart
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(first[led].tolist(), np.append(first[1:], len(d))[led].tolist(), strict=True):
        i, k = int(d[a]), int(item[a])
        n, own = block.sizes[k], block.items[k]
        lo = max(int(begin[a]) - reach(n), int(starts[i]))
        window = h[lo : min(int(begin[b - 1]) + n + reach(n), int(starts[i] + sizes[i]))]
        if np.isin(window, own).sum() < LEAK * n:
            continue  # too few words of the item for the score
        score, s, e = align(own, window)
        if score > best.get((i, k), (0,))[0]:
            best[i, k] = score, lo - int(starts[i]) + s, lo - int(starts[i]) + e
    for (i, k), (score, s, e) in sorted(best.items()):
        if (share := score / (MATCH * block.sizes[k])) >= LEAK:
            out[i].append({"item_id": int(block.ids[k]), "score": share, "start": s, "end": e})
    return out


FOUND = "array<struct<item_id:long,score:double,start:int,end:int>>"


def finder(block: Block):
    """The vectorized function that finds the items of a block."""
    held = [block]

    @F.pandas_udf(FOUND)
    def find(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            texts = s.tolist()
            out: list = []
            for a, b in batches_of([t or "" for t in texts], 4_000_000):
                out += leaks(held[0], texts[a:b])
            yield pd.Series(out, dtype=object)

    return find


def leak_finder(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> Column:
    """A column for docs: the test items that a text holds (item_id, score, start, end), an empty array for none.

    An item is held if the best local alignment has LEAK of the score of an exact copy. Null and empty texts hold nothing; without items
    no text does. Of several items of one id each counts.
    """
    blocks = item_blocks(items, item_id_col, item_text_col)
    if not blocks:
        return F.array().cast(FOUND)
    vocabulary = np.unique(np.concatenate([word_hashes(words(t)) for block in blocks for _, t in block]))
    counts, total = word_shares(docs, vocabulary, text_col)
    columns = [finder(block_of(block, counts, total))(F.col(text_col)) for block in blocks]
    return F.concat(*columns)


def op10_seed_align(spark, sf_dir: str) -> DataFrame:
    """The test items in every document, the best of them, and whether there is any."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = docs.select("doc_id", leak_finder(docs, table(spark, sf_dir, "benchmark")).alias("leaks"))
    best = F.array_max(F.transform("leaks", lambda x: F.struct(x.score.alias("score"), (-x.item_id).alias("item"))))
    return found.select("doc_id", F.size("leaks").cast("long").alias("n_items"), F.array_sort(F.transform("leaks", lambda x: x.item_id)).alias("items"), (-best.item).alias("best_item"), F.coalesce(best.score, F.lit(0.0)).alias("best_score"), (F.size("leaks") > 0).alias("contaminated"))
