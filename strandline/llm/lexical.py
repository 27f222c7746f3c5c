"""Ranked lexical search over per-term posting lists in geometric blocks.

The index is cut by documents into segments of bounded size, and no posting leaves the task that read its text. In a segment documents are
clustered by the similarity of their weighted term vectors and numbered by cluster, so that each term's posting list falls into blocks of
similar documents. With a block goes the largest impact of its term in it: over all terms, these maxima are the coordinatewise-maximum
vector of a cluster, the summary that its blocks share. A query's product with a summary bounds the score of each document of those blocks; blocks
are left out only if that bound is under the score of the k-th best document known, which the best blocks of all segments give first.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm.common import batches_of, table, written

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_SPACED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SEGMENT_CHARS = 3_000_000
SEGMENT_DOCS = 2048
CLUSTER_DOCS = 32
DIMENSIONS = 128
BLOCK_BYTES, BLOCK_ITEMS = 4 << 20, 4096


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(LOWER_SPACED).split() if text else []


def term_counts(texts: list[str | None]) -> np.ndarray:
    """Terms of each text: where one begins, over many texts at a time."""
    out = []
    for a, b in batches_of([t or "" for t in texts], SEGMENT_CHARS):
        raw = [(t or "").encode("utf-8", "replace") for t in texts[a:b]]
        part = np.frombuffer(b" ".join(raw).translate(LOWER_SPACED), np.uint8) != 32
        begins = np.append(0, np.cumsum(part & ~np.append(False, part[:-1])))
        ends = np.cumsum([len(x) + 1 for x in raw]) - 1
        out.append(np.diff(begins[ends], prepend=0))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def length_factor(n: np.ndarray, docs: int, total: int) -> np.ndarray:
    """m of documents of n terms, in a corpus of so many documents and terms."""
    return 25 + 75 * n.astype(np.int64) * docs // total


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What an occurrence count adds to a score for each unit of the term's weight."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def clustered(term: np.ndarray, doc: np.ndarray, value: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """The cluster of each document, from its postings: nearest centroids of hashed vectors, rare terms weighing more. It moves no score."""
    k = -(-docs // CLUSTER_DOCS)
    if k == 1:
        return np.zeros(docs, np.int64)
    df = np.bincount(term, minlength=terms)
    use = df[term] > 1
    weight = value[use] * np.log(docs / df[term[use]] + 0.1)
    spread = (term[use].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    at, sign = (spread % np.uint64(DIMENSIONS)).astype(np.int64), np.where(spread >> np.uint64(31), 1.0, -1.0)
    x = np.bincount(doc[use] * DIMENSIONS + at, weight * sign, docs * DIMENSIONS).reshape(docs, DIMENSIONS)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    x /= np.where(norm > 0, norm, 1)
    centre = x[np.arange(k) * docs // k]
    for _ in range(3):
        own = (x @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(norm > 0, total / np.where(norm > 0, norm, 1), centre)
    return own


SEGMENT = "docs int, doc_ids binary, m binary, terms binary, df binary, clusters binary, most binary, held binary, at binary, tf binary"


def segment(doc_ids: np.ndarray, texts: list[str | None], docs: int, total: int) -> dict | None:
    """The index of some documents as one row of arrays; documents without terms are left out.

    df: documents of each term; for each block of a term, in order, its cluster, the largest impact and how many postings it holds; for each posting the
    document's place in the segment (by cluster) and its count.
    """
    number: defaultdict[bytes, int] = defaultdict(count().__next__)
    lists = [np.fromiter(map(number.__getitem__, terms_of(t)), np.int64) for t in texts]
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    keep = np.flatnonzero(n)
    if not len(keep):
        return None
    n, doc_ids = n[keep], doc_ids[keep]
    flat = np.concatenate(lists)
    del lists
    names = sorted(number)
    place = np.empty(len(names), np.int64)
    place[[number[w] for w in names]] = np.arange(len(names))
    size = len(keep)
    key, tf = np.unique(place[flat] * size + np.repeat(np.arange(size), n), return_counts=True)
    term, doc = key // size, key % size
    m = length_factor(n, docs, total)
    cluster = clustered(term, doc, impact(tf, m[doc]), size, len(names))
    order = np.lexsort((doc_ids, cluster))
    rank = np.empty(size, np.int64)
    rank[order] = np.arange(size)
    sort = np.argsort(term * size + rank[doc])
    term, doc, tf = term[sort], rank[doc[sort]], tf[sort]
    m, cluster = m[order], cluster[order]
    own = cluster[doc]
    first = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (own[1:] != own[:-1])))
    raw = {
        "doc_ids": doc_ids[order].astype("<i8"), "m": m.astype("<i8"), "df": np.bincount(term, minlength=len(names)).astype("<u4"),
        "clusters": np.column_stack([term[first], own[first]]).astype("<u4").T, "most": np.maximum.reduceat(impact(tf, m[doc]), first).astype("<u4"),
        "held": np.diff(np.append(first, len(term))).astype("<u4"), "at": doc.astype("<u4"), "tf": tf.astype("<u4"),
    }
    return {"docs": size, "terms": b" ".join(names)} | {k: v.tobytes() for k, v in raw.items()}


@dataclass
class Index:
    """segments: a row for each; docs: documents with a term; total: all their terms."""

    segments: DataFrame
    docs: int
    total: int


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_docs: int = SEGMENT_DOCS) -> Index:
    """Indexes all rows and writes the segments into the shared folder.

    Null texts have no terms; documents without terms and rows without an id are in no list and no count. Rows of one id are documents of
    their own. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null")

    def sizes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            n = term_counts(pdf.t.tolist())
            yield pd.DataFrame({"docs": [int((n > 0).sum())], "total": [int(n.sum())]})

    sums = rows.select("t").mapInPandas(sizes, "docs long, total long").agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).head()
    known, total = sums.docs, sums.total

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[np.ndarray] = []
        texts: list[str | None] = []

        def close() -> Iterator[pd.DataFrame]:
            every = np.concatenate(ids)
            for a, b in batches_of([t or "" for t in texts], SEGMENT_CHARS):
                for i in range(a, b, segment_docs):
                    end = min(b, i + segment_docs)
                    row = segment(every[i:end], texts[i:end], known, total)
                    if row:
                        yield pd.DataFrame([row])
            ids.clear()
            texts.clear()

        for pdf in it:
            ids.append(pdf.d.to_numpy(np.int64))
            texts += pdf.t.tolist()
            if len(texts) >= segment_docs or sum(map(len, filter(None, texts))) >= SEGMENT_CHARS:
                yield from close()
        if texts:
            yield from close()

    return Index(written(rows.mapInPandas(run, SEGMENT), "segments"), known, total)


class Opened:
    """A segment, as far as some asked terms need it: their blocks, summaries and postings."""

    def __init__(self, row, asked: list[bytes]):
        names = {w: i for i, w in enumerate(row.terms.split(b" "))}
        of = np.fromiter((names.get(w, -1) for w in asked), np.int64, len(asked))
        term, cluster = np.frombuffer(row.clusters, "<u4").astype(np.int64).reshape(2, -1)
        most, held = np.frombuffer(row.most, "<u4"), np.frombuffer(row.held, "<u4").astype(np.int64)
        self.doc_ids, self.m = np.frombuffer(row.doc_ids, "<i8"), np.frombuffer(row.m, "<i8")
        self.at, self.tf = np.frombuffer(row.at, "<u4"), np.frombuffer(row.tf, "<u4")
        self.held, self.start = held, np.cumsum(held) - held
        back = np.full(len(names) + 1, -1)
        back[of] = np.arange(len(asked))
        back[-1] = -1  # asked terms that the segment lacks
        mine = np.flatnonzero(back[term] >= 0)
        shape = (len(asked), int(cluster.max()) + 1)
        #: by asked term and cluster: the summaries' coordinates, exact in doubles, and the block, or -1
        self.summary = np.zeros(shape)
        self.block = np.full(shape, -1)
        self.summary[back[term[mine]], cluster[mine]] = most[mine]
        self.block[back[term[mine]], cluster[mine]] = mine

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of each cluster: no document of it scores higher."""
        return weights @ self.summary[terms]

    def scores(self, terms: np.ndarray, weights: np.ndarray, clusters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """doc ids and scores, above 0, of the documents in these clusters' blocks of the query's lists. Sums are whole numbers that doubles hold."""
        block = self.block[terms[:, None], clusters]
        row, col = np.nonzero(block >= 0)
        b = block[row, col]
        size = self.held[b]
        upto = np.cumsum(size)
        where = np.repeat(self.start[b] - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)
        doc = self.at[where].astype(np.int64)
        total = np.bincount(doc, np.repeat(weights[row], size) * impact(self.tf[where], self.m[doc]), len(self.m))
        hit = np.flatnonzero(total)
        return self.doc_ids[hit], total[hit].astype(np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest, equal ones by id."""
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


FOUND = "q int, doc_id long, score long"
Query = tuple[np.ndarray, np.ndarray]


def found(segments: DataFrame, asked: list[bytes], queries: list[Query], k: int, least: np.ndarray | None) -> DataFrame:
    """q, doc_id, score: the k best of each task. Without least only the best cluster of each segment is looked at; with it, the k-th best
    score known of each query, every block whose bound reaches both that and the task's own k-th score."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(queries)
        for pdf in it:
            for row in pdf.itertuples():
                part = Opened(row, asked)
                for q, (terms, weights) in enumerate(queries):
                    if not len(terms):
                        continue
                    bound = part.bounds(terms, weights)
                    if least is None:
                        use = bound.argmax()[None]
                        floor = 1
                    else:
                        floor = max(int(least[q]), int(held[q][1][-1]) if len(held[q][1]) == k else 1)
                        use = np.flatnonzero(bound >= floor)
                    if len(use) and bound[use[0]] > 0:
                        ids, scores = part.scores(terms, weights, use)
                        more = scores >= floor
                        if more.any():
                            held[q] = best(np.append(held[q][0], ids[more]), np.append(held[q][1], scores[more]), k)
        sizes = [len(x[0]) for x in held]
        if sum(sizes):
            yield pd.DataFrame({"q": np.repeat(np.arange(len(held), dtype=np.int32), sizes), "doc_id": np.concatenate([x[0] for x in held]), "score": np.concatenate([x[1] for x in held])})

    return segments.mapInPandas(run, FOUND)


@contextmanager
def one_segment_at_a_time(spark: SparkSession) -> Iterator[None]:
    """Rows of segments are megabytes each: what runs meanwhile reads them, and hands them to Python, one by one and not by thousands."""
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {c: spark.conf.get(c) for c in names}
    try:
        for c in names:
            spark.conf.set(c, "1")
        yield
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query, with their rank; each task sends k of its own at most."""
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return rows.withColumn("rank", place).filter(F.col("rank") <= k)


def document_frequencies(segments: DataFrame, asked: list[bytes]) -> np.ndarray:
    """Documents that hold each asked term: sums over the segments' dictionaries."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(asked), np.int64)
        for pdf in it:
            for row in pdf.itertuples():
                names = {w: i for i, w in enumerate(row.terms.split(b" "))}
                of = np.fromiter((names.get(w, -1) for w in asked), np.int64, len(asked))
                total += np.where(of >= 0, np.frombuffer(row.df, "<u4")[of], 0)
        yield pd.DataFrame({"i": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    sums = segments.select("terms", "df").mapInPandas(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(len(asked), np.int64)
    df[sums.i.to_numpy(np.int64)] = sums.n.to_numpy(np.int64)
    return df


def search_block(index: Index, texts: list[str | None], k: int) -> DataFrame:
    """q (place in texts), doc_id, score and rank of the k best documents for each text, written."""
    with one_segment_at_a_time(index.segments.sparkSession):
        return written(block_results(index, texts, k), "ranked")


def block_results(index: Index, texts: list[str | None], k: int) -> DataFrame:
    counted = [np.unique(np.array(terms_of(t), object), return_counts=True) if t else (np.empty(0, object), np.empty(0, np.int64)) for t in texts]
    asked = sorted({w for words, _ in counted for w in words})
    df = document_frequencies(index.segments, asked)
    weight = np.array([math.floor(1000 * math.log((2 * index.docs + 2) / (2 * int(n) + 1))) if n else 0 for n in df], np.int64)
    place = {w: i for i, w in enumerate(asked)}
    queries: list[Query] = []
    for words, repeats in counted:
        at = np.fromiter((place[w] for w in words), np.int64, len(words))
        use = weight[at] > 0
        queries.append((at[use], (weight[at] * repeats)[use].astype(np.float64)))
    first = ranked(found(index.segments, asked, queries, k, None), k).filter(F.col("rank") == k).select("q", "score").collect()
    least = np.ones(len(texts), np.int64)
    for r in first:
        least[r.q] = r.score
    return ranked(found(index.segments, asked, queries, k, least), k)


def search(index: Index, items: DataFrame, k: int = 10, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k documents of highest score above 0 for each row of items, equal scores by doc_id.

    Items are taken in blocks of bounded bytes and rows, each block in passes over all segments. Null and empty items, and an empty
    index, have no results; rows of one item_id are ranked each for itself.
    """
    spark = items.sparkSession
    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    sums = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).head()
    n = max(1, -(-sums.bytes // BLOCK_BYTES), -(-sums.n // BLOCK_ITEMS))
    out = None
    for i in range(n):
        block = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).toPandas()
        names = spark.createDataFrame([(q, None if pd.isna(x) else int(x)) for q, x in enumerate(block.item_id)], "q int, item_id long")
        got = search_block(index, block.text.tolist(), k).join(F.broadcast(names), "q").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out


def op12_geometric_blocks(spark, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
len AS (SELECT doc_id, count(*) AS size FROM d GROUP BY doc_id),
whole AS (SELECT count(*) AS docs, CAST(sum(size) AS BIGINT) AS total FROM len),
m AS (SELECT doc_id, 25 + (75 * size * docs) // total AS m FROM len, whole),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')) AS term FROM benchmark) GROUP BY item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, whole GROUP BY term, docs),
s AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
