"""Vector search over chunks, and the context that is made of what it finds."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.pieces import pieces
from strandline.functions.text import Name, col, embedding_text, evidence_metadata, jaccard, word_set
from strandline.functions.vectors import cosine
from strandline.operators.similarity import SMALL_SIDE_BYTES, stacked

Embed = Callable[[list[str]], np.ndarray]
QUERY_BLOCK = 512


def embed(df: DataFrame, loader: Callable[[], Embed], text: str = "text", out: str = "embedding", batch: int = 64) -> DataFrame:
    """Adds unit vectors of a text column and an error column. loader makes the model, once in each task; blank texts are an error of their row."""

    @F.pandas_udf("struct<vector:array<float>,error:string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        for s in (part for whole in it for part in pieces(whole, step=batch)):
            texts = s.tolist()
            vectors: list = [None] * len(texts)
            errors: list = [None if t and t.strip() else "blank text" for t in texts]
            good = [i for i, e in enumerate(errors) if e is None]
            for k in range(0, len(good), batch):
                part = good[k : k + batch]
                try:
                    for i, v in zip(part, stacked(pd.Series(list(model([texts[i] for i in part])))), strict=True):
                        vectors[i] = v.astype(np.float32)
                except Exception as e:  # a failed batch doesn't stop the others
                    for i in part:
                        errors[i] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"vector": vectors, "error": errors})

    got = df.withColumn("_e", run(F.col(text)))
    return got.select(*df.columns, F.col("_e.vector").alias(out), F.col("_e.error").alias("error"))


def hashing_embedder(dim: int = 64) -> Callable[[], Embed]:
    """A loader of an embedder for tests: signed counts of hashed words."""

    def load() -> Embed:
        def run(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim))
            for i, t in enumerate(texts):
                for w in t.lower().split():
                    h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                    out[i, h % dim] += 1 if h >> 63 else -1
            return out

        return run

    return load


def query_text(name: Name = "name", description: Name = "description", dimension: Name | None = None) -> Column:
    """Text to search with; with a dimension its hint follows, and the text is to be embedded anew."""
    base = embedding_text(name, description)
    if dimension is None:
        return base
    hints = F.create_map(*(F.lit(x) for kv in K.DIMENSION_HINTS.items() for x in kv))
    hint = hints[col(dimension)]
    return F.when(hint.isNotNull(), F.concat(base, F.lit(" "), hint)).otherwise(base)


def search_one(chunks: DataFrame, vector: list[float], k: int = K.TOP_K, source: str | None = None) -> DataFrame:
    """The k chunks nearest to one vector, of one source if it is given; null and zero vectors have no score."""
    if source is not None:
        chunks = chunks.filter(F.col("source") == source)
    scored = chunks.withColumn("score", cosine("embedding", F.array(*(F.lit(float(x)) for x in vector)))).filter("score is not null")
    return scored.orderBy(F.desc("score"), F.desc("kind"), "chunk_id").limit(k)


def search_many(queries: DataFrame, chunks: DataFrame, k: int = K.TOP_K, by_source: bool = False) -> DataFrame:
    """query_id, rank, chunk_id, kind, source, score of the k nearest chunks of each query (query_id, embedding; source if by_source).

    Queries go to all chunks in blocks of a checked size; each task keeps its best k, and only those are shuffled. Ties: podcasts
    first (kind descending), then chunk_id.
    """
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding", *(["source"] if by_source else [])).filter("embedding is not null").orderBy("query_id")
    parts, held, used = [], [], 0
    for r in rows.toLocalIterator():
        held.append(r)
        used += 8 * len(r.embedding) + 64
        if used >= SMALL_SIDE_BYTES:
            parts.append(held_top(held, chunks, k, by_source))
            held, used = [], 0
    if held or not parts:
        parts.append(held_top(held, chunks, k, by_source))
    return top_of(parts, k)


def top_of(parts: list[DataFrame], k: int) -> DataFrame:
    """The k best of each query, with their rank, from what tasks found."""
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kind"), "chunk_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


FOUND = "query_id long, chunk_id string, kind string, source string, score double"


def held_top(queries: list, chunks: DataFrame, k: int, by_source: bool) -> DataFrame:
    """partial_top of rows (query_id, embedding; source if by_source)."""
    ids = np.array([r.query_id for r in queries], np.int64)
    matrix = stacked(pd.Series([r.embedding for r in queries])) if queries else np.zeros((0, 1))
    asked: dict[str | None, np.ndarray] = {None: np.arange(len(ids))}
    if by_source:
        asked = {source: at.to_numpy() for source, at in pd.Series(np.arange(len(ids))).groupby(pd.Series([r.source for r in queries], dtype=object))}
    return partial_top(ids, matrix, asked, chunks, k, by_source)


def partial_top(ids: np.ndarray, matrix: np.ndarray, asked: dict[str | None, np.ndarray], chunks: DataFrame, k: int, by_source: bool) -> DataFrame:
    """The best k of each task for each of these queries, in one pass over the chunks; scores are made for QUERY_BLOCK queries at a time.

    asked: the places of the queries that a source is asked by; without by_source, None stands for all.
    """

    def top(pdf: pd.DataFrame, m: np.ndarray, own: np.ndarray) -> pd.DataFrame:
        s = matrix[own] @ m.T
        s[:, ~m.any(1)] = -np.inf
        n = min(k, s.shape[1])
        # all that tie with the n-th stay, so that the order of ties is decided by the keys
        least = np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n]
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
        got = pd.DataFrame({"query_id": ids[own[i]], "chunk_id": pdf.chunk_id.to_numpy()[j], "kind": pdf.kind.to_numpy()[j], "source": pdf.source.to_numpy()[j], "score": s[i, j]})
        return trimmed([got], k)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[pd.DataFrame] = []
        for pdf in it:
            if not len(pdf) or not len(ids):
                continue
            pdf = pdf.sort_values(["kind", "chunk_id"], ascending=[False, True], kind="stable", ignore_index=True)
            m = stacked(pdf.embedding)
            for source, here in pdf.groupby("source", sort=False).indices.items() if by_source else [(None, np.arange(len(pdf)))]:
                every = asked.get(source, ())
                for i in range(0, len(every), QUERY_BLOCK):
                    best.append(top(pdf.iloc[here], m[here], every[i : i + QUERY_BLOCK]))
            if len(best) > 8:
                best = [trimmed(best, k)]
        if best:
            yield trimmed(best, k)

    return chunks.select("chunk_id", "kind", "source", "embedding").filter("embedding is not null").mapInPandas(run, FOUND)


def trimmed(parts: list[pd.DataFrame], k: int) -> pd.DataFrame:
    every = pd.concat(parts).sort_values(["query_id", "score", "kind", "chunk_id"], ascending=[True, False, False, True], kind="stable")
    return every.groupby("query_id").head(k)


def near_enough(found: DataFrame, least: float = K.MIN_SIMILARITY) -> DataFrame:
    """After the top k."""
    return found.filter(F.col("score") >= least)


def ranked(found: DataFrame, *fields: str) -> DataFrame:
    """query_id, chunks: the found rows of each query in order of rank."""
    return found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("chunks"))


def drop_overlaps(chunks: Name, most: float = K.CHUNK_OVERLAP_LIMIT) -> Column:
    """Of an array of structs with a text, in order, those whose words overlap less than this with every one kept before. Word sets are made once for each."""
    c = col(chunks)
    marked = F.transform(c, lambda x: F.struct(x.alias("c"), word_set(x["text"]).alias("words")))
    kept = F.aggregate(marked, F.slice(marked, 1, 0), lambda acc, x: F.when(F.exists(acc, lambda k: jaccard(k["words"], x["words"]) >= most), acc).otherwise(F.array_append(acc, x)))
    return F.when(F.size(c) > 1, F.transform(kept, lambda k: k["c"])).otherwise(c)


def header(x: Column) -> Column:
    """[source | Page p | start–end or section] of a chunk struct."""
    who = F.when(F.coalesce(x["speaker"], F.lit("")) != "", x["speaker"]).when(x["page"].isNotNull(), F.concat(F.lit("Page "), x["page"].cast("string")))
    where = F.when(x["start"].isNotNull() & x["end"].isNotNull(), F.format_string("%.1f–%.1f", x["start"], x["end"])).when(x["section"] != "", x["section"])
    return F.concat(F.lit("["), F.concat_ws(" | ", x["source"], who, where), F.lit("]"))


def format_context(chunks: Name, most: int = K.MAX_CONTEXT) -> Column:
    """struct(text, sources, total_chars) of an array of chunk structs (source, text, speaker, page, start, end, section)."""
    c = col(chunks)
    said = lambda x: F.regexp_replace(F.coalesce(x["text"], F.lit("")), r"(?U)^\s+|\s+$", "")
    parts = F.transform(F.filter(c, lambda x: said(x) != ""), lambda x: F.concat(header(x), F.lit("\n"), said(x)))
    text = F.left(F.array_join(parts, "\n\n"), F.lit(most))
    return F.struct(text.alias("text"), F.array_sort(F.array_distinct(F.transform(c, lambda x: x["source"]))).alias("sources"), F.length(text).alias("total_chars"))


def evidence_rows(assessed: DataFrame, chunks: str = "chunks") -> DataFrame:
    """One row of evidence for each retrieved chunk of (dimension_id, chunks): text, score, source and metadata."""
    rows = assessed.select("dimension_id", F.posexplode(chunks).alias("place", "c"))
    c = F.col("c")
    return rows.select("dimension_id", "place", c["text"].alias("chunk_text"), c["score"].alias("similarity_score"), c["source"].alias("source_ref"), evidence_metadata(c["speaker"], c["page"], c["start"], c["end"], c["section"]).alias("chunk_metadata"))


def answers(model: Callable[[list[str]], Iterable[str]], prompts: list[str]) -> list[tuple[str | None, str | None]]:
    """Reply and error of each prompt; a batch that fails is halved, so that a bad prompt costs its own row alone."""
    try:
        got = list(model(prompts))
        if len(got) != len(prompts):
            raise ValueError(f"{len(got)} replies to {len(prompts)} prompts")
        return [(r, None) for r in got]
    except Exception as e:  # kept with its row
        if len(prompts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
        half = len(prompts) // 2
        return answers(model, prompts[:half]) + answers(model, prompts[half:])


def complete(df: DataFrame, loader: Callable[[], Callable[[list[str]], Iterable[str]]], prompt: str = "prompt", out: str = "reply", batch: int = 16) -> DataFrame:
    """Adds replies of a caller's model, asked in batches, and an error column; null prompts have neither."""

    @F.pandas_udf("struct<reply:string,error:string>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = loader()
        for s in (part for whole in it for part in pieces(whole, step=batch)):
            rows: list[tuple[str | None, str | None]] = [(None, None)] * len(s)
            there = [i for i, p in enumerate(s) if p is not None]
            for k in range(0, len(there), batch):
                part = there[k : k + batch]
                for i, r in zip(part, answers(model, [s.iloc[i] for i in part]), strict=True):
                    rows[i] = r
            yield pd.DataFrame(rows, columns=["reply", "error"])

    got = df.withColumn("_r", run(F.col(prompt)))
    return got.select(*df.columns, F.col("_r.reply").alias(out), F.col("_r.error").alias("error"))
