"""A stored index of chunks in coarse lists, searched exactly: lists whose bound can't reach the k-th best score known are not read."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import settled
from strandline.operators.search import partial_top, top_of
from strandline.operators.similarity import SMALL_SIDE_BYTES, pivots_of, stacked, usable
from strandline.sources.objects import write_table


@dataclass
class Lists:
    """Table at path, a folder for each list; centre: unit vector of each; reach: greatest angle of its chunks to the centre; rows: their number."""

    path: str
    centre: np.ndarray
    reach: np.ndarray
    rows: np.ndarray

    def chunks(self, spark: SparkSession, lists: np.ndarray) -> DataFrame:
        return spark.read.parquet(self.path).filter(F.col("list").isin([int(i) for i in lists]))


def listed_by(chunks: DataFrame, centre: np.ndarray) -> DataFrame:
    """Adds list, the nearest centre (-1 for null and zero vectors, which have no score), and angle, that to it."""

    @F.pandas_udf("struct<list:int,angle:double>")
    def nearest(v: pd.Series) -> pd.DataFrame:
        m = stacked(v)
        s = m @ centre.T if m.shape[1] == centre.shape[1] else np.zeros((len(m), len(centre)))
        own = s.argmax(1)
        return pd.DataFrame({"list": np.where(m.any(1), own, -1).astype(np.int32), "angle": np.arccos(np.clip(s[np.arange(len(m)), own], -1, 1))})

    got = chunks.withColumn("_l", nearest("embedding"))
    return got.select(*chunks.columns, F.col("_l.list").alias("list"), F.col("_l.angle").alias("angle"))


def build_lists(chunks: DataFrame, path: str) -> Lists:
    """Writes chunks (chunk_id, kind, source, embedding, ...) into lists around pivots of fixed number; only a list's reach and size go through the driver."""
    centre = pivots_of(usable(chunks.withColumn("_id", F.xxhash64("chunk_id")), "_id", "embedding"))
    if not len(centre):
        raise ValueError("no chunk has a vector")
    write_table(listed_by(chunks, centre), path, partition_by=("list",))
    return measured(chunks.sparkSession, path, centre)


def measured(spark: SparkSession, path: str, centre: np.ndarray) -> Lists:
    sizes = spark.read.parquet(path).filter("list >= 0").groupBy("list").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).toPandas()
    reach, rows = np.zeros(len(centre)), np.zeros(len(centre), np.int64)
    reach[sizes["list"].to_numpy(np.int64)], rows[sizes["list"].to_numpy(np.int64)] = sizes["angle"], sizes["n"]
    return Lists(path, centre, reach, rows)


def add_chunks(index: Lists, chunks: DataFrame) -> Lists:
    """Appends chunks of new sources to their lists; the reach grows with them. The centres stay."""
    write_table(listed_by(chunks, index.centre), index.path, "append", ("list",))
    return measured(chunks.sparkSession, index.path, index.centre)


def search_lists(queries: DataFrame, index: Lists, k: int = K.TOP_K) -> DataFrame:
    """query_id, rank, chunk_id, kind, source, score of the k nearest chunks of each query (query_id, embedding): the rows of search_many.

    Each query asks the list that promises most and is large enough for k; then the lists that may hold a chunk at least as near as the k-th
    found there. A list's chunks are no nearer than the query's angle to its centre less its reach. Queries are a table of the driver's size.
    """
    spark = queries.sparkSession
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").filter("embedding is not null").toPandas()
    m = stacked(asked.embedding) if len(asked) else np.zeros((0, index.centre.shape[1]))
    least = np.maximum(np.arccos(np.clip(m @ index.centre.T, -1, 1)) - index.reach - 1e-6, 0)
    bound = np.where(index.rows > 0, np.cos(least), -np.inf)
    first = np.where(index.rows >= k, bound, -np.inf).argmax(1) if len(asked) else np.empty(0, int)

    most = max(1, SMALL_SIDE_BYTES // (8 * max(m.shape[1], 1) + 64))

    def found(i: np.ndarray, lists: np.ndarray) -> DataFrame:
        chunks = index.chunks(spark, np.unique(lists)).withColumn("_own", F.col("source")).withColumn("source", F.col("list").cast("string"))
        parts = []
        for start in range(0, max(len(asked), 1), most):  # queries go to the tasks once, whatever the number of lists they ask
            end = start + most
            here = (i >= start) & (i < end)
            ids, of, places = asked.query_id.to_numpy(np.int64)[start:end], lists[here], i[here] - start
            parts.append(partial_top(ids, m[start:end], {str(x): places[of == x] for x in np.unique(of)}, chunks, k, True))
        best = settled(top_of(parts, k).select("query_id", "chunk_id", "score"))
        return best.join(chunks.select("chunk_id", "kind", F.col("_own").alias("source")), "chunk_id")

    near = settled(found(np.arange(len(asked)), first))
    scores = near.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).filter(F.col("n") >= k).toPandas().set_index("query_id").s
    floor = asked.query_id.map(scores).fillna(-np.inf).to_numpy(np.float64)
    more = (bound >= floor[:, None] - 1e-9) & np.isfinite(bound)
    more[np.arange(len(asked)), first] = False
    i, j = np.nonzero(more)
    every = near.unionByName(found(i, j)) if len(i) else near
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("kind"), "chunk_id"))
    return every.withColumn("rank", rank).filter(F.col("rank") <= k)
