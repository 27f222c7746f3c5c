"""Counts and other aggregates over the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators.catalog import ready_sources


def counted(df: DataFrame, **conditions) -> DataFrame:
    """One row with the number of rows that each condition holds for; None counts all."""
    return df.agg(*((F.count("*") if c is None else F.coalesce(F.count_if(c), F.lit(0))).alias(k) for k, c in conditions.items()))


def pipeline_statistics(episodes: DataFrame, documents: DataFrame, podcast_chunks: DataFrame, document_chunks: DataFrame, units: DataFrame, macros: DataFrame, clusters: DataFrame, dimensions: DataFrame) -> DataFrame:
    """One row of counts of all stages."""
    ready = counted(ready_sources(episodes, documents, podcast_chunks, document_chunks, units), ready_podcasts=F.col("kind") == "podcast", ready_documents=F.col("kind") == "document")
    m, c = F.col("macro_insight_id").isNotNull(), F.col("cluster_id").isNotNull()
    parts = [
        counted(episodes, total_podcasts=None), counted(documents, total_documents=None),
        units.agg(F.countDistinct("episode_id").alias("analyzed_podcasts"), F.countDistinct("document_id").alias("analyzed_documents")),
        counted(units, unit_insights=None, trends=F.col("type") == "trend", stakes=F.col("type") == "health_stake", with_macro=m, orphans_with_cluster=~m & c, orphans_without_cluster=~m & ~c),
        counted(macros, macros=None, macros_with_cluster=c, macros_without_cluster=~c), counted(clusters, clusters=None), counted(dimensions, dimensions=None),
    ]
    for p in parts:  # each has one row
        ready = ready.crossJoin(F.broadcast(p))
    return ready


def cluster_statistics(clusters: DataFrame, macros: DataFrame) -> DataFrame:
    """Number of macros of each cluster, 0 included."""
    members = macros.groupBy(F.col("cluster_id").alias("c")).agg(F.count("*").alias("n"))
    return clusters.join(members, F.col("id") == F.col("c"), "left").select("name", F.coalesce("n", F.lit(0)).alias("macro_count"))


def documents_by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source_type").agg(F.count("*").alias("n"))


def dimension_stats(units: DataFrame, dimensions: DataFrame) -> DataFrame:
    """A row for each dimension type with its count, and totals of insights: all, with dimensions, pending."""
    done = units.join(dimensions.select(F.col("unit_insight_id").alias("id")).distinct(), "id", "left_semi")
    totals = counted(units, total_insights=None).crossJoin(counted(done, with_dimensions=None)).withColumn("pending", F.col("total_insights") - F.col("with_dimensions"))
    return dimensions.groupBy("dimension_type").agg(F.count("*").alias("n")).crossJoin(F.broadcast(totals))


def index_stats(podcast_chunks: DataFrame, document_chunks: DataFrame, episodes: DataFrame) -> DataFrame:
    one = counted(podcast_chunks, podcast_chunks=None).crossJoin(counted(document_chunks, document_chunks=None)).withColumn("total_chunks", F.col("podcast_chunks") + F.col("document_chunks"))
    return one.crossJoin(counted(episodes, with_transcript=F.col("gcs_transcript_uri").isNotNull(), without_transcript=F.col("gcs_transcript_uri").isNull()))


def macro_size_stats(units: DataFrame) -> DataFrame:
    """Average and largest number of members; 0 without macros."""
    sizes = units.filter("macro_insight_id is not null").groupBy("macro_insight_id").agg(F.count("*").alias("n"))
    return sizes.agg(F.coalesce(F.avg("n"), F.lit(0.0)).alias("average_size"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_size"))


def clusters_used(*assignments: DataFrame) -> DataFrame:
    """Assignments (cluster_name, is_other) of several runs summed: a row for each cluster with totals of all."""
    every = assignments[0].select("cluster_name", "is_other")
    for a in assignments[1:]:
        every = every.unionByName(a.select("cluster_name", "is_other"))
    per = every.groupBy("cluster_name").agg(F.count("*").alias("assigned"))
    return per.crossJoin(F.broadcast(counted(every, processed=None, to_other=F.col("is_other"))))


def analyzed_counts(episodes: DataFrame, units: DataFrame, dimensions: DataFrame, owner: str = "episode_id") -> DataFrame:
    """Insights and dimensions of each source; analyzed if there is a dimension (episodes) or an insight (documents)."""
    each = dimensions.groupBy(F.col("unit_insight_id").alias("u")).agg(F.count("*").alias("k"))
    per = units.join(each, F.col("id") == F.col("u"), "left").groupBy(F.col(owner).alias("o")).agg(F.count("*").alias("i"), F.sum(F.coalesce("k", F.lit(0))).alias("d"))
    out = episodes.select("id").join(per, F.col("id") == F.col("o"), "left")
    i, d = F.coalesce("i", F.lit(0)), F.coalesce("d", F.lit(0))
    return out.select("id", i.alias("insight_count"), d.alias("dimensions_count"), ((d if owner == "episode_id" else i) > 0).alias("analyzed"))


def cluster_totals(clusters: DataFrame, macros: DataFrame, units: DataFrame) -> DataFrame:
    """Units of each cluster: those of its macros, and those that have the cluster and no macro."""
    by_macro = units.filter("macro_insight_id is not null").join(macros.select(F.col("id").alias("macro_insight_id"), F.col("cluster_id").alias("c")), "macro_insight_id").select("c")
    alone = units.filter("macro_insight_id is null").select(F.col("cluster_id").alias("c"))
    per = by_macro.unionByName(alone).groupBy("c").agg(F.count("*").alias("n"))
    return clusters.join(per, F.col("id") == F.col("c"), "left").select("id", "name", F.coalesce("n", F.lit(0)).alias("unit_count"))


def ingest_summary(batch: DataFrame, status: str = "status", chunks: str = "chunks", seconds: str = "seconds") -> DataFrame:
    s = F.col(status)
    return batch.agg(F.count("*").alias("total"), F.count_if(s.isin("completed", "ready", "indexed", "success")).alias("succeeded"), F.count_if(s == "failed").alias("failed"), F.count_if(s == "skipped").alias("skipped"), F.coalesce(F.sum(chunks), F.lit(0)).alias("chunks"), F.coalesce(F.sum(seconds), F.lit(0)).alias("seconds"))


def segment_count(transcripts: DataFrame, segments: str = "segments") -> DataFrame:
    return transcripts.withColumn("segment_count", F.when(F.col(segments).isNull(), 0).otherwise(F.size(segments)))


def chunk_averages(chunks: DataFrame, text: str = "text") -> DataFrame:
    """Chunks of each source and their average length, rounded down."""
    return chunks.groupBy("source").agg(F.count("*").alias("chunks"), F.floor(F.sum(F.length(T.col(text))) / F.count("*")).alias("average_chars"))
