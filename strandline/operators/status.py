"""States of episodes and documents, derived from what exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions import text as T


def marked(df: DataFrame, key: Column, keys: DataFrame, flag: str) -> DataFrame:
    """Adds a flag: the key is among the (distinct) values of keys' one column."""
    side = keys.toDF("_k").filter("_k is not null").distinct()
    return df.join(side, key == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def evidence_of_work(df: DataFrame, source: Column, chunks: DataFrame, units: DataFrame, dimensions: DataFrame, owner: str) -> DataFrame:
    """Flags _chunks, _insights, _dimensions of each source."""
    assessed = units.join(dimensions.select(F.col("unit_insight_id").alias("id")).distinct(), "id", "left_semi")
    out = marked(df, source, chunks.select("source"), "_chunks")
    out = marked(out, F.col("id"), units.select(owner), "_insights")
    return marked(out, F.col("id"), assessed.select(owner), "_dimensions")


def by_files() -> Column:
    return (F.when(T.is_set("gcs_transcript_uri"), F.when(F.col("_chunks"), "ready").otherwise("indexing"))
            .when(T.is_set("gcs_audio_uri"), "transcribing").otherwise("needs_processing"))


def episode_status(episodes: DataFrame, chunks: DataFrame, units: DataFrame, dimensions: DataFrame) -> DataFrame:
    """derived_status: a trusted stored state, else analyzed if an insight has a dimension, else by transcript, chunks and audio."""
    out = evidence_of_work(episodes, T.source_key(), chunks, units, dimensions, "episode_id")
    state = F.when(F.col("status").isin(K.TRUSTED_STATES), F.col("status")).when(F.col("_dimensions"), "analyzed").otherwise(by_files())
    return out.withColumn("derived_status", state).drop("_chunks", "_insights", "_dimensions")


def document_status(documents: DataFrame, chunks: DataFrame, units: DataFrame, dimensions: DataFrame, failed: bool = False) -> DataFrame:
    """derived_status after a run: analyzed with dimensions, ready with insights only, else the stored one; after a failure by chunks."""
    out = evidence_of_work(documents, F.col("title"), chunks, units, dimensions, "document_id")
    state = F.when(F.col("_chunks"), "ready").otherwise("indexing") if failed else F.when(F.col("_dimensions"), "analyzed").when(F.col("_insights"), "ready").otherwise(F.col("status"))
    return out.withColumn("derived_status", state).drop("_chunks", "_insights", "_dimensions")


def document_processing_status(documents: DataFrame, chunks: DataFrame, units: DataFrame, dimensions: DataFrame) -> DataFrame:
    out = evidence_of_work(documents, F.col("title"), chunks, units, dimensions, "document_id")
    state = F.when(F.col("_insights"), "analyzed").when(T.is_set("gcs_transcript_uri"), F.when(F.col("_chunks"), "ready").otherwise("processing")).otherwise("uploading")
    return out.withColumn("derived_status", state).drop("_chunks", "_insights", "_dimensions")


def mark_analyzing(rows: DataFrame, state: str = "derived_status") -> DataFrame:
    return rows.withColumn(state, F.when(F.col(state) == "ready", "analyzing").otherwise(F.col(state)))


def live_episode_status(episodes: DataFrame, tasks: DataFrame, chunks: DataFrame, units: DataFrame, dimensions: DataFrame, analysis_running: bool) -> DataFrame:
    """derived_status: stage of a running task (entity_id, status, stage), else analyzed, else analyzing for what is ready while an analysis runs, else by files."""
    stages = {"download": "downloading", "transcribe": "transcribing", "index": "indexing"}
    running = tasks.filter("status = 'running'").groupBy(F.col("entity_id").alias("_e")).agg(F.min("stage").alias("_stage"))
    out = evidence_of_work(episodes, T.source_key(), chunks, units, dimensions, "episode_id").join(running, F.col("id") == F.col("_e"), "left")
    stage = F.coalesce(*(F.when(F.col("_stage") == k, v) for k, v in stages.items()))
    ready = T.is_set("gcs_transcript_uri") & F.col("_chunks") & F.lit(analysis_running)
    state = F.coalesce(stage, F.when(F.col("_dimensions"), "analyzed").when(ready, "analyzing").otherwise(by_files()))
    return out.withColumn("derived_status", state).drop("_chunks", "_insights", "_dimensions", "_e", "_stage")
