"""Insights from transcripts by a caller's model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.operators.chunking import chunk_windows
from strandline.operators.replies import INSIGHTS, parse_insights
from strandline.operators.search import complete, embed
from strandline.functions.lineage import settled
from strandline.functions.text import embedding_text
from strandline.operators.similarity import dedup_within


def extract_insights(sources: DataFrame, model: Callable, embedder: Callable, prompt: Callable[[Column], Column] = lambda text: text, size: int = K.WINDOW_SIZE, overlap: int = K.WINDOW_OVERLAP, search: int = K.WINDOW_SEARCH, threshold: float = K.DEDUP_THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Insights (source, window, place, name, description, type, embedding) of sources (source, text), and notes (source, notes).

    The model sees each window; a failed one becomes a note. Where a text had more windows than one, insights that are close to an
    earlier one of the text drop out. Notes are joined in order of windows, each marked with its number. Replies and vectors are stored: each window is
    asked and each insight embedded once, and no task runs all the models.
    """
    asked = settled(complete(chunk_windows(sources, "source", "text", size, overlap, search).withColumn("prompt", prompt(F.col("text"))).drop("text"), model).drop("prompt"))
    found = parse_insights(asked.filter("error is null").select("source", "window", "reply"))
    found = settled(embed(found.withColumn("_t", embedding_text()), embedder, "_t").drop("_t").filter("error is null").drop("error"))
    several = asked.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_s")
    long = found.join(several, F.col("source") == F.col("_s"), "left_semi")
    short = found.join(several, F.col("source") == F.col("_s"), "left_anti")
    insights = dedup_within(long, "source", ["window", "place"], threshold=threshold).unionByName(short)
    note = F.coalesce(F.from_json("reply", INSIGHTS)["extraction_notes"], F.col("error"))
    marked = asked.select("source", "window", F.concat(F.lit("[Chunk "), (F.col("window") + 1).cast("string"), F.lit("] "), note).alias("note")).filter("note is not null")
    notes = marked.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window", "note"))), lambda x: x["note"]), " | ").alias("notes"))
    return insights, notes
