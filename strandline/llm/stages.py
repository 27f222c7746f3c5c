"""Stages of a corpus pipeline: documents in, documents of the same columns out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.decontaminate import leak_finder
from strandline.llm.near_dedup import kept_ids
from strandline.llm.quality import quality_score, train_quality
from strandline.llm.secrets import redacted, train_secrets


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column | None = None, least: float = 0.5) -> DataFrame:
    """Documents whose quality score is at least this. Null and empty texts are scored as one empty line."""
    model = train_quality(docs, labels, F.lit(True) if usable is None else usable)
    return docs.filter(quality_score(model, F.col("text")) >= least)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """One document, that of the smallest id, of each component of near-duplicates; of rows of one id, that of the smallest text. Rows without an id are left out."""
    kept = kept_ids(docs)
    if not docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        first = F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns)))
        docs = docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(first.alias("_x")).select("_x.*")
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Documents that hold no test item. Null and empty texts stay."""
    return docs.filter(F.size(leak_finder(docs, items)) == 0)


def redact_secrets(docs: DataFrame) -> DataFrame:
    """Every document, its secrets replaced by a mark; n_chars, where there is one, follows the text. Others stay as they are."""
    out = docs.withColumn("text", redacted(train_secrets(docs), F.col("text")))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.col("n_chars")).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
