"""Models at work on groups and pairs: labels and descriptions of macros, and the dimensions of insights from retrieved context."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import settled
from strandline.functions.text import parse_label
from strandline.operators.catalog import dimensions_to_assess
from strandline.operators.replies import parse_dimensions
from strandline.operators.search import Embed, complete, drop_overlaps, embed, format_context, near_enough, query_text, ranked, search_many

Model = Callable[[], Callable[[list[str]], Iterable[str]]]
SHOWN = 50  # members of a group that a prompt lists, the first by id


def first_members(grouped: DataFrame, most: int = SHOWN) -> DataFrame:
    """leader, members: so many of each group at most, in id order, and size, how many there are. No group is gathered whole."""
    place = F.row_number().over(Window.partitionBy("leader").orderBy("id"))
    first = grouped.withColumn("_place", place).filter(F.col("_place") <= most)
    listed = first.groupBy("leader").agg(F.array_sort(F.collect_list(F.struct("_place", "name", "description"))).alias("members"))
    return listed.join(grouped.groupBy("leader").agg(F.count("*").alias("size")), "leader")


def label_macros(grouped: DataFrame, label: Model, describe: Model | None = None, most: int = SHOWN, described_by: int = 5, batch: int = 16) -> DataFrame:
    """leader, name, description, label_error, description_error of groups (id, leader, name, description).

    The label is parsed from the model's reply to the members' names and descriptions; where the model fails or its reply holds none, it is the first
    member's name. The description is the reply to the label and the first few names; where that fails there is none.
    """
    groups = first_members(grouped, most)
    item = lambda x: F.concat(F.lit("- "), F.coalesce(x["name"], F.lit("")), F.lit(": "), F.coalesce(x["description"], F.lit("")))
    asked = groups.withColumn("prompt", F.concat(F.lit("Give one label of 5 to 8 words for what these insights share, as JSON with the key label.\n"), F.array_join(F.transform("members", item), "\n")))
    named = complete(asked, label, batch=batch).withColumnRenamed("error", "label_error")
    named = settled(named.withColumn("name", F.coalesce(parse_label("reply"), F.get("members", F.lit(0))["name"])).drop("prompt", "reply"))
    if describe is None:
        return named.select("leader", "name", F.lit(None).cast("string").alias("description"), "label_error", F.lit(None).cast("string").alias("description_error"))
    few = F.array_join(F.transform(F.slice("members", 1, described_by), lambda x: F.concat(F.lit("- "), F.coalesce(x["name"], F.lit("")))), "\n")
    asked = named.withColumn("prompt", F.concat(F.lit("Describe in one or two sentences, without formatting, what this macro insight stands for.\nLabel: "), "name", F.lit("\n"), few))
    said = complete(asked, describe, batch=batch)
    return said.select("leader", "name", F.trim("reply").alias("description"), "label_error", F.col("error").alias("description_error"))


def assessment_prompt() -> Column:
    """Of name, description, dimension_type and context."""
    values = F.create_map(*(x for d, v in {**K.TREND_DIMENSIONS, **K.STAKE_DIMENSIONS}.items() for x in (F.lit(d), F.lit(", ".join(v)))))
    return F.concat_ws("\n", F.concat(F.lit("Dimension: "), "dimension_type"), F.concat(F.lit("Values: "), values[F.col("dimension_type")]), F.concat(F.lit("Insight: "), F.coalesce("name", F.lit(""))), F.coalesce("description", F.lit("")), F.lit("Answer as JSON with dimension, value, confidence and evidence, from this context alone:"), F.col("context"))


def assess_dimensions(
    units: DataFrame, dimensions: DataFrame, chunks: DataFrame, embedder: Callable[[], Embed], model: Model, k: int = K.TOP_K, least: float = K.MIN_SIMILARITY, by_source: bool = False,
    skip_existing: bool = True, disabled: Sequence[str] = (), batch: int = 16,
) -> DataFrame:
    """insight_id, dimension_type, value, confidence, evidence, chunks, error of each dimension that an insight still lacks.

    units: id, name, description, type, embedding (and source if by_source); chunks: chunk_id, kind, source, embedding, text, and page, start, end, section, speaker
    where there are. Where a dimension has a hint, its query is embedded anew with it; else the stored vector is asked. Of the nearest chunks those
    that are near enough and not said before make the context. Without context the value is Unknown and no model is asked; a prompt
    that fails costs its own row.
    """
    order = [*K.TREND_DIMENSIONS, *K.STAKE_DIMENSIONS]
    number = F.coalesce(*(F.when(F.col("dimension_type") == d, F.lit(i)) for i, d in enumerate(order)))
    todo = dimensions_to_assess(units, dimensions, skip_existing, disabled).join(units.withColumnRenamed("id", "insight_id"), "insight_id")
    hinted = F.col("dimension_type").isin(list(K.DIMENSION_HINTS))
    asked = todo.withColumn("query_id", F.col("insight_id") * len(order) + number).withColumn("_text", F.when(hinted, query_text(dimension="dimension_type")))
    fresh = embed(asked.filter(hinted).drop("embedding"), embedder, "_text").filter("embedding is not null").drop("error")
    queries = settled(fresh.unionByName(asked.filter(~hinted), allowMissingColumns=True).select("query_id", "insight_id", "dimension_type", "name", "description", "embedding", *(["source"] if by_source else [])))
    # queries of one vector (and source) find the same: they are searched once, and share a context
    owner = [F.col("source")] if by_source else []
    keyed = queries.withColumns({"_h": F.xxhash64("embedding", *owner), "_g": F.xxhash64(F.lit(1), F.reverse("embedding"), *owner)})
    distinct = settled(keyed.filter("embedding is not null").groupBy("_h", "_g").agg(F.min_by(F.struct("query_id", "embedding", *owner), "query_id").alias("q")).select("_h", "_g", "q.*"))
    found = near_enough(search_many(distinct, chunks, k, by_source), least).select("query_id", "rank", "chunk_id", "score")
    places = {c: chunks.schema[c].dataType.simpleString() if c in chunks.columns else t for c, t in (("speaker", "string"), ("page", "int"), ("start", "double"), ("end", "double"), ("section", "string"))}
    told = chunks.select("chunk_id", "source", "text", *(F.col(c) if c in chunks.columns else F.lit(None).cast(t).alias(c) for c, t in places.items()))
    lists = ranked(found.join(told, "chunk_id"), "chunk_id", "source", "text", "score", *places)
    context = lists.withColumn("chunks", drop_overlaps("chunks")).withColumn("context", format_context("chunks")["text"])
    context = settled(distinct.select("_h", "_g", "query_id").join(context, "query_id").drop("query_id"))
    ready = keyed.drop("embedding").join(context, ["_h", "_g"], "left").drop("_h", "_g")
    blank = F.trim(F.coalesce("context", F.lit(""))) == ""
    answered = complete(ready.filter(~blank).withColumn("prompt", assessment_prompt()), model, batch=batch).drop("prompt")
    silent = ready.filter(blank).withColumns({"reply": F.to_json(F.struct(F.col("dimension_type").alias("dimension"))), "error": F.lit(None).cast("string")})
    replied = answered.unionByName(silent).withColumnRenamed("error", "_error")
    parsed = parse_dimensions(replied, context="context")
    failed = F.col("_error").isNotNull()
    keep = lambda c: F.when(~failed, F.col(c)).alias(c)
    return parsed.select("insight_id", "dimension_type", keep("value"), keep("confidence"), keep("evidence"), "chunks", F.coalesce("_error", "error").alias("error"))
