"""Nested views of insights: detail, hierarchy, pivot, export, evidence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import places_within
from strandline.functions.text import strip_overlap
from strandline.operators.catalog import resolve_source_ref


def listed(df: DataFrame, key: str, out: str, *fields: str | Column) -> DataFrame:
    """key, out: the rows of each key as an ordered array of structs."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(out))


def attached(df: DataFrame, key: str, side: DataFrame, side_key: str, out: str) -> DataFrame:
    """df with an array column of side; an empty array where side has none."""
    renamed = side.withColumnRenamed(side_key, "_k")
    kind = side.schema[out].dataType
    joined = df.join(renamed, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(out, F.coalesce(out, F.array().cast(kind))).drop("_k")


def unit_insight_detail(units: DataFrame, dimensions: DataFrame, evidence: DataFrame, episodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Insights with their dimensions, each with its evidence; evidence has its source and the text to show."""
    found = resolve_source_ref(evidence, episodes, documents)
    shown = found.withColumn("display_text", F.when(F.col("source_kind") == "podcast", strip_overlap("chunk_text")).otherwise(F.col("chunk_text")))
    items = listed(shown, "dimension_id", "evidence", "id", "display_text", "similarity_score", "source_kind", "source_id")
    dims = attached(dimensions, "id", items, "dimension_id", "evidence")
    nested = listed(dims, "unit_insight_id", "dimensions", "id", "dimension_type", "value", "confidence", "evidence")
    return attached(units, "id", nested, "unit_insight_id", "dimensions")


def hierarchy(clusters: DataFrame, macros: DataFrame, units: DataFrame) -> DataFrame:
    """level, id, name, macros (id, name, units) and orphans: a row for each cluster, and rows for macros and units without one."""
    members = listed(units.filter("macro_insight_id is not null"), "macro_insight_id", "units", "id", "name")
    full = attached(macros, "id", members, "macro_insight_id", "units")
    by_cluster = listed(full.filter("cluster_id is not null"), "cluster_id", "macros", "id", "name", "units")
    alone = listed(units.filter("cluster_id is not null and macro_insight_id is null"), "cluster_id", "orphans", "id", "name")
    rows = attached(attached(clusters, "id", by_cluster, "cluster_id", "macros"), "id", alone, "cluster_id", "orphans")
    rows = rows.select(F.lit("cluster").alias("level"), "id", "name", "macros", "orphans")
    macro_type, unit_type = rows.schema["macros"].dataType, rows.schema["orphans"].dataType
    one = F.array(F.struct("id", "name", "units")).cast(macro_type)
    loose_macros = full.filter("cluster_id is null").select(F.lit("unassigned_macro").alias("level"), "id", "name", one.alias("macros"), F.array().cast(unit_type).alias("orphans"))
    loose_units = units.filter("cluster_id is null and macro_insight_id is null").select(F.lit("unassigned_unit").alias("level"), "id", "name", F.array().cast(macro_type).alias("macros"), F.array(F.struct("id", "name")).cast(unit_type).alias("orphans"))
    return rows.unionByName(loose_macros).unionByName(loose_units)


PART_ROWS = 10_000


def hierarchy_parts(clusters: DataFrame, macros: DataFrame, units: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """id, name, part, parts, total, members: the members of each cluster in parts of bounded size, for clusters too large for one row.

    Members are, in order, the units of its macros (macro_id, macro_name, unit_id, unit_name; a macro without units has one row without a unit), then its
    units without a macro. total counts the rows of all parts; a cluster without members has one empty part. Macros and units without a
    cluster are rows of their own already: see hierarchy.
    """
    named = macros.filter("cluster_id is not null").select("cluster_id", F.col("id").alias("macro_id"), F.col("name").alias("macro_name"))
    held = units.filter("macro_insight_id is not null").select(F.col("macro_insight_id").alias("macro_id"), F.col("id").alias("unit_id"), F.col("name").alias("unit_name"))
    alone = units.filter("cluster_id is not null and macro_insight_id is null").select("cluster_id", F.col("id").alias("unit_id"), F.col("name").alias("unit_name"))
    fields = ["macro_id", "macro_name", "unit_id", "unit_name"]
    rows = named.join(held, "macro_id", "left").unionByName(alone, allowMissingColumns=True).select("cluster_id", F.col("macro_id").isNull().alias("_alone"), *fields)
    placed = places_within(rows, "cluster_id", "_alone", "macro_id", "unit_id").withColumn("part", F.floor((F.col("place") - 1) / part_rows))
    parts = placed.groupBy("cluster_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", *fields))), lambda x: F.struct(*(x[f].alias(f) for f in fields))).alias("members"))
    totals = placed.groupBy("cluster_id").agg(F.count("*").alias("total"))
    full = clusters.select("id", "name").join(totals.join(parts, "cluster_id"), F.col("id") == F.col("cluster_id"), "left")
    total = F.coalesce("total", F.lit(0))
    return full.select("id", "name", F.coalesce("part", F.lit(0)).cast("long").alias("part"), F.greatest(F.lit(1), F.ceil(total / part_rows)).cast("long").alias("parts"), total.alias("total"), F.coalesce("members", F.array().cast(parts.schema["members"].dataType)).alias("members"))


def dimension_pivot(units: DataFrame, dimensions: DataFrame, types: Sequence[str], new_ids: DataFrame | None = None) -> DataFrame:
    """A column for each dimension type with the insight's last value, its source type, and whether it is new."""
    wide = dimensions.filter(F.col("dimension_type").isin(list(types))).groupBy(F.col("unit_insight_id").alias("_u")).pivot("dimension_type", list(types)).agg(F.max_by("value", "id"))
    out = units.join(wide, F.col("id") == F.col("_u"), "left").drop("_u")
    out = out.withColumn("source_type", F.when(F.col("episode_id").isNotNull(), "podcast").when(F.col("document_id").isNotNull(), "document").otherwise("unknown"))
    if new_ids is None:
        return out.withColumn("is_new", F.lit(False))
    return out.join(new_ids.select(F.col("id").alias("_n")).distinct(), F.col("id") == F.col("_n"), "left").withColumn("is_new", F.col("_n").isNotNull()).drop("_n")


LEVELS = {"adoption": "stage", "expectation": "level", "progress": "horizon", "criticality": "level", "urgency": "level", "actionability": "level"}


def export_dimensions(units: DataFrame, dimensions: DataFrame, evidence: DataFrame, most: int = 500) -> DataFrame:
    """id, export: JSON of each insight with a dimension: its dimensions by type, each with level, confidence and evidence; the last of a type counts."""
    place = F.row_number().over(Window.partitionBy("unit_insight_id", "dimension_type").orderBy(F.desc("id")))
    last = dimensions.withColumn("_p", place).filter("_p = 1").drop("_p")
    items = listed(evidence.withColumn("text", F.left("chunk_text", F.lit(most))), "dimension_id", "evidence", "id", "text", F.col("source_ref").alias("source"), F.col("similarity_score").alias("similarity"))
    dims = attached(last, "id", items, "dimension_id", "evidence")
    seen = F.transform("evidence", lambda e: F.struct(e["text"].alias("text"), e["source"].alias("source"), e["similarity"].alias("similarity")))
    named = {t: F.max(F.when(F.col("dimension_type") == t, F.struct(F.col("value").alias(level), F.col("confidence"), seen.alias("evidence")))).alias(t) for t, level in LEVELS.items()}
    wide = dims.groupBy(F.col("unit_insight_id").alias("_u")).agg(*named.values())
    body = F.struct("id", "name", "description", "type", F.struct(*LEVELS).alias("dimensions"))
    return units.join(wide, F.col("id") == F.col("_u")).select("id", F.to_json(body).alias("export"))


def sample_evidence(evidence: DataFrame, count: int, insight: str = "insight_id", order: str = "place", start: str = "start_time") -> DataFrame:
    """At most count rows of each insight: spread over time if as many have a start, else the first."""
    per = Window.partitionBy(insight)
    sized = evidence.withColumns({"_n": F.count("*").over(per), "_timed": F.count(start).over(per)})
    spread = (F.col("_n") > count) & (F.col("_timed") >= count)
    numbered = sized.filter(~spread | F.col(start).isNotNull()).withColumn("_i", F.row_number().over(per.orderBy(F.when(spread, F.col(start)), order)) - 1)
    # position i is floor(k * timed / count) for some k
    k = F.ceil(F.col("_i") * count / F.col("_timed"))
    picked = F.when(spread, (F.floor(k * F.col("_timed") / count) == F.col("_i")) & (k < count)).otherwise(F.col("_i") < count)
    return numbered.filter(picked).drop("_n", "_timed", "_i")


def first_of_texts(evidence: DataFrame, insight: str = "insight_id", order: str = "place", text: str = "chunk_text") -> DataFrame:
    """The first row of each text of an insight, without regard to case and outer space."""
    place = F.row_number().over(Window.partitionBy(insight, F.lower(F.trim(F.col(text)))).orderBy(order))
    return evidence.withColumn("_p", place).filter("_p = 1").drop("_p")


TREND, STAKE = list(K.TREND_DIMENSIONS), list(K.STAKE_DIMENSIONS)
