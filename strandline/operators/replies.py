"""Models' replies in JSON, turned into rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import constants as K

INSIGHTS = "insights ARRAY<STRUCT<name STRING, description STRING, type STRING, evidence STRING>>, extraction_notes STRING"
DIMENSION = "dimension STRING, value STRING, confidence DOUBLE, evidence ARRAY<STRUCT<text STRING, source STRING, speaker STRING, page INT, start DOUBLE, end DOUBLE>>"


def parse_insights(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """A row for each insight with name, description and type; place is that within the reply."""
    out = replies.select(*[c for c in replies.columns if c != reply], F.posexplode(F.from_json(reply, INSIGHTS)["insights"]).alias("place", "_i"))
    keep = [c for c in out.columns if c != "_i"]
    said = {c: F.trim(F.col("_i")[c]) for c in ("name", "description", "type")}
    full = out.select(*keep, *(v.alias(k) for k, v in said.items()), F.trim(F.coalesce(F.col("_i")["evidence"], F.lit(""))).alias("evidence"))
    return full.filter("name <> '' and description <> '' and type <> ''")


def parse_dimensions(replies: DataFrame, reply: str = "reply", context: str | None = None) -> DataFrame:
    """dimension, value, confidence, evidence and error of each reply; an unknown dimension is an error. A blank context gives Unknown without evidence."""
    r = F.from_json(reply, DIMENSION)
    name = F.lower(F.trim(F.coalesce(r["dimension"], F.lit(""))))
    known = name.isin([*K.TREND_DIMENSIONS, *K.STAKE_DIMENSIONS])
    item = lambda e: F.struct(F.coalesce(e["text"], F.lit("")).alias("text"), F.when(e["source"] != "", e["source"]).otherwise("unknown").alias("source"), e["speaker"].alias("speaker"), e["page"].alias("page"), e["start"].alias("start_time"), e["end"].alias("end_time"))
    none = F.filter(F.transform(F.coalesce(r["evidence"], F.array().cast("array<struct<text:string,source:string,speaker:string,page:int,start:double,end:double>>")), item), lambda _: F.lit(context is None) if context is None else F.trim(F.coalesce(F.col(context), F.lit(""))) != "")
    blank = F.lit(False) if context is None else F.trim(F.coalesce(F.col(context), F.lit(""))) == ""
    keep = [c for c in replies.columns if c not in (reply, context)]
    return replies.select(
        *keep, F.when(known, name).alias("dimension"), F.when(blank, "Unknown").otherwise(F.coalesce(r["value"], F.lit("Unknown"))).alias("value"),
        F.when(blank, 0.0).otherwise(r["confidence"]).alias("confidence"), none.alias("evidence"), F.when(~known, F.concat(F.lit("unknown dimension: "), name)).alias("error"))
