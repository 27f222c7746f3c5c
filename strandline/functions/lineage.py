"""Where a job cuts its lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Only a local session, which is one machine, may have none: it gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def places(df: DataFrame, *order: str, name: str = "place") -> DataFrame:
    """Adds a place, from 1, in the order given. Places are counted within ranges; only the ranges' sizes are summed up together."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    # read twice below, so the ranges must not be dealt anew
    within = settled(spread.withColumn("_place", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = within.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return within.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")


def places_within(df: DataFrame, key: str, *order: str, name: str = "place") -> DataFrame:
    """Adds a place, from 1, within each key, in the order given. A key that fills several ranges is counted in each, so that none goes through one task."""
    spread = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order).withColumn("_part", F.spark_partition_id())
    # read twice below, so the ranges must not be dealt anew
    within = settled(spread.withColumn("_place", F.row_number().over(Window.partitionBy("_part", key).orderBy(*order))))
    sizes = within.groupBy("_part", key).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", key, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    return within.join(before, ["_part", key]).withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
