"""Tables kept as changes: each batch of a stream writes the rows of the keys it changes, and of a key the rows of its latest batch stand.

A batch writes what its size asks for, whatever the table holds. Every so many batches are gathered into a base, and every so many bases into a
full table, so that a row is written again a few times only, and few parts are read. What a part stands for is removed. A batch that
comes again finds its own changes written, or writes them from the same state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GATHER = 12  # batches beside the last base, and bases beside the full table
PARTS = ("full", "base", "batch")


def folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(spark: SparkSession, path: str, before: int | None = None) -> dict[str, list[int]]:
    """Numbers of the full tables, bases and batches that are all there, up to a number."""
    at, fs = folder(spark, path)
    found: dict[str, list[int]] = {k: [] for k in PARTS}
    if fs.exists(at):
        for f in fs.listStatus(at):
            kind, _, number = f.getPath().getName().partition("-")
            if kind in found and (before is None or int(number) < before) and fs.exists(folder(spark, f"{f.getPath()}/_SUCCESS")[0]):
                found[kind].append(int(number))
    return {k: sorted(v) for k, v in found.items()}


def standing(spark: SparkSession, path: str, before: int | None = None) -> list[tuple[int, str]]:
    """Number and folder of the parts that make up the table: the last full one, the bases after it, the batches after those."""
    found, out, last = written(spark, path, before), [], -1
    for kind in PARTS:
        own = [n for n in found[kind] if n > last]
        own = own[-1:] if kind == "full" else own
        out += [(n, f"{path}/{kind}-{n}") for n in own]
        last = own[-1] if own else last
    return out


def put(df: DataFrame, path: str, number: int) -> None:
    """Writes a batch's rows, once."""
    if number not in written(df.sparkSession, path)["batch"]:
        df.write.mode("overwrite").parquet(f"{path}/batch-{number}")


def merged(spark: SparkSession, parts: list[tuple[int, str]], schema: str, keys: list[str], many: bool) -> DataFrame:
    out = None
    for n, p in parts:
        part = spark.read.schema(schema).parquet(p).withColumn("_n", F.lit(n))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema)
    columns = [c for c in out.columns if c != "_n"]
    if len(parts) == 1:
        return out.select(columns)
    if many:
        last = out.groupBy(*keys).agg(F.max("_n").alias("_m")).withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.col("_n") == F.col("_m")
        for k in keys:
            same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
        return out.join(last, same, "left_semi").select(columns)
    rest = [c for c in columns if c not in keys]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_n").alias("_r"))
    return last.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(columns)


def latest(spark: SparkSession, path: str, schema: str, keys: list[str], before: int | None = None, many: bool = False) -> DataFrame:
    """The table as the last batch, or the last before a number, left it; empty if there is none. many: a batch may have several rows of a key, and all stand."""
    return merged(spark, standing(spark, path, before), schema, keys, many)


def gather(spark: SparkSession, path: str, schema: str, keys: list[str], number: int, at_most: int = GATHER, many: bool = False) -> None:
    """Gathers what lies before a batch, if there is much, and removes what it stands for. The state before the batch stays readable."""
    for kind, into in (("batch", "base"), ("base", "full")):
        parts = [(n, p) for n, p in standing(spark, path, number) if p.rsplit("/", 1)[1].startswith(kind)]
        if len(parts) > at_most:
            if into == "full":
                parts = [(n, p) for n, p in standing(spark, path, number) if n <= parts[-1][0] and "/batch-" not in p[len(path) :]]
            merged(spark, parts, schema, keys, many).write.mode("overwrite").parquet(f"{path}/{into}-{parts[-1][0]}")
    kept = {p for _, p in standing(spark, path, number)}
    for kind, numbers in written(spark, path, number).items():
        for n in numbers:
            if f"{path}/{kind}-{n}" not in kept:
                at, fs = folder(spark, f"{path}/{kind}-{n}")
                fs.delete(at, True)
