"""Objects in a store: listing, transcripts, plain texts, tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_objects(spark: SparkSession, root: str, glob: str = "*", limit: int | None = None) -> DataFrame:
    """path, length of the files below a folder, by path; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(root).select("path", "length")
    out = files.orderBy("path")
    return out if limit is None else out.limit(limit)


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, text of whole text files."""
    return spark.read.option("wholetext", True).option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).cast("string").alias("value")).write.mode("overwrite").text(path)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """path, transcript (variant) and error of JSON files, one object each; what can't be parsed is an error of its row."""
    raw = read_texts(spark, path)
    parsed = F.try_parse_json("text")
    return raw.select("path", parsed.alias("transcript"), F.when(parsed.isNull(), F.lit("not valid JSON")).alias("error"))


PREFIXES = {"podcast": "podcasts/transcripts", "document": "documents/transcripts"}


def write_transcripts(df: DataFrame, path: str, content_type: str = "content_type") -> None:
    """Rows as JSON lines in a folder for each content type; another type than podcast or document is an error."""
    known = F.coalesce(*(F.when(F.col(content_type) == k, F.lit(v)) for k, v in PREFIXES.items()), F.raise_error(F.concat(F.lit("unknown content type: "), F.coalesce(F.col(content_type), F.lit("null")))))
    body = [c for c in df.columns if c != content_type]
    df.select(known.alias("prefix"), F.to_json(F.struct(*body)).alias("value")).write.mode("overwrite").partitionBy("prefix").text(path)


def backfill_sizes(episodes: DataFrame, objects: DataFrame) -> DataFrame:
    """Fills null audio_file_size from the object (uri, length) of the audio; missing and empty objects leave it null."""
    sizes = objects.filter("length > 0").groupBy(F.col("uri").alias("_uri")).agg(F.max("length").cast("long").alias("_length"))
    out = episodes.join(sizes, F.col("gcs_audio_uri") == F.col("_uri"), "left")
    return out.select(*(F.coalesce(c, "_length").alias(c) if c == "audio_file_size" else c for c in episodes.columns))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: tuple[str, ...] = ()) -> None:
    """Parquet; an overwrite of a partitioned table replaces only the partitions that df has."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    (writer.option("partitionOverwriteMode", "dynamic") if partition_by and mode == "overwrite" else writer).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All files' columns; those that a file lacks are null."""
    return spark.read.option("mergeSchema", True).parquet(path)
