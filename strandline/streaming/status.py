"""Streams: current states, incremental indexing, incremental macro discovery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.functions.lineage import settled
from strandline.functions.vectors import normalize
from strandline.operators.similarity import matched_and_led, vector_sums
from strandline.operators.upsert import numbered_after
from strandline.streaming.changes import gather, latest, put


def latest_status(events: DataFrame, stamp: Column | None = None) -> DataFrame:
    """Current status of each (type, entity_id) of status events, batch or stream: that of the latest timestamp, whatever the order of arrival.

    Events without a timestamp get the stamp, now by default. Update mode keeps one row for each entity.
    """
    at = F.coalesce("timestamp", F.current_timestamp() if stamp is None else stamp)
    last = F.max_by(F.struct("status", "error"), F.struct(at, "status")).alias("s")
    return events.groupBy("type", "entity_id").agg(last, F.max(at).alias("timestamp")).select("type", "entity_id", "s.status", "s.error", "timestamp")


STATES = "type string, entity_id string, status string, error string, timestamp timestamp"
ENTITY = ["type", "entity_id"]


def status_batches(stream: DataFrame, path: str, checkpoint: str, stamp: Column | None = None):
    """Keeps the table of current states at path while status events arrive.

    The state store holds the latest event of each entity; a trigger hands on the entities that changed, and they alone are written (see
    current_states). Events that come late or again change nothing that is newer; a restart goes on from the checkpoint.
    """

    def each(batch: DataFrame, number: int) -> None:
        gather(batch.sparkSession, path, STATES, ENTITY, number)
        put(batch, path, number)

    return latest_status(stream, stamp).writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_states(spark: SparkSession, path: str) -> DataFrame:
    """type, entity_id, status, error, timestamp as the stream has left them."""
    return latest(spark, path, STATES, ENTITY)


def index_batches(stream: DataFrame, chunk: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Indexes arriving transcripts into the table at path (see indexed): each batch's chunks replace those of its sources.

    chunk makes chunks (source, embedding, ...) of a batch, and they alone are written, whatever the index holds. A batch that comes twice
    changes nothing more. Sources whose transcript has no chunk any more keep what they had.
    """

    def each(batch: DataFrame, number: int) -> None:
        new = chunk(batch)
        gather(batch.sparkSession, path, schema_of(new), ["source"], number, many=True)
        put(new, path, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def schema_of(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def indexed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The chunks as the stream has left them: of each source those of its latest batch."""
    return latest(spark, path, schema, ["source"], many=True)


VECTOR = "id long, name string, embedding array<float>"
ASSIGNED = "id long, macro_id long"
FREE = f"{VECTOR}, open boolean"
MACROS = "id long, name string, total array<double>, n long"


def discover_batches(stream: DataFrame, path: str, checkpoint: str, threshold: float = K.MACRO_THRESHOLD):
    """Macro discovery over a stream of units (id, name, embedding): each batch, and earlier units that stayed alone, are matched to the centroids so far; the rest is clustered.

    State is algebraic: of a macro the sum and number of its members' unit vectors, so that members are never read again, and the units that are
    free. A batch writes the macros and units that it touches (see changes); a batch that comes again after a failure changes nothing more.
    A unit whose id came before is left out by the stream's own state.
    """

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        for name, schema in (("free", FREE), ("macros", MACROS)):
            gather(spark, f"{path}/{name}", schema, ["id"], number)
        macros = settled(latest(spark, f"{path}/macros", MACROS, ["id"], number))
        free = latest(spark, f"{path}/free", FREE, ["id"], number).filter("open").drop("open")
        units = settled(free.unionByName(batch.select("id", "name", F.col("embedding").cast("array<float>").alias("embedding"))))
        matched, rest, led = matched_and_led(units, macros.select("id", F.col("total").alias("centroid_embedding")), threshold)
        grouped = rest.join(led.filter("leader is not null"), F.col("id") == F.col("node"))
        names = grouped.groupBy("leader").agg(F.min_by("name", "id").alias("name"))
        made = settled(numbered_after(names.join(vector_sums(grouped, "leader"), "leader"), macros, "leader"))
        gained = vector_sums(units.join(matched, "id"), "macro_id").select(F.col("macro_id").alias("id"), F.col("total").alias("_t"), F.col("n").alias("_n"))
        moved = macros.join(gained, "id").select("id", "name", F.zip_with("total", "_t", lambda x, y: x + y).alias("total"), (F.col("n") + F.col("_n")).alias("n"))
        linked = matched.select("id", "macro_id").unionByName(grouped.select("id", "leader").join(made.select("leader", F.col("id").alias("macro_id")), "leader").select("id", "macro_id"))
        linked = settled(linked)
        put(moved.unionByName(made.select("id", "name", "total", "n")), f"{path}/macros", number)
        put(linked, f"{path}/assigned", number)
        put(units.join(linked.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left").select("id", "name", "embedding", F.col("_id").isNull().alias("open")), f"{path}/free", number)

    return stream.dropDuplicates(["id"]).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def discovered(spark: SparkSession, path: str, before: int | None = None) -> tuple[DataFrame, DataFrame]:
    """units (id, macro_id; null if free) and macros (id, name, centroid_embedding, n) as the last batch, or the last before a number, left them."""
    free = latest(spark, f"{path}/free", FREE, ["id"], before).filter("open").select("id", F.lit(None).cast("long").alias("macro_id"))
    macros = latest(spark, f"{path}/macros", MACROS, ["id"], before)
    return latest(spark, f"{path}/assigned", ASSIGNED, ["id"], before).unionByName(free), macros.select("id", "name", normalize("total").alias("centroid_embedding"), "n")
