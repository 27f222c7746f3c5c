"""Shards by fixed virtual slots.

A record's hash names one of thousands of virtual slots, whose number never changes. Bytes and rows are summed for each slot, and a
versioned map says which shard holds a slot: version 1 deals equal ranges of slots to the shards, and every later version is an edit that
lists only the slots that move. The map has a row for each slot at most, whatever the corpus holds; it alone goes through the driver.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import work_path
from strandline.llm.common import table

SLOTS = 16384
SHARDS = 40
FILE_BYTES = 128 << 20
MAP = "vslot int, shard int"


def virtual_slot(slots: int, *of: str) -> Column:
    """Of a record; null columns don't take part in its hash."""
    return F.pmod(F.xxhash64(*of), F.lit(slots)).cast("int")


def record_size(text: str) -> Column:
    """Bytes of the text in UTF-8 and 16 for what else a record holds."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long")


def slot_loads(rows: DataFrame) -> pd.DataFrame:
    """bytes and rows of each slot that has some, from columns vslot and size."""
    return rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).toPandas().sort_values("vslot", ignore_index=True)


def first_owner(slots: int, shards: int) -> np.ndarray:
    """Version 1: the shard of each slot, by equal ranges."""
    return (np.arange(slots) * shards // slots).astype(np.int32)


def rebalanced(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """An edit of the map that makes the shards' loads nearly equal.

    Each shard keeps its largest slots as long as they fit the mean; the rest, small ones mostly, and all slots of shards that are no more, go
    to the emptiest shard, the largest first. So no shard exceeds the mean by more than one slot that was moved, or one that exceeds it alone.
    """
    mean = -(-int(load.sum()) // shards)
    order = np.lexsort((np.arange(len(load)), -load))
    new, total, free = owner.copy(), [0] * shards, []
    for s in order.tolist():
        at, x = int(owner[s]), int(load[s])
        if at < shards and (total[at] + x <= mean or (x > mean and not total[at])):
            total[at] += x
        else:
            free.append(s)
    heap = [(x, i) for i, x in enumerate(total)]
    heapq.heapify(heap)
    for s in free:
        x, i = heap[0]
        heapq.heapreplace(heap, (x + int(load[s]), i))
        new[s] = i
    return new


def grown(owner: np.ndarray, load: np.ndarray, shards: int) -> np.ndarray:
    """An edit for one more shard: slots move into it alone, from the fullest shards, until it holds its share."""
    mean = int(load.sum()) // (shards + 1)
    total = np.bincount(owner, load, shards + 1).astype(np.int64)
    of = {i: sorted(np.flatnonzero(owner == i).tolist(), key=lambda s: int(load[s])) for i in range(shards)}
    heap = [(-int(total[i]), i) for i in range(shards)]
    heapq.heapify(heap)
    new = owner.copy()
    while heap and total[shards] < mean:
        left, i = heapq.heappop(heap)
        while of[i] and total[shards] + load[of[i][-1]] > mean:  # what would overfill the new shard stays
            of[i].pop()
        if of[i]:
            s = of[i].pop()
            new[s] = shards
            total[shards] += load[s]
            heapq.heappush(heap, (left + int(load[s]), i))
    return new


def put_version(spark: SparkSession, path: str, version: int, before: np.ndarray | None, owner: np.ndarray) -> None:
    """Stores an edit of the map: the slots whose shard differs from the version before."""
    moved = np.flatnonzero(owner != before) if before is not None else np.arange(len(owner))
    rows = pd.DataFrame({"vslot": moved.astype(np.int32), "shard": owner[moved]})
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """vslot and shard at a version, the last by default: the last edit of each slot up to it."""
    edits = spark.read.schema(f"{MAP}, version int").parquet(path)
    edits = edits if version is None else edits.filter(F.col("version") <= version)
    return edits.groupBy("vslot").agg(F.max_by("shard", "version").alias("shard"))


def placed(owner: np.ndarray, loads: pd.DataFrame, file_bytes: int = FILE_BYTES) -> pd.DataFrame:
    """vslot, shard, part, before of the slots in use: their file, files being cut at file_bytes, and the rows of their shard before them."""
    at = loads.assign(shard=owner[loads.vslot.to_numpy()]).sort_values(["shard", "vslot"], ignore_index=True)
    shards = at.groupby("shard")
    at["before"] = shards["rows"].cumsum() - at["rows"]
    file = (shards["bytes"].cumsum() - at["bytes"]) // file_bytes
    at["part"] = at.groupby([at.shard, file]).ngroup()
    return at[["vslot", "shard", "part", "before"]].astype({"shard": np.int32, "part": np.int32, "before": np.int64})


class Shards:
    """A sharded table: its files (shard=N folders, columns doc_id, text, vslot), its map, and where each slot stands in its shard."""

    def __init__(self, spark: SparkSession, path: str, map_path: str, places: DataFrame):
        self.spark, self.path, self.map_path, self.places = spark, path, map_path, places

    def rows(self) -> DataFrame:
        """doc_id, text, vslot, shard, as read from the files."""
        return self.spark.read.schema("doc_id long, text string, vslot int, shard int").parquet(self.path)


def write_shards(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> Shards:
    """Deals all rows to shards of nearly equal bytes and writes their files, each shard's in slot order, and the map's versions.

    The record is its id and text: null ids are spread by their texts; null texts count 16 bytes; rows equal in both share a slot. Other
    columns are not read. An empty table gives version 1 of the map and no files' rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("vslot", virtual_slot(slots, "doc_id", "text"))
    loads = slot_loads(rows.select("vslot", record_size("text").alias("size")))
    load = np.zeros(slots, np.int64)
    load[loads.vslot.to_numpy(np.int64)] = loads["bytes"].to_numpy(np.int64)
    path, map_path = work_path(spark, "shards"), work_path(spark, "slot_map")
    start = first_owner(slots, shards)
    owner = rebalanced(start, load, shards)
    put_version(spark, map_path, 1, None, start)
    put_version(spark, map_path, 2, start, owner)
    at = placed(owner, loads, file_bytes)
    places = spark.createDataFrame(at, "vslot int, shard int, part int, before long")
    dealt = rows.join(F.broadcast(places.select("vslot", "shard", "part")), "vslot")
    files = dealt.repartitionById(int(at.part.max()) + 1 if len(at) else 1, "part").sortWithinPartitions("shard", "vslot", "doc_id")
    files.select("doc_id", "text", "vslot", "shard").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return Shards(spark, path, map_path, places)


def shard_rows(stored: Shards) -> DataFrame:
    """doc_id, size, text_crc32, shard, vslot and slot, the place in the shard from 0, of each stored record.

    A place is the number of the shard's rows in slots before, and the place within the slot by id and content, so that no window is larger
    than a slot.
    """
    known = stored.rows().select("doc_id", record_size("text").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), "shard", "vslot")
    within = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return known.withColumn("_in", within).join(F.broadcast(stored.places.select("vslot", "before")), "vslot").withColumn("slot", F.col("before") + F.col("_in")).drop("_in", "before")


def op13_virtual_slots(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes, as read back from the shards' files."""
    stored = write_shards(table(spark, sf_dir, "documents"))
    return shard_rows(stored).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("vslot").alias("virtual_slot"))
