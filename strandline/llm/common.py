"""What the operators of this folder share: work folder, written tables, words and hashes, the crc split."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.lineage import work_path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Cuts the lineage: writes a Parquet table into the shared folder and reads it back."""
    spark = df.sparkSession
    path = work_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written_by(df: DataFrame, name: str, key: str, n: int) -> DataFrame:
    """The same, as a table of n buckets by a key: what groups or joins by it takes the rows as they lie, without an exchange."""
    spark = df.sparkSession
    path = work_path(spark, name)
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    saved = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(saved)
    return spark.table(saved)


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string")) % n


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None, lower: bool = True) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8. bytes.split() and bytes.lower() know ASCII white space and letters only."""
    raw = text.encode("utf-8", "replace") if text else b""
    return (raw.lower() if lower else raw).split()


def word_hashes(parts: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words; in order, one for each start."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = mix(out + h[i : len(h) - n + 1 + i])
    return out


def slices(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of slices of so many elements, one slice after the other."""
    upto = np.cumsum(size)
    return np.repeat(start - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)


class Memo:
    """Values of any length, of several kinds, under 64-bit keys; what is held is bounded in bytes by its user, who asks for full().

    Keys lie in two sorted runs, a long and a short one, so that adding a few doesn't sort all anew.
    """

    def __init__(self, *kinds: type, most: int):
        self.kinds, self.most = kinds, most
        self.forget()

    def forget(self) -> None:
        self.runs = [(np.empty(0, np.uint64), np.empty(0, np.int64))] * 2
        self.n = 0
        self.pool = [np.empty(0, k) for k in self.kinds]
        self.used = [0] * len(self.kinds)
        self.start = [np.empty(0, np.int64) for _ in self.kinds]

    def full(self) -> bool:
        return sum(u * p.itemsize for u, p in zip(self.used, self.pool, strict=True)) + self.n * (16 + 8 * len(self.kinds)) > self.most

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Where the values of each key are, or -1."""
        out = np.full(len(keys), -1)
        for known, at in self.runs:
            if len(known):
                i = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                out = np.where(known[i] == keys, at[i], out)
        return out

    def add(self, keys: np.ndarray, *values: tuple[np.ndarray, np.ndarray]) -> None:
        """Keys that are not there yet, each once; for each kind all values and how many each key has."""
        at = np.arange(self.n, self.n + len(keys))
        for k, (flat, size) in enumerate(values):
            end = self.used[k] + len(flat)
            if end > len(self.pool[k]):
                self.pool[k] = np.concatenate([self.pool[k][: self.used[k]], np.empty(max(end, 1 << 16), self.kinds[k])])
            self.pool[k][self.used[k] : end] = flat
            self.start[k] = np.concatenate([self.start[k][:-1], self.used[k] + np.append(0, np.cumsum(size))])
            self.used[k] = end
        self.n += len(keys)
        (long, long_at), (short, short_at) = self.runs
        short, short_at = np.concatenate([short, keys]), np.concatenate([short_at, at])
        if 4 * len(short) > len(long):
            long, long_at, short, short_at = np.concatenate([long, short]), np.concatenate([long_at, short_at]), short[:0], short_at[:0]
            order = np.argsort(long, kind="stable")
            long, long_at = long[order], long_at[order]
        order = np.argsort(short, kind="stable")
        self.runs = [(long, long_at), (short[order], short_at[order])]

    def get(self, kind: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of one kind, and how many each place has."""
        start = self.start[kind]
        size = start[at + 1] - start[at] if len(at) else np.empty(0, np.int64)
        return self.pool[kind][slices(start[at] if len(at) else size, size)], size


def batches_of(texts: list, size: int):
    """(from, to) ranges of about so many characters, one text at least."""
    start, total = 0, 0
    for i, x in enumerate(texts):
        if total and total + len(x) > size:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield start, len(texts)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, most: int, size: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and label of at most per_class ids of each label, the first by a hash of the id, and of those the first whose sizes sum up to no more than most.

    usable: a condition on the id; size: of a document, as an expression of docs (its bytes, its lines). Null labels are left out; of
    several labels of one id the highest counts; of several documents of one id, all, and their sizes add up. Ids whose documents alone
    exceed a sixteenth of the bound are left out. Both bounds together make the sample safe to collect at every size.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label).alias("y")).filter("doc_id is not null and y in (0, 1)").filter(usable)
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(size, F.lit(0)).alias("size")).groupBy("doc_id").agg(F.sum("size").alias("size"))
    ready = written(known.join(sizes.filter(F.col("size") <= most // 16), "doc_id").withColumn("order", F.xxhash64("doc_id")), "labelled")
    first = ready.filter("y = 0").orderBy("order", "doc_id").limit(per_class).unionByName(ready.filter("y = 1").orderBy("order", "doc_id").limit(per_class))
    upto = F.sum("size").over(Window.partitionBy("y").orderBy("order", "doc_id"))
    chosen = first.withColumn("upto", upto).filter(F.col("upto") <= most).select("doc_id", "y")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.join(F.broadcast(chosen), "doc_id")
