"""Best-fit packing into sequences of several permitted lengths.

Documents are dealt to shards by hash; a shard has about the same number of pieces at every size of the corpus, and packs its own. Pieces
go, the longest first, into the open bin that they fill best. Where none has room, a bin of the length that costs least is opened: for
each permitted length the pieces to come are laid into it, and the length of least cost for each token in it is taken. Whole packings
made that way, for all lengths or for those from a smallest one on, are compared by cost. At last each bin shrinks to the
smallest length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from operator import neg

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import table, written

LENGTHS = (1024, 2048, 4096, 8192)
SHARD_PIECES = 8192


def cost(length: int) -> float:
    """Of a sequence: its tokens, and attention that grows with the square."""
    return length + length * length / 65536


def opened(sizes: Sequence[int], at: int, lengths: Sequence[int]) -> int:
    """The length of least cost for each token, of a bin opened for the piece at this place and filled with the largest of the pieces behind it that fit. sizes fall."""
    best, chosen = None, lengths[-1]
    for length in lengths[bisect_left(lengths, sizes[at]) :]:
        room, i, end = length - sizes[at], at + 1, len(sizes)
        while room > 0 and (i := bisect_left(sizes, -room, i, end, key=neg)) < end:
            room -= sizes[i]
            i += 1
        each = cost(lengths[bisect_left(lengths, length - room)]) / (length - room)
        if best is None or each < best - 1e-12:
            best, chosen = each, length
    return chosen


def fill(sizes: Sequence[int], lengths: Sequence[int], least: int) -> list[tuple[int, list[int]]]:
    """Best fit in the given order, from large to small: (length opened, positions of the pieces) of each bin. No bin under the length least is opened."""
    permitted = [n for n in lengths if n >= least]
    bins: list[tuple[int, list[int]]] = []
    rooms: list[int] = []  # distinct free room of open bins, in order
    held: dict[int, list[int]] = {}
    for i, size in enumerate(sizes):
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(at)
        else:
            room = opened(sizes, i, permitted)
            b = len(bins)
            bins.append((room, []))
        bins[b][1].append(i)
        room -= size
        if room:
            if room not in held:
                held[room] = []
                insort(rooms, room)
            held[room].append(b)
    return bins


def pack(sizes: Sequence[int], lengths: Sequence[int]) -> list[tuple[int, list[int]]]:
    """The packing of least cost of those compared: (length, positions) of each bin, shrunk. sizes run from large to small; none exceeds the longest length."""

    def shrunk(bins: list[tuple[int, list[int]]]) -> list[tuple[int, list[int]]]:
        return [(lengths[bisect_left(lengths, sum(sizes[i] for i in own))], own) for _, own in bins]

    return min((shrunk(fill(sizes, lengths, least)) for least in lengths), key=lambda bins: sum(cost(n) for n, _ in bins))


PACKED = "bin long, capacity int, used int, slot int, doc_id long, piece long, start long, length int"


def pack_documents(docs: DataFrame, length: Column, lengths: Sequence[int] = LENGTHS, id_col: str = "doc_id", shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """A row for each piece: bin, capacity and used of the bin, slot in it, and doc_id, piece, start, length of the piece.

    length: tokens of a document, the end token included; null and less than 1 count as 1. A document over the longest length is cut into
    pieces of that length and a rest. Every row is packed, repeated ids and null ids too; an empty table gives no bins.
    """
    lengths = sorted(lengths)
    top = lengths[-1]
    known = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("tokens"))
    pieces = known.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("tokens") - 1) / top))))
    pieces = pieces.select("doc_id", "piece", (F.col("piece") * top).alias("start"), F.least(F.lit(top), F.col("tokens") - F.col("piece") * top).cast("int").alias("length"))
    pieces = written(pieces, "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        sizes = pdf.length.tolist()
        out = []
        for b, (capacity, own) in enumerate(pack(sizes, lengths)):
            used = sum(sizes[i] for i in own)
            out += [(key[0] << 32 | b, capacity, used, slot, i) for slot, i in enumerate(own)]
        got = pd.DataFrame(out, columns=["bin", "capacity", "used", "slot", "i"])
        rows = pdf.iloc[got.pop("i")].reset_index(drop=True)
        return pd.concat([got, rows[["doc_id", "piece", "start", "length"]].astype({"doc_id": "Int64"})], axis=1)

    # null and repeated ids are spread by the piece's other columns and a row's place
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "length", F.when(F.col("doc_id").isNull(), F.rand(5))), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, PACKED)


def word_tokens(text: str = "text") -> Column:
    """Words of a text and an end token; built-in functions only."""
    return F.size(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), r"[\x20\x09-\x0D]+")) + F.when(F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]"), 1).otherwise(0)


def op1_best_fit(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 to 8192 words."""
    return pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), word_tokens())
