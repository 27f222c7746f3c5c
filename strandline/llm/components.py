"""Connected components of links held in a DataFrame, by contraction; nothing of them goes to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import written

FEW = 20_000  # links that one task may hold


def united(edges: DataFrame) -> DataFrame:
    """low, up of the nodes of few links: each with the smallest node it can reach, by one task."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = x = up[up[x]]
            return x

        for pdf in it:
            for a, b in zip(pdf.a.tolist(), pdf.b.tolist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        yield pd.DataFrame({"low": list(up), "up": [root(x) for x in list(up)]}, dtype="int64")

    return edges.coalesce(1).mapInPandas(run, "low long, up long")


def components(links: DataFrame) -> DataFrame:
    """node, root of each node that links (a, b: long) name; the root is the smallest node that can be reached.

    Every round each node points to its smallest neighbour, pointers are followed, and links are drawn between what they lead to. Once there
    are FEW, one task unites them. Links to oneself and repeated ones are harmless; without links the result is empty.
    """
    edges = written(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "links")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node"))
    to = lambda up, c: up.select(F.col("low").alias(f"{c}_low"), F.col("up").alias(f"{c}_up"))
    led = lambda labels, up: labels.join(to(up, "l"), F.col("root") == F.col("l_low"), "left").select("node", F.coalesce("l_up", "root").alias("root"))
    while (n := edges.count()) > FEW:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")).select(F.col("a").alias("low"), "up")
        up = written(up, "pointers")
        for _ in range(2):  # each step doubles how far a pointer leads
            up = up.join(to(up, "f"), F.col("up") == F.col("f_low")).select("low", F.col("f_up").alias("up"))
        up = written(up, "pointers")
        labels = led(labels, up)
        moved = edges.join(to(up, "a"), F.col("a") == F.col("a_low")).join(to(up, "b"), F.col("b") == F.col("b_low"))
        edges = written(moved.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).filter("a < b").distinct(), "links")
    return written(led(labels, united(edges)) if n else labels, "labels")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The roots (node, root) after further links (a, b) of their nodes; nodes that no link names stay as they are."""
    at = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    moved = links.select("a", "b").join(at("a"), "a").join(at("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b"))
    found = components(moved).select(F.col("node").alias("old"), F.col("root").alias("new"))
    return written(roots.join(found, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root")), "roots")
