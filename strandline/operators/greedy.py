"""Ordered greedy choice over a graph: in order, each node that is still free takes all its free neighbours, if together they weigh enough.

Two steps alternate until nothing is open. The first settles, all over the graph at once, each node that comes first among the open ones within
two links of it: nobody else can take what it takes. The second takes the first open nodes in order, up to a bounded number of links, through one
task. So neither long chains of decisions nor many independent ones make many rounds: there are no more than links by bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.lineage import settled

MOST = 400_000  # links, counted from both ends, that one task takes at a time

TAKEN = "node long, leader long"


def replayed(base: np.ndarray, member: np.ndarray, base_weight: np.ndarray, weight: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """node and leader of what bases take, in their order; base, member, weights: the links of each base with what was free."""
    order = np.argsort(base, kind="stable")
    base, member, base_weight, weight = base[order], member[order], base_weight[order], weight[order]
    nodes, place = np.unique(np.concatenate([base, member]), return_inverse=True)
    own, other = place[: len(base)], place[len(base) :]
    free = np.ones(len(nodes), bool)
    leader = np.full(len(nodes), -1)
    first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.empty(0, int)
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(own)], strict=True):
        x = own[s]
        if free[x]:
            near = other[s:e]
            open_ = free[near]
            if base_weight[s] + weight[s:e][open_].sum() >= least:
                free[x] = free[near] = False
                leader[near[open_]] = leader[x] = x
    taken = np.flatnonzero(leader >= 0)
    return nodes[taken], nodes[leader[taken]]


def one_task(links: DataFrame, least: int) -> DataFrame:
    """node, leader of a bounded number of links, whose bases' links are all there."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(it)
        if parts:
            every = pd.concat(parts)
            node, leader = replayed(*(every[c].to_numpy(np.int64) for c in ("u", "x", "wu", "wx")), least)
            yield pd.DataFrame({"node": node, "leader": leader})

    return links.coalesce(1).mapInPandas(run, TAKEN)


def first_of_two_links(links: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """node, leader of what the open nodes take that come first within two links; and u: those nodes, which are open no more."""
    near = links.groupBy("x").agg(F.min("u").alias("m"))
    # a node is itself within reach of its neighbours
    seen = links.join(near, "x").groupBy("u").agg(F.min("m").alias("m"), F.sum("wx").alias("w"), F.first("wu").alias("wu"))
    own = near.select(F.col("x").alias("u"), F.col("m").alias("own"))
    decided = seen.join(own, "u", "left").filter("u <= m and u <= coalesce(own, u)").select("u", (F.col("w") + F.col("wu") >= least).alias("leads"))
    decided = settled(decided)
    led = decided.filter("leads").select("u")
    taken = links.join(led, "u", "left_semi").select(F.col("x").alias("node"), F.col("u").alias("leader")).unionByName(led.select(F.col("u").alias("node"), F.col("u").alias("leader")))
    return settled(taken), decided.select("u")


def first_open(links: DataFrame, most: int) -> int:
    """The last node, in order, of the first ones whose links number no more than most; of one node at least. No more than most rows are looked at."""
    first = links.groupBy("u").agg(F.count("*").alias("n")).orderBy("u").limit(most).toPandas()
    return int(first.u[max(int(np.searchsorted(first.n.cumsum(), most, "right")), 1) - 1])


def ordered_greedy(edges: DataFrame, weights: DataFrame | None = None, least: int = 1, most: int | None = None, after: int | None = None) -> DataFrame:
    """node, leader of all nodes that are taken, leaders included; order is that of the numbers, small ones first.

    edges: a, b, in either direction or both, without loops; weights: node, weight, 1 if there are none. A base whose free neighbours and itself weigh
    under least takes nobody and stays free: a later one may take it. Nodes without edges are the caller's: they lead if they weigh enough.
    A base of more links than most still goes through one task, with its links. Nodes up to after have decided before: they can only be taken.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("x")).union(edges.select("b", "a")).filter("u <> x").distinct()
    if weights is None:
        links = both.select("u", "x", F.lit(1).cast("long").alias("wu"), F.lit(1).cast("long").alias("wx"))
    else:
        side = lambda c: weights.select(F.col("node").alias(c), F.col("weight").cast("long").alias(f"w{c}"))
        links = both.join(side("u"), "u").join(side("x"), "x").select("u", "x", "wu", "wx")
    if after is not None:
        links = links.filter(F.col("u") > after)
    links, out, most = settled(links), None, most or MOST

    def strike(links: DataFrame, taken: DataFrame, closed) -> DataFrame:
        gone = taken.select("node")
        rest = links.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "x"), "x", "left_anti")
        return settled(closed(rest).select("u", "x", "wu", "wx"))

    def put(taken: DataFrame) -> None:
        nonlocal out
        out = taken if out is None else settled(out.unionByName(taken))

    alone = True
    while links.count() > most:
        if alone:
            taken, decided = first_of_two_links(links, least)
            links = strike(links, taken, lambda rest, d=decided: rest.join(d, "u", "left_anti"))
        else:
            border = first_open(links, most)
            taken = settled(one_task(links.filter(F.col("u") <= border), least))
            links = strike(links, taken, lambda rest, b=border: rest.filter(F.col("u") > b))
        put(taken)
        alone = not alone
    put(settled(one_task(links, least)))
    return out


def first_of_either(rows: DataFrame, most: int | None = None) -> DataFrame:
    """place of the rows (place, x, y), in order of place, that share neither x nor y with one chosen before; nulls share nothing.

    Rounds choose each row that comes first among the open ones of its x and of its y; every other round the first open rows in order, a
    bounded number, go through one task. Rows of one key are never paired.
    """
    most = most or MOST
    open_, out = settled(rows.select("place", "x", "y")), None

    def lone(df: DataFrame) -> DataFrame:
        """Null keys as keys of their own."""
        return df.withColumns({c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.concat(F.lit("row "), F.col("place").cast("string"))) for c in ("x", "y")})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(it)
        if parts:
            every = pd.concat(parts).sort_values("place")
            met: tuple[set, set] = (set(), set())
            chosen = []
            for p, x, y in zip(every.place.tolist(), every.x.tolist(), every.y.tolist(), strict=True):
                if x not in met[0] and y not in met[1]:
                    chosen.append(p)
                    met[0].add(x)
                    met[1].add(y)
            yield every[every.place.isin(chosen)]

    open_, alone = lone(open_), True
    kind = "place long, x string, y string"
    while open_.count() > most:
        if alone:
            least = [open_.groupBy(c).agg(F.min("place").alias(f"m{c}")) for c in ("x", "y")]
            chosen = settled(open_.join(least[0], "x").join(least[1], "y").filter("place = mx and place = my").select("place", "x", "y"))
            rest = open_
        else:
            border = open_.select("place").orderBy("place").limit(most).agg(F.max("place").alias("p")).head().p
            chosen = settled(open_.filter(F.col("place") <= border).coalesce(1).mapInPandas(run, kind))
            rest = open_.filter(F.col("place") > border)
        open_ = settled(rest.join(chosen.select("x"), "x", "left_anti").join(chosen.select("y"), "y", "left_anti").select("place", "x", "y"))
        out = chosen if out is None else settled(out.unionByName(chosen))
        alone = not alone
    last = settled(open_.coalesce(1).mapInPandas(run, kind))
    return (last if out is None else out.unionByName(last)).select("place")
