"""Near-duplicates by MinHash: an LSH forest of several sorted signature orders.

Each tree orders the distinct shingle sets by the same signature with its functions in another sequence. Neighbours in that order
share the longest prefixes, and each set meets the REACH before and behind it that share the first DEPTH functions. The depth adapts to the
region: where more sets share a prefix than the reach holds, a set meets all those that share a longer one with it. The depth from which on
a tree loses nothing is noted for each set, and with it how much of a tree is lost to it; range borders count as lost. In a first pass each tree names
the best partner of each set; those are confirmed on the full sets, the best of all trees first. A second pass names every pair in reach that would still join two components, and confirms them all. Sets to which more than
WEAK tree is lost, and that share a region with another such set of another component, are joined at last on the rarest shingles of
their full sets (a prefix filter, which loses no pair).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import mix, ngrams, table, word_hashes, words, written
from strandline.llm.components import merged

SHINGLE, FUNCTIONS, TREES, DEPTH, REACH = 5, 64, 12, 3, 16
LEAST = 85  # percent of the union that must be shared
HOT = 2000  # sets of one shingle that meet in one place; more are dealt to pairs of blocks
AGREE = 42  # of the 64 functions; pairs at the threshold agree in 54 on average, with a deviation of 2.9
ROUNDS = 2  # in which each set tries its best partner, before all the others
WEAK = 1  # tree; the others are enough even where copies differ in just what sets them apart from a crowd
RANGE_ROWS = 20_000  # of an order, in a task

_rng = np.random.default_rng(20)
MULTIPLY = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _rng.integers(1, 2**63, FUNCTIONS, dtype=np.uint64)
ORDERS = np.stack([_rng.permutation(FUNCTIONS) for _ in range(TREES)])


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct five-word shingles; of fewer words, the whole sequence as one; of none, empty."""
    h = word_hashes(words(text))
    return np.unique(ngrams(h, min(SHINGLE, len(h)))) if len(h) else np.empty(0, np.uint64)


def set_key(s: np.ndarray) -> int | None:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64)) if len(s) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """16 bits of the smallest value of each function, [set, function]. Sets must not be empty."""
    x = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), FUNCTIONS), ">u2")
    for k in range(FUNCTIONS):
        out[:, k] = mix(np.minimum.reduceat(x * MULTIPLY[k] + ADD[k], at)) >> np.uint64(48)
    return out


def signed_sets(docs: DataFrame) -> DataFrame:
    """d, n, node, sig of documents d, t. node: the set's key, null for an empty set."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                sets = [shingle_set(t) for t in part.t]
                some = [s for s in sets if len(s)]
                sig = iter(signatures(some)) if some else iter(())
                yield pd.DataFrame({"d": part.d, "n": [len(s) for s in sets], "node": pd.array([set_key(s) for s in sets], "Int64"), "sig": [next(sig).tobytes() if len(s) else None for s in sets]})

    return docs.mapInPandas(run, "d long, n long, node long, sig binary")


PAIRS = "a long, b long, agree int"


def sorted_orders(sets: DataFrame) -> DataFrame:
    """Distinct sets (node, n, sig, root) in the order of each tree, over ranges of it."""

    def plant(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf.sig), ">u2").reshape(len(pdf), FUNCTIONS)
                for t in range(TREES):
                    yield pd.DataFrame({"tree": t, "sequence": [x.tobytes() for x in sig[:, ORDERS[t]]], "node": pdf.node, "n": pdf.n, "root": pdf.root})

    planted = sets.select("node", "n", "sig", "root").mapInPandas(plant, "tree int, sequence binary, node long, n long, root long")
    ranges = max(1, -(-sets.count() * TREES // RANGE_ROWS))
    return planted.repartitionByRange(ranges, "tree", "sequence").sortWithinPartitions("tree", "sequence", "node")


def covered(pdf: pd.DataFrame) -> np.ndarray:
    """For each row of an order with a row of context on either side: how many functions a set must share with it to be in its reach for sure.

    That is one more than it shares with the first set beyond the reach; rows without one before or behind them in the range are lost (FUNCTIONS).
    """
    sig = np.frombuffer(b"".join(pdf.sequence), ">u2").reshape(len(pdf), FUNCTIONS)
    tree = pdf.tree.to_numpy()
    k = REACH + 1
    beyond = np.full(len(pdf), FUNCTIONS)
    if len(pdf) > k:
        same = (sig[k:] == sig[:-k]) & (tree[k:] == tree[:-k])[:, None]
        shared = np.where(same.all(1), FUNCTIONS, same.argmin(1))
        beyond[:] = 0
        beyond[k:] = shared
        beyond[:-k] = np.maximum(beyond[:-k], shared)
        beyond[:k] = beyond[-k:] = FUNCTIONS
    return np.minimum(beyond + 1, FUNCTIONS)


def candidates(pdf: pd.DataFrame, fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Positions i, j of rows in reach of each other, in one region and of different roots, and how many functions agree; j from fresh on."""
    sig = np.frombuffer(b"".join(pdf.sequence), ">u2").reshape(len(pdf), FUNCTIONS)
    tree, n, root = pdf.tree.to_numpy(), pdf.n.to_numpy(), pdf.root.to_numpy()
    for k in range(1, min(REACH, len(pdf) - 1) + 1):
        j = np.arange(max(k, fresh), len(pdf))
        i = j - k
        near = (tree[i] == tree[j]) & (root[i] != root[j]) & (sig[i, :DEPTH] == sig[j, :DEPTH]).all(1) & (100 * np.minimum(n[i], n[j]) >= LEAST * np.maximum(n[i], n[j]))
        i, j = i[near], j[near]
        agree = (sig[i] == sig[j]).sum(1)
        good = agree >= AGREE
        yield i[good], j[good], agree[good]


def ordered_pairs(a: np.ndarray, b: np.ndarray, agree: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "agree": agree.astype(np.int32)})


FOREST = "a long, b long, agree int, loss double"


def first_pass(sets: DataFrame) -> DataFrame:
    """The pair (a, b, agree) of each set and its best partner in each tree, and the lost part of each tree that covers a set a at more than DEPTH only."""

    def rows(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        some = pdf[pdf.best > 0]
        yield ordered_pairs(some.node.to_numpy(), some.partner.to_numpy(), some.best.to_numpy()).assign(loss=np.nan)
        deep = pdf[pdf.cover > DEPTH]
        loss = 1 - np.log1p(-((LEAST / 100) ** deep.cover.to_numpy())) / np.log1p(-((LEAST / 100) ** DEPTH))
        yield pd.DataFrame({"a": deep.node, "b": pd.array([None] * len(deep), "Int64"), "agree": pd.array([None] * len(deep), "Int32"), "loss": loss})

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in it:
            pdf = pdf.assign(best=0, partner=pdf.node, cover=0)
            fresh = len(rest) if rest is not None else 0
            pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
            node, best, partner = pdf.node.to_numpy(), pdf.best.to_numpy().copy(), pdf.partner.to_numpy().copy()
            for i, j, agree in candidates(pdf, fresh):
                for x, y in ((i, j), (j, i)):  # each x is there once at most
                    up = agree > best[x]
                    best[x[up]], partner[x[up]] = agree[up], node[y[up]]
            # rows of the batch before have their cover but for the last ones, which were at an end then
            cover = covered(pdf)
            old = pdf.cover.to_numpy()
            known = np.arange(len(pdf)) < fresh - REACH - 1
            pdf = pdf.assign(best=best, partner=partner, cover=np.where(known, old, cover))
            cut = max(0, len(pdf) - 2 * REACH - 2)
            yield from rows(pdf.iloc[:cut])
            rest = pdf.iloc[cut:]
        if rest is not None:
            yield from rows(rest)

    return sorted_orders(sets).mapInPandas(run, FOREST)


def open_pairs_of(sets: DataFrame) -> DataFrame:
    """Every pair (a, b, agree) in reach whose sets have different roots."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in it:
            fresh = len(rest) if rest is not None else 0
            pdf = pd.concat([rest, pdf], ignore_index=True) if rest is not None else pdf
            node = pdf.node.to_numpy()
            for i, j, agree in candidates(pdf, fresh):
                yield ordered_pairs(node[i], node[j], agree)
            rest = pdf.iloc[-REACH:]

    return sorted_orders(sets).mapInPandas(run, PAIRS).distinct()


def crowded_sets(thin: DataFrame) -> DataFrame:
    """node, root of those sets (node, sig, root), all thinly covered, that share a region of some tree with another of a different root.

    A pair of which one is well covered meets in the reach of that one, so the others need not be looked at.
    """

    def plant(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            if len(pdf):
                sig = np.frombuffer(b"".join(pdf.sig), ">u2").reshape(len(pdf), FUNCTIONS)
                for t in range(TREES):
                    region = np.full(len(pdf), t, np.int64)
                    for k in ORDERS[t, :DEPTH]:
                        region = region << 16 | sig[:, k].astype(np.int64)
                    yield pd.DataFrame({"region": region, "node": pdf.node, "root": pdf.root})

    rows = thin.select("node", "sig", "root").mapInPandas(plant, "region long, node long, root long")
    runs = rows.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    # written, so that a region as large as a third of all sets can be split in the join
    open_runs = written(runs.filter("low < high").select("region"), "regions")
    return rows.join(open_runs, "region", "left_semi").select("node", "root").distinct()


def crowded_pairs(full: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (a, b) of full sets (node, members) that can share enough and have different roots (node, root): all of those that do share enough.

    In any order of all shingles, two such sets have one in common among the first n - 0.85 n + 1 of each. Here the order is rarest first.
    """

    def shingles(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 1000):
                sets = [np.frombuffer(m, np.uint64) for m in pdf.members[i : i + 1000]]
                n = np.array([len(x) for x in sets], np.int64)
                yield pd.DataFrame({"node": np.repeat(pdf.node[i : i + 1000].to_numpy(), n), "n": np.repeat(n, n), "s": np.concatenate(sets).view(np.int64)})

    each = full.mapInPandas(shingles, "node long, n long, s long").join(roots, "node")
    # shingles of one root alone come first in the order and lead to no pair
    counts = each.groupBy("s").agg(F.count("*").alias("k"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("s", "k")
    ranked = each.join(counts, "s").groupBy("node", "n", "root").agg(F.array_sort(F.collect_list(F.struct("k", "s"))).alias("x"))
    ranked = ranked.withColumn("alone", F.col("n") - F.size("x")).withColumn("room", F.expr(f"n - ({LEAST} * n + 99) div 100 + 1 - alone"))
    heads = ranked.filter("room > 0").select("node", "n", "root", "alone", F.posexplode(F.slice("x", 1, F.col("room").cast("int"))).alias("place", "x"))
    # left: how many shingles of the set are not before this one
    heads = heads.select("node", "n", "root", "x.s", (F.col("n") - F.col("alone") - F.col("place")).alias("left"), F.ceil(F.col("x.k") / HOT).alias("blocks"))
    heads = written(heads.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")), "heads")
    dealt = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    x = heads.withColumn("over", dealt).select("s", F.col("block").alias("p"), F.col("over").alias("q"), *(F.col(c).alias(f"a_{c}") for c in ("node", "n", "root", "left")))
    y = heads.withColumn("over", dealt).select("s", F.col("over").alias("p"), F.col("block").alias("q"), *(F.col(c).alias(f"b_{c}") for c in ("node", "n", "root", "left")))
    near = x.join(y, ["s", "p", "q"]).filter("a_node < b_node and a_root <> b_root").filter(f"{100 + LEAST} * least(a_left, b_left) >= {LEAST} * (a_n + b_n)").filter(f"100 * least(a_n, b_n) >= {LEAST} * greatest(a_n, b_n)")
    return near.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets (node, members) share enough."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            keep = []
            for x, y in zip(pdf.x, pdf.y, strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= LEAST * (len(both) - shared))
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    side = lambda c, m: full.select(F.col("node").alias(c), F.col("members").alias(m))
    return pairs.select("a", "b").join(side("a", "x"), "a").join(side("b", "y"), "b").mapInPandas(run, "a long, b long")


def owners_of(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """d, n, node of documents (d, t), and key, smallest: of each set the smallest d of its component."""
    signed = written(signed_sets(docs), "signatures")
    sets = written(signed.filter("node is not null").groupBy("node").agg(F.min("d").alias("d"), F.min("n").alias("n"), F.min("sig").alias("sig")), "sets")
    # a smaller set is too far even from one that holds it and one shingle more
    large = sets.filter(100 * F.col("n") >= LEAST * (F.col("n") + 1))
    forest = written(first_pass(large.withColumn("root", F.col("node"))), "forest")
    pairs = forest.filter("b is not null").groupBy("a", "b").agg(F.max("agree").alias("agree"))
    pairs = written(pairs, "pairs")
    thin = forest.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("loss").alias("loss")).filter(F.col("loss") > WEAK).select("node")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()

    def unfold(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for i in range(0, len(pdf), 1000):
                s = [shingle_set(t) for t in pdf.t[i : i + 1000]]
                yield pd.DataFrame({"node": pd.array([set_key(x) for x in s], "Int64"), "members": [x.tobytes() for x in s]})

    def full_sets(nodes: DataFrame) -> DataFrame:
        chosen = sets.join(nodes, "node", "left_semi").select(F.col("d").alias("c")).distinct()
        unfolded = docs.join(chosen, F.col("d") == F.col("c"), "left_semi").select("t").mapInPandas(unfold, "node long, members binary")
        return written(unfolded.dropDuplicates(["node"]), "members")

    full = full_sets(nodes)
    roots = large.select("node", F.col("node").alias("root"))
    root = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    for turn in range(ROUNDS + 1):
        if turn < ROUNDS:
            both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
            best = both.groupBy("a").agg(F.max(F.struct("agree", F.col("b"))).alias("best")).select("a", F.col("best.b").alias("b"))
            tried = written(best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "tried")
        else:
            # sets without a partner in the first pass have none in reach
            tried = written(open_pairs_of(large.join(nodes, "node", "left_semi").join(roots, "node").select("node", "n", "sig", "root")), "pairs")
        if tried.isEmpty():
            continue
        roots = merged(roots, written(confirmed(tried, full), "links"))
        if turn < ROUNDS - 1:
            left = pairs.join(tried, ["a", "b"], "left_anti").join(root("a"), "a").join(root("b"), "b")
            pairs = written(left.filter("a_root <> b_root").select("a", "b", "agree"), "pairs")
    if not thin.isEmpty():
        crowd = written(crowded_sets(large.join(thin, "node", "left_semi").join(roots, "node").select("node", "sig", "root")), "crowd")
        full = full_sets(crowd.select("node")).join(crowd.select("node"), "node", "left_semi")  # rows of one id may bring sets of others
        roots = merged(roots, written(confirmed(written(crowded_pairs(full, crowd), "pairs"), full), "links"))
    owners = sets.select("node", "d").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = owners.groupBy("root").agg(F.min("d").alias("smallest"))
    # joined on the root, a group of near copies is as hot as it is large; both sides are exchanged as they are, so that Spark can split it
    return signed.select("d", "n", "node"), written(owners.join(smallest, "root").select(F.col("node").alias("key"), "smallest"), "owners")


def with_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).filter("d is not null")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document: linked if 100 * shared >= 85 * union of their shingle sets.

    Null and empty texts have no shingles and are linked with nothing. Rows of one id count each for itself; rows without an id
    are left out. Of each component the smallest id is kept.
    """
    signed, owners = owners_of(with_id(docs, id_col, text_col))
    named = signed.join(owners, F.col("node") == F.col("key"), "left")
    component = F.coalesce("smallest", "d")
    return named.select(F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("d") == component).alias("kept"))


def kept_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, once each, of the documents that near_components keeps; documents don't meet their group for it."""
    signed, owners = owners_of(with_id(docs, id_col, text_col))
    return owners.select(F.col("smallest").alias("doc_id")).unionByName(signed.filter("node is null").select(F.col("d").alias("doc_id"))).distinct()


def op2_lsh_forest(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_components(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM shared JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT x AS doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(y) AS component_id, x = min(y) AS kept
FROM reach LEFT JOIN n ON n.doc_id = x GROUP BY x
"""
