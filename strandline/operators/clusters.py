"""Assignment of vectors to strategic prototypes, with a fallback for what is near to none."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline import constants as K
from strandline.operators.similarity import stacked

MOST_PROTOTYPES = 1000


def assign_clusters(items: DataFrame, prototypes: list[tuple[str, list[float]]], threshold: float = K.STRATEGIC_THRESHOLD, vector: str = "embedding") -> DataFrame:
    """id, cluster_name, score, is_other: the nearest prototype, the first of equals, if near enough; else Other with the best score.

    Null and zero vectors are left out. Without prototypes all go to Other with 0. Prototypes are a short list, which goes to every task.
    """
    if len(prototypes) > MOST_PROTOTYPES:
        raise ValueError("too many prototypes for a list; use match_to_macros")
    rows = items.select("id", F.col(vector).cast("array<float>").alias("_v")).filter("_v is not null")
    names = np.array([n for n, _ in prototypes] + [K.OTHER], object)
    matrix = stacked(pd.Series([v for _, v in prototypes])) if prototypes else None

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            m = stacked(pdf._v)
            pdf, m = pdf[m.any(1)], m[m.any(1)]
            s = m @ matrix.T if matrix is not None else np.full((len(m), 1), 0.0)
            at = np.round(s, 12).argmax(1) if len(m) else np.zeros(0, int)
            score = s[np.arange(len(m)), at]
            near = (score >= threshold) if matrix is not None else np.zeros(len(m), bool)
            yield pd.DataFrame({"id": pdf.id, "cluster_name": names[np.where(near, at, len(prototypes))], "score": score, "is_other": ~near})

    kind = items.schema["id"].dataType.simpleString()
    return rows.mapInPandas(run, f"id {kind}, cluster_name string, score double, is_other boolean")


def assign_unassigned(items: DataFrame, prototypes, threshold: float = K.STRATEGIC_THRESHOLD, ids: list[int] | None = None, vector: str = "embedding") -> DataFrame:
    """Only items without a cluster, of the ids if some are given."""
    todo = items.filter("cluster_id is null")
    return assign_clusters(todo if ids is None else todo.filter(F.col("id").isin(ids)), prototypes, threshold, vector)


def assign_with_changes(items: DataFrame, clusters: DataFrame, prototypes, threshold: float = K.STRATEGIC_THRESHOLD, vector: str = "embedding", only_changed: bool = False) -> DataFrame:
    """Assignments with old_name, is_new (had none) and is_changed."""
    names = clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("old_name"))
    old = items.select("id", "cluster_id").join(names, "cluster_id", "left").select("id", "old_name")
    out = assign_clusters(items, prototypes, threshold, vector).join(old, "id")
    out = out.withColumns({"is_new": F.col("old_name").isNull(), "is_changed": ~F.col("old_name").eqNullSafe(F.col("cluster_name"))})
    return out.filter("is_changed") if only_changed else out


def reassign_other(items: DataFrame, clusters: DataFrame, prototypes, threshold: float, vector: str = "embedding") -> DataFrame:
    """The members of Other, assigned anew."""
    other = clusters.filter(F.col("name") == K.OTHER).select(F.col("id").alias("cluster_id"))
    return assign_clusters(items.join(other, "cluster_id", "left_semi"), prototypes, threshold, vector)


def assign_orphans(units: DataFrame, prototypes, threshold: float = K.STRATEGIC_THRESHOLD, vector: str = "embedding") -> DataFrame:
    """Units without a macro, whether they have a cluster or not."""
    return assign_clusters(units.filter("macro_insight_id is null"), prototypes, threshold, vector)


def prototype_list(rows: DataFrame, name: str = "name", vector: str = "embedding", order: str = "place") -> list[tuple[str, list[float]]]:
    """Prototypes of a short table, in order."""
    got = rows.orderBy(order).select(name, vector).limit(MOST_PROTOTYPES + 1).collect()
    if len(got) > MOST_PROTOTYPES:
        raise ValueError("too many prototypes for a list")
    return [(r[0], [float(x) for x in r[1]]) for r in got]
