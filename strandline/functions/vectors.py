"""Vector expressions on array columns; sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.text import Name, col


def dot(a: Name, b: Name) -> Column:
    products = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Name) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Name) -> Column:
    """Unit vector; a zero vector stays as it is, null stays null."""
    n = norm(a)
    return F.when(n > 0, F.transform(col(a), lambda x: x.cast("double") / n)).otherwise(F.transform(col(a), lambda x: x.cast("double")))


def cosine(a: Name, b: Name) -> Column:
    """Null if either vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
