"""Small tables with what corpora hold: nulls, empty and long texts, ties, repeated rows, extra columns of clashing names."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

WORDS = [f"word{i}" for i in range(300)]


def text(seed, n):
    import random

    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    base, other = text(1, 120), text(2, 60)
    near = base.split()
    near[60] = "changed"
    rows = [
        (1, base), (2, base.upper()), (3, " ".join(near)), (4, other), (5, other + "\n" + other), (6, None), (7, ""), (8, "  \t\n"), (9, "one two"), (10, "one two"),
        (11, text(3, 30) + " " + " ".join(base.split()[20:70]) + " " + text(4, 30)), (12, "x " * 500), (13, text(5, 6000)), (14, "Été ÀÉÎ ünïcode " * 10), (15, "word " * 19), (16, text(6, 20)), (17, text(6, 20)),
    ]
    return [(i, t, "doc", None, "text", 5.0) for i, t in rows]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """Names that the operators use inside stand as columns of the input."""
    return spark.createDataFrame(odd_rows, "doc_id long, text string, t string, d string, component_id string, score double").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
