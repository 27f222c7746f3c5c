"""Every query of the catalogue against its SQL; those without SQL run, and other tests hold them against plain versions."""

import os
import subprocess
import sys

import pytest
from compare import by_spark, by_sql

from strandline.plans.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, name):
    assert by_spark(QUERIES[name](spark, sf_dir)) == by_sql(sf_dir, ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    columns, rows = by_spark(QUERIES[name](spark, sf_dir))
    assert columns and rows


def test_import_needs_no_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 0)"], cwd=root, capture_output=True, text=True, check=True)
    assert said.stdout.strip() == "True"


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
