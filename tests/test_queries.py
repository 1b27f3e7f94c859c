"""Every registered query of the engine against its SQL, and the driver's entry points."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tidegauge.plans import catalog

from .oracle_tools import compare

REPO = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_is_its_sql(spark, small, name):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLE_SQL[name], small) == []


@pytest.mark.parametrize("name", sorted(catalog.QUERIES.keys() - catalog.ORACLE_SQL.keys()))
def test_query_without_sql_is_the_same_twice(spark, small, name):
    first, second = (sorted(map(str, catalog.QUERIES[name](spark, small).collect())) for _ in range(2))
    assert first and first == second


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert catalog.QUERIES.keys() <= entry.queries().keys()


def test_the_entry_works_without_the_optional_subpackage(tmp_path):
    """In a copy without llm and the pipeline the module still imports and has the other queries."""
    import shutil

    shutil.copytree(REPO / "tidegauge", tmp_path / "tidegauge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ":".join(p for p in sys.path if p and p != str(REPO))})
    assert said.stdout.split() == [str(len(catalog.QUERIES)), str(len(catalog.ORACLE_SQL))], said.stderr
