"""Every query with an SQL version against it, on the smallest tables."""

from __future__ import annotations

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, tables, name):
    found = __spark_entry__.queries()[name](spark, SF)
    want = tables.sql(SQL[name])
    assert sorted(found.columns) == sorted(want.columns)
    columns = sorted(found.columns)
    rows = sorted(repr(tuple(r)) for r in found.select(*columns).collect())
    assert rows == sorted(repr(tuple(r)) for r in tables.sql(f"select {', '.join(columns)} from ({SQL[name]})").fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 8


@pytest.mark.parametrize("gone", ["kindred.llm.queries", "corpus_pipeline", "zstandard"])
def test_entry_without_the_subpackage(monkeypatch, gone):
    """The other queries are there when the operators for training data, what they need, or the pipeline are not."""
    there = "op8_mixing" in __spark_entry__.queries()
    for name in [m for m in sys.modules if m.startswith(("kindred.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, gone, None)
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert "er_rule_eval" in names and "pipeline" not in names and ("op8_mixing" in names) == (there and gone == "corpus_pipeline")
    assert set(entry.oracle_sql()) <= names
