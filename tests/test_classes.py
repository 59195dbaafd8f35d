"""Queries over pairs on a table of many equal parts: as SQL has it, with pairs of classes instead of records."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__

COPIES = 30
QUERIES = [
    "er_quick_score",
    "er_validate_summary",
    "er_weighted_proba",
    "er_submission_brackets",
    "er_rule_v1_original",
    "er_set_sims",
    "er_fbeta_per_entity",
    "er_rule_eval_legacy",
    "er_jaro_winkler",
    "er_validate_subset",
    "er_rule_eval",
    "er_run_summary",
    "er_emergency_match",
]


@pytest.fixture(scope="module")
def at(tmp_path_factory):
    """Six kinds of part, 30 of each, and parts with missing values, repeated rows and one key for two parts."""
    at = tmp_path_factory.mktemp("parts")
    kinds = [("red bolt", "Brand#1", "LARGE", 1), ("red bolt", "Brand#1", "LARGE", 2), ("red bolt", "Brand#2", "LARGE", 1), ("blue ring", "Brand#1", "LARGE", 1), ("blue ring", "Brand#2", "SMALL", 1), ("cold plate co", "Brand#3", "SMALL", 7)]
    rows = [(k, *kind) for k, kind in enumerate(kinds * COPIES)]
    rows += [(900, None, "Brand#1", "LARGE", 1), (901, "red bolt", None, "LARGE", 1), (902, "red bolt", "Brand#1", None, 1), (903, "lone", "Brand#9", "SMALL", 9), (904, "lone", "Brand#8", "SMALL", 8)]
    con = duckdb.connect()
    con.execute("create table part (p_partkey bigint, p_name varchar, p_brand varchar, p_type varchar, p_size integer, p_retailprice double)")
    con.executemany("insert into part values (?, ?, ?, ?, ?, 1.0)", rows)
    con.execute(f"copy part to '{at}/part.parquet' (format parquet)")
    return str(at), con


def nodes(plan):
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        yield from nodes(plan.executedPlan())
    elif "QueryStage" in name:
        yield from nodes(plan.plan())
    else:
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))


def joined(found) -> int:
    """Rows of the largest join of a query that has run."""
    n = [p.metrics().apply("numOutputRows").value() for p in nodes(found._jdf.queryExecution().executedPlan()) if "Join" in p.nodeName() and p.metrics().contains("numOutputRows")]
    return max(n)


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_of_classes(spark, at, name):
    path, con = at
    found = __spark_entry__.queries()[name](spark, path)
    columns = sorted(found.columns)
    found = found.select(*columns)
    rows = sorted(repr(tuple(r)) for r in found.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        assert rows == sorted(repr(tuple(r)) for r in con.sql(f"select {', '.join(columns)} from ({sql})").fetchall())
    assert joined(found) < 500  # there are 3000 links and more


def test_ngrams_of_a_long_text(spark):
    """The time of n-grams grows with the text, not with its square."""
    import time

    from pyspark.sql import functions as F

    from kindred.functions import text as tx

    long = " ".join(f"w{i:05d}" for i in range(40_000))
    df = spark.createDataFrame([(long,), ("a😀b\nc",), (None,)], "t string")
    began = time.monotonic()
    found = [set(r[0]) for r in df.select(tx.ngrams(F.col("t"))).collect()]
    grams = lambda s: {s[i : i + n] for n in (2, 3) for i in range(len(s) - n + 1)}
    assert found == [grams(f" {long} "), grams(" a😀b\nc "), set()]
    assert time.monotonic() - began < 20
