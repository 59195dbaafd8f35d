"""A training corpus from `documents`: toxic texts out, copies out, near copies out, sources mixed, encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import exact, mixing, pieces, shingles, toxicity
from kindred.llm.queries import MODEL
from kindred.llm.session import scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The classifier learns from the labelled rows of `documents`; what it predicts toxic goes."""
    return toxicity.clean(docs, toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact.deduplicated(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return shingles.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document comes as often as the mix takes it; of one taken in part come the first words."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, MODEL)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("shingle_join", drop_near_copies), ("mixing", mix_sources), ("pieces", encode)]

#: No SQL computes the toxicity stage; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, at = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
