"""Connected components by alternating stars, and joins whose large side may have hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import stored

#: Parts into which the rows of each key of a large side are dealt.
SALTS = 16


def salted_join(large: DataFrame, small: DataFrame, key: str, by: Column, how: str = "inner") -> DataFrame:
    """large joined to small on key, where one key may hold much of large but few rows of small: its rows go to SALTS tasks."""
    dealt = large.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    return dealt.join(copies, [key, "_salt"], how).drop("_salt")


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) linked to the smallest of all, itself included."""
    one = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = one.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = salted_join(both, least, "u", F.col("v"))
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    if not large:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): of every node on an edge (a, b), the smallest node that it reaches.

    Large and small stars in turn, until a round changes nothing; each round's edges are a stored table.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    sign = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = sign(now)
    while before[0]:
        now = stored(_stars(_stars(now, large=True), large=False), "edges")
        after = sign(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
