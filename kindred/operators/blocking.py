"""Candidates by four keys: whole canonical name or address, and their first letters within a country."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import canonical_address, canonical_name, norm_country, prefix

#: Key types and what a match by each counts.
SCORES = {"name": 100, "addr": 90, "country_name": 60, "country_addr": 50}


def keyed(records: DataFrame) -> DataFrame:
    """(entity_id, ord, key_type, key, key_score): up to four rows of each record, from one pass."""
    r = records.select("entity_id", "ord", canonical_name("business_name").alias("n"), canonical_address("business_address").alias("a"), norm_country(F.col("country")).alias("c"))
    within = lambda c: F.when((F.col("c") != "") & (c != ""), F.concat(F.col("c"), F.lit("|"), prefix(c)))
    found = {"name": F.col("n"), "addr": F.col("a"), "country_name": within(F.col("n")), "country_addr": within(F.col("a"))}
    keys = F.array(*[F.struct(F.lit(k).alias("key_type"), v.alias("key"), F.lit(SCORES[k]).alias("key_score")) for k, v in found.items()])
    return r.select("entity_id", "ord", F.explode(F.filter(keys, lambda k: k["key"] != "")).alias("k")).select("entity_id", "ord", "k.*")


def capped(keys: DataFrame, cap: int = 200) -> DataFrame:
    """The first cap rows of each key in ord. Only these take part in the join: the cap is part of the result."""
    w = Window.partitionBy("key_type", "key").orderBy("ord")
    return keys.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def scored(entities: DataFrame, targets: DataFrame, cap: int = 200) -> DataFrame:
    """(s1_id, target_id, score, ord): each pair that shares a key, with its best key's score."""
    index = capped(keyed(targets), cap).select("key_type", "key", F.col("entity_id").alias("target_id"), "ord", "key_score")
    probes = keyed(entities).select("key_type", "key", F.col("entity_id").alias("s1_id"))
    pairs = probes.join(index, ["key_type", "key"]).where("s1_id <> target_id")
    return pairs.groupBy("s1_id", "target_id").agg(F.max("key_score").alias("score"), F.min("ord").alias("ord"))


def top(pairs: DataFrame, k: int = 50) -> DataFrame:
    """Adds rank: the k best of each entity; of equal scores the first in ord."""
    w = Window.partitionBy("s1_id").orderBy(F.desc("score"), "ord")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def candidates(entities: DataFrame, targets: DataFrame, k: int = 50, cap: int = 200) -> DataFrame:
    return top(scored(entities, targets, cap), k)


def candidates_per_entity(entities: DataFrame, found: DataFrame) -> DataFrame:
    """min, avg, max and total of candidates; entities without any count as 0."""
    n = found.groupBy("s1_id").agg(F.count(F.lit(1)).alias("n"))
    per = entities.select(F.col("entity_id").alias("s1_id")).join(n, "s1_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(F.min("n").alias("min_candidates"), F.avg("n").alias("avg_candidates"), F.max("n").alias("max_candidates"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_candidates"))


def blocking_recall(entities: DataFrame, found: DataFrame, truth: DataFrame) -> DataFrame:
    """recall_ceiling (1 without truth), avg_candidates, total_candidates, total_truth, found, in one row."""
    pairs = truth.select("s1_id", "target_id").distinct()
    hit = pairs.join(found.select("s1_id", "target_id", F.lit(1).alias("hit")), ["s1_id", "target_id"], "left")
    one = hit.agg(F.count(F.lit(1)).alias("total_truth"), F.count("hit").alias("found"))
    two = candidates_per_entity(entities, found).select("avg_candidates", "total_candidates")
    recall = F.when(F.col("total_truth") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("total_truth"))
    return one.crossJoin(two).select(recall.alias("recall_ceiling"), "avg_candidates", "total_candidates", "total_truth", "found")
