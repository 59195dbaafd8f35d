"""Exact rules: pairs of one country with equal keys, some only by keys that one target has."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_country, norm_key
from .classes import Classes, weight, weights

#: Rule: (compared keys, whether only one target may have them); several are alternatives.
RULES: dict[str, list[tuple[tuple[str, ...], bool]]] = {
    "FULL_EXACT_UNIQUE": [(("name", "addr"), True)],
    "NAME_UNIQUE": [(("name",), True)],
    "ADDRESS_UNIQUE": [(("addr",), True)],
    "NAME_AND_ADDRESS": [(("name", "addr"), False)],
    "V1_ORIGINAL": [(("name",), False), (("addr",), False)],
    "NAME_ONLY": [(("name",), False)],
    "ADDRESS_ONLY": [(("addr",), False)],
    "NAME_UNIQUE_OR_ADDRESS_UNIQUE": [(("name",), True), (("addr",), True)],
}


def normalised(records: DataFrame, sep: str = "") -> DataFrame:
    """(entity_id, source, ord, name, addr, country) by the key norm with sep for other characters; of classes also weight."""
    return records.select("entity_id", "source", "ord", *[c for c in records.columns if c == "weight"], norm_key(F.col("business_name"), sep).alias("name"), norm_key(F.col("business_address"), sep).alias("addr"), norm_country(F.col("country")).alias("country"))


def multiplicity(targets: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """How many targets have each key of a country; one aggregate, no window over every row."""
    return targets.groupBy("country", *keys).agg(F.count(F.lit(1)).alias("n"))


def _one(norm: DataFrame, keys: tuple[str, ...], unique: bool) -> DataFrame:
    filled = reduce(lambda a, b: a & b, [F.col(k) != "" for k in ("country", *keys)])
    one = norm.where("source = 1").where(filled).select(F.col("entity_id").alias("s1_id"), "country", *keys)
    two = norm.where("source > 1").where(filled)
    if unique:
        two = two.groupBy("country", *keys).agg(F.min("entity_id").alias("target_id"), F.sum(weight(two)).alias("n")).where("n = 1").drop("n")
    else:
        two = two.select(F.col("entity_id").alias("target_id"), "country", *keys)
    return one.join(two, ["country", *keys]).select("s1_id", "target_id")


def matches(norm: DataFrame, rule: str) -> DataFrame:
    """(s1_id, target_id) of a rule, each pair once. Alternatives are joins of their own: an OR in a join has no key."""
    parts = [_one(norm, keys, unique) for keys, unique in RULES[rule]]
    return reduce(DataFrame.union, parts).distinct()


def _flagged(norm: DataFrame, key: str, rules: list[str]) -> DataFrame:
    """(rule, s1_id, target_id) of all rules' alternatives that compare this key, from one join on it.

    The counts of equal targets, by this key and by both, go to the entities' side, so no task sees all rows of a key.
    """
    other = "addr" if key == "name" else "name"
    filled = (F.col("country") != "") & (F.col(key) != "")
    targets = norm.where("source > 1").where(filled)
    both = targets.groupBy("country", key, F.col(other).alias("_mine")).agg(F.sum(weight(targets)).alias("_both"))
    alone = both.groupBy("country", key).agg(F.sum("_both").alias("_n"))
    one = norm.where("source = 1").where(filled).select(F.col("entity_id").alias("s1_id"), "country", key, F.col(other).alias("_mine"))
    one = one.join(alone, ["country", key]).join(both, ["country", key, "_mine"], "left")
    two = targets.select(F.col("entity_id").alias("target_id"), "country", key, other)
    holds = []
    for rule in rules:
        for keys, unique in RULES[rule]:
            if keys == (key,):
                holds.append(F.when((F.col("_n") == 1) if unique else F.lit(True), F.lit(rule)))
            elif key == "name" and len(keys) == 2:
                same = (F.col("_mine") == F.col(other)) & (F.col(other) != "")
                holds.append(F.when(same & ((F.col("_both") == 1) if unique else F.lit(True)), F.lit(rule)))
    pairs = one.join(two, ["country", key])
    return pairs.select(F.explode(F.filter(F.array(*holds), lambda x: x.isNotNull())).alias("rule"), "s1_id", "target_id") if holds else pairs.select(F.lit("").alias("rule"), "s1_id", "target_id").limit(0)


def all_matches(norm: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """(rule, s1_id, target_id) of several rules: two joins whatever their number, one by name and one by address."""
    rules = rules or list(RULES)
    return _flagged(norm, "name", rules).unionByName(_flagged(norm, "addr", rules)).distinct()


def strongest(norm: DataFrame) -> DataFrame:
    """(s1_id, target_id, strength): 2 by name, 1 by address only."""
    both = _one(norm, ("name",), False).withColumn("strength", F.lit(2)).unionByName(_one(norm, ("addr",), False).withColumn("strength", F.lit(1)))
    return both.groupBy("s1_id", "target_id").agg(F.max("strength").alias("strength"))


def run_summary(entities: DataFrame, links: DataFrame) -> DataFrame:
    """s1_rows, match_links, s1_with_matches, in one row."""
    flags = entities.select(F.lit(1).alias("e"), F.lit(None).cast("string").alias("s1_id")).unionByName(links.select(F.lit(0).alias("e"), "s1_id"))
    return flags.agg(F.coalesce(F.sum("e"), F.lit(0)).alias("s1_rows"), F.count("s1_id").alias("match_links"), F.countDistinct("s1_id").alias("s1_with_matches"))


def run_summary_of_classes(classes: Classes, links: DataFrame) -> DataFrame:
    """run_summary by the sizes of the classes that links join."""
    links = links.join(weights(classes, "target_id"), "target_id").groupBy("s1_id").agg(F.sum("weight").alias("links"))
    rows = classes.records.where("source = 1").groupBy(F.col("entity_id").alias("s1_id"), "weight").agg(F.count(F.lit(1)).alias("rows"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    n = F.col("weight")
    return rows.join(links, "s1_id", "left").agg(total(n * F.col("rows")).alias("s1_rows"), total(n * F.col("links")).alias("match_links"), total(F.when(F.col("links").isNotNull(), n)).alias("s1_with_matches"))
