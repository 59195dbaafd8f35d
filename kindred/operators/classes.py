"""Classes of records that nothing tells apart: pairs are formed of classes, and spread to the records last."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a class that lie in one row, so that a large class is spread by many tasks.
PART = 256


@dataclass(frozen=True)
class Classes:
    """records: as records, with a class (its least id) as entity_id, source 1 or 2 (other ones 0), and weight, the entities in it.

    members: (cls, part, ids), each entity in one class.
    """

    records: DataFrame
    members: DataFrame


def classed(records: DataFrame, known: str | None = None) -> Classes:
    """Entities of equal rows are a class. Rows of one id belong together, so an id is in one class; a class has as many rows.

    known: a column more that tells records apart.
    """
    side = F.when(F.col("source") == 1, 1).when(F.col("source") > 1, 2).otherwise(0)
    fields = ["business_name", "business_address", "country", *([known] if known else [])]
    entities = records.where(F.col("entity_id").isNotNull()).groupBy("entity_id", side.alias("source")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows"))
    kinds = entities.groupBy("source", "rows").agg(F.min("entity_id").alias("cls"), F.count(F.lit(1)).alias("weight"))
    #: Always true; both columns stay, so plans that need one of them share this exchange.
    kinds = kinds.where(F.col("cls").isNotNull() & (F.col("weight") > 0))
    rows = kinds.select(F.col("cls").alias("entity_id"), "source", F.lit(0).cast("long").alias("ord"), "weight", F.explode("rows").alias("r"))
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("weight") / PART))
    members = entities.join(kinds, ["source", "rows"]).groupBy("cls", part.alias("part")).agg(F.collect_list("entity_id").alias("ids"))
    return Classes(rows.select("entity_id", "source", "ord", "weight", *[F.col(f"r.{f}").alias(f) for f in fields]), members)


def weight(df: DataFrame):
    """How many a row stands for: its weight, 1 without the column."""
    return F.col("weight") if "weight" in df.columns else F.lit(1)


def weights(classes: Classes, name: str) -> DataFrame:
    """(name, weight) of each class."""
    return classes.records.select(F.col("entity_id").alias(name), "weight").distinct()


def known_links(classes: Classes, known: str) -> DataFrame:
    """(s1_id, target_id, weight) of classes that agree in a column; weight: the entities of the target."""
    there = classes.records.where(F.col(known).isNotNull())
    one = there.where("source = 1").select(F.col("entity_id").alias("s1_id"), known)
    return one.join(there.where("source <> 1").select(F.col("entity_id").alias("target_id"), "weight", known), known).select("s1_id", "target_id", "weight").distinct()


def spread(rows: DataFrame, classes: Classes, *columns: str) -> DataFrame:
    """rows for each entity of the classes in these columns."""
    rest = [c for c in rows.columns if c not in columns]
    keys = []
    for c in columns:
        rows = rows.join(classes.members.select(F.col("cls").alias(c), F.col("part").alias(f"_part_{c}"), F.col("ids").alias(f"_ids_{c}")), c)
        keys += [c, f"_part_{c}"]
    #: A few rows give many, so they are dealt out before that.
    spark = rows.sparkSession
    rows = rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
    for i, c in enumerate(columns):
        rows = rows.select(*rest, *columns[:i], *[f"_ids_{x}" for x in columns[i + 1 :]], F.explode(f"_ids_{c}").alias(c))
    return rows.select(*columns, *rest)
