"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import numbered, stored

WORD = r"[^\x20\x09-\x0D]+"
#: Words of a block, and about how many words and documents a shard holds at most; a shard is what one window task sorts.
BLOCK_WORDS, SHARD_WORDS, SHARD_ROWS = 64, 1 << 20, 1 << 15


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to the same with target: shares by repeating weights, none above most times its size.

    With sources in rising order of cap per weight, the capped ones are a prefix; the level that the others share is
    the first one that doesn't exceed the next source's cap. That is where resharing the excess ends.
    """
    every = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("place"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = (
        sizes.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn("level", (F.col("total") - F.col("before")) / F.col("left"))
        .withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "place", "level")))
        .withColumn("common", F.min("fits").over(every)["level"])
    )
    return ranked.select(*sizes.columns, "place", F.least("cap", F.coalesce(F.col("common") * F.col("weight"), F.col("cap"))).alias("target"))


def sainte_lague(parties: DataFrame, group: list[str], key: str, votes: str, seats: str) -> DataFrame:
    """Adds quota: within each group, `seats` seats go to the highest quotients votes / (2 j + 1); ties to the smaller key.

    No party ends further from its exact share than its part of the rounding of all, so only quotients near the share
    are listed and ranked; seats below are certain.
    """
    w = Window.partitionBy(*group)
    share = F.when(F.col("_all") > 0, F.col(votes) * F.col(seats) / F.col("_all")).otherwise(F.lit(0.0))
    near = F.ceil(F.when(F.col("_all") > 0, F.col("_n") * F.col(votes) / F.col("_all")).otherwise(F.lit(0.0)) / 2) + 2
    sure = (
        parties.withColumn("_all", F.sum(votes).over(w)).withColumn("_n", F.count(F.lit(1)).over(w))
        .withColumn("_share", share).withColumn("_near", near)
        .withColumn("_sure", F.greatest(F.lit(0), F.floor("_share") - F.col("_near")).cast("long"))
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(w))
    )
    top = F.greatest(F.col("_sure"), F.floor("_share") + F.col("_near")).cast("long")
    order = Window.partitionBy(*group).orderBy(F.desc("_quotient"), F.asc_nulls_last(key), F.asc("_j"))
    won = (
        sure.withColumn("_j", F.explode(F.sequence(F.col("_sure"), top)))
        .withColumn("_quotient", F.col(votes) / (F.col("_j") * 2 + 1))
        .withColumn("_rank", F.row_number().over(order))
        .withColumn("_won", ((F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0)).cast("long"))
    )
    keep = [F.first(c, ignorenulls=False).alias(c) for c in parties.columns if c not in group and c != key]
    return won.groupBy(*group, key).agg(*keep, (F.first("_sure") + F.sum("_won")).alias("quota"))


def _placed(rows: DataFrame, sizes: DataFrame, seed: int, block_words: int, shard_words: int, ties: list[str]) -> DataFrame:
    """rows (doc_id, source, size, text_key and others) with source_size, target and taken. sizes: the same rows, stored."""
    wanted = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows")))
    wanted = wanted.withColumn("all_blocks", F.round(F.sum("target").over(Window.partitionBy()) / block_words).cast("long")).withColumn("one", F.lit(1))
    shards = F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words), F.ceil(F.col("n_rows") / SHARD_ROWS)).cast("long")
    sources = stored(
        sainte_lague(wanted, ["one"], "place", "target", "all_blocks")
        .select(F.col("source").alias("name"), "place", "source_size", "target", F.col("quota").alias("source_quota"), shards.alias("shards")),
        "mix-sources",
    )

    def dealt(df: DataFrame) -> DataFrame:
        known = df.join(sources, df["source"].eqNullSafe(sources["name"])).withColumn("seeded", F.xxhash64("doc_id", "text_key", F.lit(seed)))
        return known.withColumn("shard", F.pmod(F.xxhash64("seeded", F.lit("shard")), F.col("shards")))

    held = dealt(sizes).groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("source_quota").alias("source_quota"))
    quotas = sainte_lague(held, ["place"], "shard", "shard_size", "source_quota")
    takes = stored(quotas.select("place", "shard", "shard_size", F.least(F.col("quota") * block_words, F.col("shard_size") * 2).alias("takes")), "mix-takes")
    line = Window.partitionBy("place", "shard").orderBy("seeded", "doc_id", "size", *ties)
    placed = (
        dealt(rows).withColumn("end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .join(takes, ["place", "shard"])
        .withColumn("rounds", F.when(F.col("shard_size") > 0, F.floor(F.col("takes") / F.col("shard_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("takes") - F.col("rounds") * F.col("shard_size"))
    )
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - (F.col("end") - F.col("size"))))
    return placed.withColumn("taken", (F.col("rounds") * F.col("size") + part).cast("long"))


def mix(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_key, size, source_size, target, taken), one row per document.

    Each source's target becomes a whole number of blocks by Sainte-Laguë among the sources, and these blocks quotas of
    its shards by Sainte-Laguë among them. In a shard the documents lie on one line of words in seeded order; the quota
    takes its first blocks, and begins again at the line's start beyond its end, twice at most. Null or blank texts have
    size 0 and nothing is taken of them; a null source is a source of its own, the last; equal rows are documents of
    their own; an empty table gives an empty result. Other columns are not read.
    """
    rows = stored(docs.select("doc_id", "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")), "mix-sizes")
    return _placed(rows, rows, seed, block_words, shard_words, []).select("doc_id", "text_key", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, seed: int = 11, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs with each row as often as the mix takes it; a document taken in part gives a row with its first words.

    Rows go to their shards with all their columns, so equal rows are taken each for itself, as mix() tells. Null and
    blank texts go; an empty table gives an empty result.
    """
    rows, at = numbered(docs)
    rows = rows.select(*rows.columns, at["doc_id"].alias("doc_id"), at["source"].alias("source"), words_of(at["text"]).alias("size"), F.xxhash64(at["text"]).alias("text_key"))
    sizes = stored(rows.select("doc_id", "source", "size", "text_key"), "mix-sizes")
    rows = rows.withColumn("_tie", F.xxhash64(*at.values()))
    rows = _placed(rows, sizes, seed, block_words, shard_words, ["_tie"]).where("taken > 0")
    rows = rows.withColumn("_words", F.expr("explode(filter(concat(array_repeat(size, int(taken div size)), array(taken % size)), x -> x > 0))"))
    part = F.col("_words") < F.col("size")
    cut = F.array_join(F.slice(F.regexp_extract_all(at["text"], F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1)), F.lit(1), F.col("_words").cast("int")), "")
    shown = at | {"text": F.when(part, cut).otherwise(at["text"])}
    if "n_chars" in docs.columns:
        shown["n_chars"] = F.when(part, F.length(cut)).otherwise(at["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[c.alias(n) for n, c in shown.items()])
