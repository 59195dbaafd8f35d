"""Fifty features of a pair. What one record gives is computed once per record, before pairs are formed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text as tx

_SIDE = (
    "jaccard_tokens dice_tokens overlap_tokens containment_ab containment_ba jaccard_ngrams dice_ngrams overlap_ngrams lev_canon jw_canon lev_raw jw_raw "
    "common_tokens common_ratio first_token_match length_diff length_ratio digits_equal"
).split()
GLOBAL_FEATURES = (
    "country_match cross_jaccard soundex_jaccard name_top5_ngrams addr_top5_ngrams quick_score name_either_empty addr_either_empty name_both_empty addr_both_empty "
    "raw_exact_name raw_exact_addr canon_exact_name canon_exact_addr"
).split()
NAME_FEATURES = [f"name_{x}" for x in _SIDE]
ADDR_FEATURES = [f"addr_{x}" for x in _SIDE]
FEATURES = [*NAME_FEATURES, *ADDR_FEATURES, *GLOBAL_FEATURES]


def prepared(records: DataFrame) -> DataFrame:
    """A record's normal forms, token sets and n-grams; id, ord, source and these only."""
    r = records.select("entity_id", "source", "ord", tx.clean_text(F.col("business_name")).alias("name_clean"), tx.clean_text(F.col("business_address")).alias("addr_clean"), tx.norm_country(F.col("country")).alias("country"))
    r = r.withColumn("_n", tx.tokens_of(F.col("name_clean"))).withColumn("_a", tx.tokens_of(F.col("addr_clean")))
    r = r.select("*", tx.canonical_name_of(F.col("_n")).alias("name_canon"), tx.canonical_address_of(F.col("_a")).alias("addr_canon"))
    r = r.select(
        "*", tx.name_tokens(F.col("_n")).alias("name_tok"), tx.address_tokens(F.col("_a")).alias("addr_tok"), tx.digit_tokens(F.col("_n")).alias("name_dig"), tx.digit_tokens(F.col("_a")).alias("addr_dig"),
        tx.ngrams(F.col("name_canon")).alias("name_ng"), tx.ngrams(F.col("addr_canon")).alias("addr_ng"), F.array_distinct(tx.soundex_keys(F.col("_n"))).alias("name_sx"),
    )
    best = lambda c: F.slice(F.array_sort(c, lambda x, y: F.when(F.length(x) != F.length(y), F.length(y) - F.length(x)).when(x < y, -1).when(x > y, 1).otherwise(0)), 1, 5)
    return r.select("*", best(F.col("name_ng")).alias("name_top"), best(F.col("addr_ng")).alias("addr_top")).drop("_n", "_a")


def paired(found: DataFrame, records: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Candidates with both records as structs a and b; with truth also label, 1 for a known link."""
    ready = prepared(records)
    whole = F.struct(*[c for c in ready.columns if c not in ("source", "ord")])
    one = ready.where("source = 1").select(F.col("entity_id").alias("s1_id"), whole.alias("a"))
    two = ready.where("source > 1").select(F.col("entity_id").alias("target_id"), whole.alias("b"))
    pairs = found.select("s1_id", "target_id")
    if truth is not None:
        pairs = pairs.join(truth.select("s1_id", "target_id").distinct().withColumn("_hit", F.lit(1)), ["s1_id", "target_id"], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")
    #: Ids are small, so exchanges of them are joined into few tasks; the features of a pair are costly.
    context = records.sparkSession.sparkContext
    tasks = max(context.defaultParallelism, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.join(one, "s1_id").join(two, "target_id").repartition(tasks, "s1_id", "target_id")


def _flag(c: Column) -> Column:
    return c.cast("double")


def _side(p: str, with_jaro_winkler: bool) -> dict[str, Column]:
    at = lambda side, name: F.col(f"{side}.{p}_{name}")
    a, b, ga, gb, ca, cb, ra, rb = (at(s, n) for n in ("tok", "ng", "canon", "clean") for s in "ab")
    both, n, m = sim.common(a, b), F.size(a), F.size(b)
    la, lb = F.length(ca), F.length(cb)
    least = F.least(n, m)
    out = {
        "jaccard_tokens": sim.jaccard(a, b), "dice_tokens": sim.dice(a, b), "overlap_tokens": sim.overlap(a, b), "containment_ab": sim.containment(a, b), "containment_ba": sim.containment(b, a),
        "jaccard_ngrams": sim.jaccard(ga, gb), "dice_ngrams": sim.dice(ga, gb), "overlap_ngrams": sim.overlap(ga, gb),
        "lev_canon": sim.levenshtein_ratio(ca, cb), "lev_raw": sim.levenshtein_ratio(ra, rb),
        "common_tokens": both.cast("double"), "common_ratio": F.when(least == 0, F.lit(0.0)).otherwise(both / least),
        "first_token_match": _flag((n > 0) & (m > 0) & F.coalesce(F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(1)), F.lit(False))),
        "length_diff": F.abs(la - lb) / F.greatest(la, lb, F.lit(1)), "length_ratio": F.least(la, lb) / F.greatest(la, lb, F.lit(1)),
        "digits_equal": _flag((F.size(at("a", "dig")) > 0) & (F.array_sort(at("a", "dig")) == F.array_sort(at("b", "dig")))),
    }
    if with_jaro_winkler:
        out |= {"jw_canon": sim.jaro_winkler(ca, cb), "jw_raw": sim.jaro_winkler(ra, rb)}
    return {f"{p}_{k}": v for k, v in out.items()}


def quick_score() -> Column:
    country = country_match()
    return 0.35 * sim.jaccard(F.col("a.name_tok"), F.col("b.name_tok")) + 0.15 * sim.jaccard(F.col("a.name_ng"), F.col("b.name_ng")) + 0.20 * sim.jaccard(F.col("a.addr_tok"), F.col("b.addr_tok")) + 0.10 * sim.jaccard(F.col("a.addr_ng"), F.col("b.addr_ng")) + 0.20 * country


def country_match() -> Column:
    a, b = F.col("a.country"), F.col("b.country")
    return F.when((a == "") | (b == ""), F.lit(0.5)).otherwise((a == b).cast("double"))


def _global() -> dict[str, Column]:
    na, nb, aa, ab = F.col("a.name_tok"), F.col("b.name_tok"), F.col("a.addr_tok"), F.col("b.addr_tok")
    sa, sb = F.col("a.name_sx"), F.col("b.name_sx")
    none = lambda c: F.size(c) == 0
    same = lambda n: _flag((F.col(f"a.{n}") == F.col(f"b.{n}")) & (F.col(f"a.{n}") != ""))
    return {
        "country_match": country_match(), "cross_jaccard": sim.jaccard(F.array_intersect(na, aa), F.array_intersect(nb, ab)),
        "soundex_jaccard": F.when(none(sa) & none(sb), F.lit(0.0)).otherwise(sim.jaccard(sa, sb)),
        "name_top5_ngrams": sim.jaccard(F.col("a.name_top"), F.col("b.name_top")), "addr_top5_ngrams": sim.jaccard(F.col("a.addr_top"), F.col("b.addr_top")), "quick_score": quick_score(),
        "name_either_empty": _flag(none(na) | none(nb)), "addr_either_empty": _flag(none(aa) | none(ab)), "name_both_empty": _flag(none(na) & none(nb)), "addr_both_empty": _flag(none(aa) & none(ab)),
        "raw_exact_name": same("name_clean"), "raw_exact_addr": same("addr_clean"), "canon_exact_name": same("name_canon"), "canon_exact_addr": same("addr_canon"),
    }


def featured(pairs: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """(s1_id, target_id, label if there is one, the named features); Python runs only for Jaro-Winkler."""
    jw = any("_jw_" in n for n in names)
    every = _side("name", jw) | _side("addr", jw) | _global()
    keep = [c for c in ("s1_id", "target_id", "label") if c in pairs.columns]
    return pairs.select(*keep, *[every[n].alias(n) for n in names])


def split_by_hash(entities: DataFrame, seed: int = 42, held: float = 0.2) -> DataFrame:
    """Adds held_out by a hash of the id: the same for an id in any partitioning."""
    return entities.withColumn("held_out", F.pmod(F.xxhash64("entity_id", F.lit(seed)), F.lit(1000)) >= round(1000 * (1 - held)))
