"""The whole linkage: read, block, learn, tune, score, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, evaluate, features
from ..operators.matcher import Matcher, tune_threshold
from ..sources import records as rec
from ..sources import sinks


@dataclass
class Outcome:
    """val_fbeta and recall on held-out entities, the threshold used; counts of the test split if it was predicted."""

    val_fbeta: float | None
    recall_ceiling: float | None
    threshold: float
    n_test_s1: int | None = None
    total_candidates: int | None = None
    total_matches: int | None = None


def learned(records: DataFrame, truth: DataFrame, settings: rec.Settings, backend: str = "gbt", tune: bool = True, seed: int = 42) -> tuple[Matcher, Outcome]:
    """A matcher from the entities that a hash doesn't hold out, tuned and scored on those that it does.

    All pairs of the training entities' candidates are learned from. A given threshold holds if tune is False.
    """
    entities = features.split_by_hash(rec.entities_of(records), seed)
    targets = rec.targets_of(records)
    found = blocking.candidates(entities, targets, settings.max_candidates, settings.bucket_cap)
    pairs = features.featured(features.paired(found, records, truth)).join(entities.select(F.col("entity_id").alias("s1_id"), "held_out"), "s1_id").persist()
    held = entities.where("held_out")
    matcher = Matcher(settings.threshold, backend).train(pairs, "held_out" if backend == "gbt" and not pairs.where("held_out").isEmpty() else None)
    scored = matcher.predict_proba(pairs.where("held_out")).select("s1_id", "target_id", "proba").persist()
    own_truth = truth.join(held.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi")
    if scored.isEmpty():
        return matcher, Outcome(None, None, matcher.threshold)
    if tune:
        matcher.threshold, _ = tune_threshold(scored, own_truth)
    links = scored.where(F.col("proba") >= matcher.threshold)
    val = evaluate.summary(evaluate.per_entity(held, links, own_truth)).first()["macro_fbeta"]
    recall = blocking.blocking_recall(held, found.join(held.select(F.col("entity_id").alias("s1_id")), "s1_id", "left_semi"), own_truth).first()["recall_ceiling"]
    scored.unpersist()
    pairs.unpersist()
    return matcher, Outcome(val, recall, matcher.threshold)


def linked(records: DataFrame, matcher: Matcher, settings: rec.Settings) -> tuple[DataFrame, DataFrame]:
    """(candidates, links) of all entities of the records."""
    found = blocking.candidates(rec.entities_of(records), rec.targets_of(records), settings.max_candidates, settings.bucket_cap)
    scored = matcher.predict_proba(features.featured(features.paired(found, records)))
    return found.select("s1_id", "target_id"), scored.where(F.col("proba") >= matcher.threshold).select("s1_id", "target_id", "proba")


def run_pipeline(spark: SparkSession, data_dir: str, out_dir: str | None = None, train_only: bool = False, settings: rec.Settings | None = None, backend: str = "gbt", tune: bool = True) -> Outcome:
    """Train on data_dir/train, then link data_dir/test and write matching_results and candidate_pairs under out_dir."""
    settings = settings or rec.Settings()
    train = rec.unique_records(rec.load_sources(spark, "train", data_dir))
    try:
        truth, _ = rec.load_ground_truth(spark, f"{data_dir}/train/train_ground_truth.tsv")
    except FileNotFoundError:
        truth = spark.createDataFrame([], "s1_id string, target_id string")
    matcher, outcome = learned(train, truth, settings, backend, tune)
    if train_only:
        return outcome
    test = rec.unique_records(rec.load_sources(spark, "test", data_dir)).persist()
    entities = rec.entities_of(test)
    found, links = linked(test, matcher, settings)
    found, links = found.persist(), links.persist()
    lists = sinks.match_lists(entities, links)
    outcome.n_test_s1 = sinks.check_row_count(lists, entities)
    outcome.total_candidates, outcome.total_matches = found.count(), links.count()
    if out_dir:
        sinks.write_tsv(lists, f"{out_dir}/matching_results.tsv")
        sinks.write_tsv(sinks.match_lists(entities, found, "candidate_entity_ids"), f"{out_dir}/candidate_pairs.tsv")
    return outcome
