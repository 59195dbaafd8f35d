"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import numbered
from .text import LETTERS, mix, sliced, words_hashed

#: Buckets of hashed features; labelled rows that are learned from at most, those of the smallest hashes; passes over them.
BITS, SAMPLE, PASSES = 20, 12_000, 3
#: FTRL: rate, its offset, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 1.0
THRESHOLD = 0.3


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of all words, word pairs and pairs with one word between; punctuation parts words."""
    words, at = words_hashed(texts, LETTERS)
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    shift = np.uint64(64 - BITS)
    out_o, out_b = [owner], [mix(words ^ np.uint64(0x51)) >> shift]
    for gap, salt in ((1, 0xA7), (2, 0xD3)):
        inside = owner[:-gap] == owner[gap:]
        pair = mix(words[:-gap] * np.uint64(0x9E3779B97F4A7C15) + mix(words[gap:] ^ np.uint64(salt)))
        out_o.append(owner[:-gap][inside])
        out_b.append(pair[inside] >> shift)
    return np.concatenate(out_o), np.concatenate(out_b).astype(np.int64)


class Ftrl:
    """Per-coordinate rates; a coordinate's weight is zero until its gradients outweigh the L1 penalty."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        rate = (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA
        self.z[at] += gradient - rate * w
        self.n[at] = n + gradient**2


def _train(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task learns from the bounded sample, in the order of its hashes. The last bucket is the constant."""
    rows = []
    for batch in batches:
        order, label = batch.column("seeded").to_pylist(), batch.column("toxic").to_pylist()
        buckets = batch.column("buckets")
        rows += [(order[i], label[i], buckets[i].values.to_numpy()) for i in range(batch.num_rows)]
    rows.sort(key=lambda r: r[:2])
    model = Ftrl((1 << BITS) + 1)
    for _ in range(PASSES):
        for _, label, at in rows:
            model.learn(np.append(at, 1 << BITS), float(label))
    w = model.weights(np.arange((1 << BITS) + 1))
    found = np.flatnonzero(w)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(found, pa.int32()), "weight": pa.array(w[found], pa.float64())})


def _bucketed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in sliced(batches, "text", 1 << 20):
        owner, bucket = features(texts)
        pairs = np.unique((owner << np.int64(BITS)) | bucket)
        ends = np.searchsorted(pairs >> np.int64(BITS), np.arange(len(texts) + 1))
        found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(pairs & np.int64((1 << BITS) - 1), pa.int32()))
        yield pa.RecordBatch.from_pydict({"seeded": batch.column("seeded"), "toxic": batch.column("toxic"), "buckets": found})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Buckets with a weight, and the weights. Of several labels of a document the largest counts; null is no label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.withColumn("seeded", F.xxhash64("doc_id", F.lit(7))).orderBy("seeded", "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("seeded", "toxic", "text")
    learned = rows.mapInArrow(_bucketed, "seeded long, toxic int, buckets array<int>").repartition(1).mapInArrow(_train, "bucket int, weight double").toArrow()
    return learned.column("bucket").to_numpy(), learned.column("weight").to_numpy()


def _scored(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, weights = shared.value
        table = np.zeros((1 << BITS) + 1)
        table[buckets] = weights
        for batch, texts in sliced(batches, "text", 1 << 20):
            owner, bucket = features(texts)
            hit = table[bucket] != 0
            pairs = np.unique((owner[hit] << np.int64(BITS)) | bucket[hit])
            sums = np.bincount(pairs >> np.int64(BITS), table[pairs & np.int64((1 << BITS) - 1)], len(texts)) + table[-1]
            score = np.round(1 / (1 + np.exp(-np.clip(sums, -35, 35))), 9)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], [*(c for c in batch.schema.names if c != "text"), "score", "predicted"])

    return run


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per document; null and empty texts get the score of no feature.

    A feature counts once in a text. The weights that L1 leaves are at most one for each bucket, 2**BITS + 1, and
    are broadcast. Other columns are not read; an empty table gives an empty result, and no labels the score 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scored(shared), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def clean(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs without those that the model predicts toxic."""
    run = _scored(docs.sparkSession.sparkContext.broadcast(model))
    rows, at = numbered(docs)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield batch.filter(pc.equal(batch.column("predicted"), 0)).drop_columns(["score", "predicted"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema))
    return rows.select("*", at["text"].alias("text")).mapInArrow(keep, schema).toDF(*docs.columns)
