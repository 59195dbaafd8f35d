"""Exact deduplication by composable polynomial fingerprints, checked chunk by chunk."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import numbered, stored
from .text import sliced

#: Four fields of 31 bits, a base in each, and the bytes of a chunk: a chunk's sum stays below 2**53, exact in doubles.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525, 22695477, 1566083941)
CHUNK = 512
#: Characters that are compared at once, and parts into which a large group's rows are dealt.
COMPARED, SALTS = 1 << 14, 16

_P = np.array(PRIMES, np.int64)


def normal(text: Column) -> Column:
    """The text with each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def power_table(bases: Iterable[int], n: int) -> np.ndarray:
    """Powers 0..n-1 of each base in its field."""
    out = np.ones((n, len(_P)), np.int64)
    b = np.array(list(bases), np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * b % _P
    return out


def combine(left: tuple[tuple[int, ...], int], right: tuple[tuple[int, ...], int]) -> tuple[tuple[int, ...], int]:
    """The fingerprint and length of left's bytes followed by right's: left is shifted by right's length."""
    (a, n), (b, m) = left, right
    return tuple((x * pow(base, m, p) + y) % p for x, y, base, p in zip(a, b, BASES, PRIMES, strict=True)), n + m


_tables: dict[str, np.ndarray] = {}


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """A row of four residues for each text: chunks are hashed by one matrix product, then shifted and added.

    The first chunk of a text is filled up with zeros in front, which add nothing; bytes count from 1.
    """
    if "in" not in _tables:
        _tables["in"] = power_table(BASES, CHUNK)[::-1].astype(np.float64)
        _tables["of"] = power_table([pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES, strict=True)], 64)
    counts = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    if counts.max(initial=1) > len(_tables["of"]):
        _tables["of"] = power_table([pow(b, CHUNK, p) for b, p in zip(BASES, PRIMES, strict=True)], int(counts.max()) * 2)
    first = np.cumsum(counts) - counts
    raw = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64)
    ends = (first + counts) * CHUNK
    at = np.arange(len(raw)) + np.repeat(ends - np.cumsum(lengths), lengths)
    values = np.zeros(int(counts.sum()) * CHUNK, np.float64)
    values[at] = raw
    values[at] += 1
    chunks = (values.reshape(-1, CHUNK) @ _tables["in"]).astype(np.int64) % _P
    later = np.repeat(first + counts, counts) - 1 - np.arange(len(chunks))
    return np.add.reduceat(chunks * _tables["of"][later] % _P, first, axis=0) % _P


def _hash_batches(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text", 1 << 20):
            prints = fingerprints(texts).astype(">u4") & np.array((1 << bits) - 1, ">u4")
            keys = [prints[i].tobytes() + len(t).to_bytes(8, "big") * (bits == 31) for i, t in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), batch.column("text_sha256")], ["doc_id", "print", "text_sha256"])

    return run


def exact_groups(docs: DataFrame, bits: int = 31) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    Texts that are equal after normal() form a group; null and empty texts are equal. The row with the smallest doc_id
    is kept, of repeated rows with that doc_id one. Null doc_ids are largest; an empty table gives an empty result;
    other columns are not read. bits: of each residue; few bits, without the length, force collisions in tests.
    """
    texts = docs.select("doc_id", normal(F.col("text")).alias("text"))
    hashed = texts.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    prints = stored(hashed.mapInArrow(_hash_batches(bits), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, print binary, text_sha256 string"), "prints")
    found = _members(prints)
    found = stored(found, "exact-groups")
    odd = stored(_unequal(hashed, found.where("group_size > 1").select("doc_id", "print", "text_sha256").distinct()), "exact-odd")
    if not odd.isEmpty():
        #: Different texts under one fingerprint: their groups are formed anew, by whole texts.
        fresh = _members(prints.join(odd, "print", "left_semi").select("doc_id", F.unhex("text_sha256").alias("print"), "text_sha256"))
        found = found.join(odd, "print", "left_anti").unionByName(fresh)
    return found.drop("print")


def _members(prints: DataFrame) -> DataFrame:
    """Groups by print: counts come from partial sums, and a large group's rows meet its one row in SALTS parts."""
    groups = prints.groupBy("print").agg(F.min("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    groups = groups.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = prints.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    first = F.row_number().over(Window.partitionBy("print", "doc_id").orderBy("text_sha256")) == 1
    rows = rows.join(groups, ["print", "_salt"], "left").withColumn("_first", first)
    keep = F.when(F.col("_n").isNull(), F.col("doc_id")).otherwise(F.col("_keep"))
    return rows.select("doc_id", "print", keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(keep) & F.col("_first")).alias("kept"), "text_sha256")


def _unequal(texts: DataFrame, members: DataFrame) -> DataFrame:
    """Prints under which texts differ: the smallest and largest of each chunk, by partial aggregates, must be one.

    texts have their text_sha256, so that rows of one doc_id, or of none, meet their own prints only.
    """
    members = members.select(F.col("doc_id").alias("_id"), "print", F.col("text_sha256").alias("_sha"))
    pairs = texts.join(members, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_sha256") == F.col("_sha")))
    last = F.greatest(F.lit(0), F.floor((F.length("text") - 1) / COMPARED)).cast("int")
    chunk = F.substring(F.col("text"), F.col("no") * COMPARED + 1, F.lit(COMPARED))
    chunks = pairs.withColumn("no", F.explode(F.sequence(F.lit(0), last))).select("print", "no", chunk.alias("chunk"))
    return chunks.groupBy("print", "no").agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).where("a <> b").select("print").distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row has already; one of each group stays whole, that of the smallest
    doc_id, of repeated ones any. Null and empty texts are one group. An empty table gives an empty result."""
    kept = exact_groups(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows, at = numbered(docs)
    same = at["doc_id"].eqNullSafe(F.col("_id")) & (F.sha2(normal(at["text"]).cast("binary"), 256) == F.col("_sha"))
    return rows.join(kept, same).dropDuplicates(["_id", "_sha"]).select(*rows.columns).toDF(*docs.columns)
