"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import fan_out, stored
from .text import mix, sliced, words_hashed

#: A count c becomes 1 + floor(log(c) / log(GRADE)) entries; bits for each, and bits that are set for it.
GRADE, BITS_EACH, PROBES = 1.3, 10, 5
DISCOUNT = 0.5
#: Bytes of text whose distinct words and pairs are counted and looked up together.
TOGETHER = 8 << 20

END = np.uint64(0xA5A5_5A5A_0F0F_F0F1)
BEGIN = np.uint64(0x1234_5678_9ABC_DEF1)


def test_fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's words and one end, and where each text's tokens begin."""
    words, at = words_hashed(texts)
    n = np.diff(at) + 1
    ends = np.cumsum(n)
    out = np.full(int(n.sum()), END)
    inner = np.ones(len(out), bool)
    inner[ends - 1] = False
    out[inner] = words
    return out, np.append(0, ends)


def pairs(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each token and the one before it; a text's first has the begin before it."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[at[:-1]] = BEGIN
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + hashes)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def graded(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(GRADE) + 1e-9).astype(np.int64)


#: The count that stands for each grade: the geometric middle of those that have it, 1 for the first.
_level = GRADE ** np.arange(0, 200)
COUNT_OF = np.concatenate([[0.0], np.sqrt(np.ceil(_level - 1e-9) * np.maximum(np.ceil(_level * GRADE - 1e-9) - 1, np.ceil(_level - 1e-9)))])


def slots(hashes: np.ndarray, grade: int, bits: int) -> Iterator[np.ndarray]:
    """Places of the bits of (n-gram, grade), one probe after the other."""
    one = mix(hashes + np.uint64(grade * 0xD6E8FEB86659FD93 % (1 << 64)))
    two = (one >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield (mix(one + np.uint64(k) * two) % np.uint64(bits)).astype(np.int64)


def _sub_filter(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A filter of its own for one shard: for each n-gram, its grades 1 to that of its count."""
    grade = graded(counts)
    size = max(64, -(-int(grade.sum()) * BITS_EACH // 64) * 64)
    bits = np.zeros(size, bool)
    for g in range(1, int(grade.max(initial=0)) + 1):
        for at in slots(hashes[grade >= g], g, size):
            bits[at] = True
    return np.packbits(bits, bitorder="little")


class Filter:
    """The filters of shards end to end. What else a caller gives is not read."""

    def __init__(self, shards: int, parts: dict[int, bytes], *_):
        self.shards = shards
        sizes = np.array([len(parts.get(s, b"\0" * 8)) for s in range(shards)], np.int64)
        self.bits = np.frombuffer(b"".join(parts.get(s, b"\0" * 8) for s in range(shards)), np.uint8)
        self.size = (sizes * 8).astype(np.uint64)
        self.start = (np.cumsum(sizes) - sizes) * 8

    def grades(self, hashes: np.ndarray) -> np.ndarray:
        """Each n-gram's grade: grades are probed from 1 until one is missing."""
        grade = np.zeros(len(hashes), np.int64)
        left = np.arange(len(hashes))
        shard = shard_of(hashes, self.shards)
        for g in range(1, len(COUNT_OF)):
            if not len(left):
                break
            alive, h, s = left, hashes[left], shard[left]
            one = mix(h + np.uint64(g * 0xD6E8FEB86659FD93 % (1 << 64)))
            for k in range(PROBES):
                at = (mix(one + np.uint64(k) * ((one >> np.uint64(32)) | np.uint64(1))) % self.size[s]).astype(np.int64) + self.start[s]
                ok = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                alive, one, s = alive[ok], one[ok], s[ok]
                if not len(alive):
                    break
            grade[alive] = g
            left = alive
        return grade

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Each n-gram's count as its grade tells it."""
        return COUNT_OF[self.grades(hashes)]


def _sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents, about TOGETHER bytes of them in a row, which their first one's number names."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch, texts in sliced(batches, "text", TOGETHER):
        one = pa.array([0, len(texts)], pa.int32())
        lists = {k: pa.ListArray.from_arrays(one, batch.column(k)) for k in ("doc_id", "held_out")}
        lengths = np.array([len(t) for t in texts], "<i8")
        yield pa.RecordBatch.from_pydict({"slice": batch.column("row").slice(0, 1), **lists, "lengths": pa.array([lengths.tobytes()], pa.binary()), "packed": pa.array([pack(b"".join(texts))], pa.binary())})


def _unpacked(lengths: bytes, packed: bytes) -> list[bytes]:
    whole = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(lengths, "<i8")).tolist()
    return [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def _asked(shards: int):
    """A slice's distinct words and pairs by shard, with their counts in its training documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                words, at = tokens(_unpacked(row["lengths"], row["packed"]))
                train = np.repeat(~np.array(row["held_out"], bool), np.diff(at))
                out: dict[str, pa.Array] = {"slice": pa.array([row["slice"]] * shards, pa.int64()), "shard": pa.array(np.arange(shards), pa.int32())}
                some = np.zeros(shards, bool)
                for name, hashes in (("words", words), ("pairs", pairs(words, at))):
                    #: Distinct hashes are sorted, so they are also in the order of their shards.
                    found, n = np.unique(hashes, return_counts=True)
                    if not train.all():
                        seen, k = np.unique(hashes[train], return_counts=True)
                        n = np.zeros(len(found), np.int64)
                        n[np.searchsorted(found, seen)] = k
                    edge = np.searchsorted(shard_of(found, shards), np.arange(shards + 1))
                    n = n.astype("<u4")
                    some |= edge[1:] > edge[:-1]
                    out[name] = pa.array([found[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                    out[f"{name}_n"] = pa.array([n[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out).filter(pa.array(some))

    return run


def _answered(key: tuple, table: pa.Table) -> pa.Table:
    """A shard's exact counts make its filter; each slice gets its words' exact counts and the grades by the filter.

    A row without a slice has the shard's part of the corpus totals.
    """
    hashes, back, n, sizes = {}, {}, {}, {}
    for name in ("words", "pairs"):
        blobs = table.column(name).to_pylist()
        sizes[name] = np.cumsum([0] + [len(b) // 8 for b in blobs])
        hashes[name], back[name] = np.unique(np.frombuffer(b"".join(blobs), "<u8"), return_inverse=True)
        counts = np.frombuffer(b"".join(table.column(f"{name}_n").to_pylist()), "<u4")
        n[name] = np.bincount(back[name], counts, len(hashes[name])).astype(np.int64)
    every, times = np.concatenate([hashes["words"], hashes["pairs"]]), np.concatenate([n["words"], n["pairs"]])
    model = Filter(1, {0: _sub_filter(every[times > 0], times[times > 0]).tobytes()})
    grade = {k: model.grades(h).astype(np.uint8) for k, h in hashes.items()}
    shard = key[0].as_py()
    cut = lambda values, name: [*(x.tobytes() for x in np.split(values[back[name]], sizes[name][1:-1])), None]
    rows = table.num_rows
    once = lambda x: pa.array([None] * rows + [int(x)], pa.int64())
    return pa.table({
        "slice": pa.array([*table.column("slice").to_pylist(), None], pa.int64()), "shard": pa.array([shard] * (rows + 1), pa.int32()),
        "exact": pa.array(cut(n["words"], "words"), pa.binary()), "word_grades": pa.array(cut(grade["words"], "words"), pa.binary()), "pair_grades": pa.array(cut(grade["pairs"], "pairs"), pa.binary()),
        "total": once(n["words"].sum()), "distinct": once((n["words"] > 0).sum()), "pairs": once((n["pairs"] > 0).sum()), "ends": once(n["words"][hashes["words"] == END].sum()),
    })


_ANSWERED = "slice long, shard int, exact binary, word_grades binary, pair_grades binary, total long, distinct long, pairs long, ends long"
TOTALS = ("total", "distinct", "pairs", "ends")


def backed_off(context: np.ndarray, total: int, distinct: int, kinds: int) -> np.ndarray:
    """The share of contexts of these counts that their pairs lose and the words get.

    A context seen once loses DISCOUNT, others tend to one share; it is such that all training contexts together, which
    are `distinct`, lose DISCOUNT for each of the `kinds` pairs.
    """
    often = DISCOUNT * (kinds - distinct) / max(1, total - distinct)
    return often + (DISCOUNT - often) / np.maximum(context, 1)


def _scored(totals: tuple[int, int, int, int]):
    """Log10 probabilities of a slice's documents: discounted pairs, interpolated with words, these with a uniform share."""
    total, distinct, kinds, ends = totals

    def run(key: tuple, docs: pa.Table, answers: pa.Table) -> pa.Table:
        row = docs.select(["lengths", "packed"]).to_pylist()[0]
        words, at = tokens(_unpacked(row["lengths"], row["packed"]))
        answers = answers.sort_by("shard")
        told = lambda c, kind: np.frombuffer(b"".join(answers.column(c).to_pylist()), kind)
        back = np.unique(words, return_inverse=True)[1]
        exact = told("exact", "<i8")
        single = COUNT_OF[told("word_grades", np.uint8)]
        double = COUNT_OF[told("pair_grades", np.uint8)][np.unique(pairs(words, at), return_inverse=True)[1]]
        context = np.empty(len(words))
        context[1:] = single[back][:-1]
        context[at[:-1]] = ends
        base = ((single + distinct / (distinct + 1)) / (total + distinct))[back] if total else np.ones(len(words))
        p = np.where(context > 0, np.maximum(double - DISCOUNT, 0) / np.maximum(context, 1) + backed_off(context, total, distinct, kinds) * base, base)
        sums = lambda x: np.add.reduceat(x, at[:-1])
        return pa.table({
            "doc_id": docs.column("doc_id").combine_chunks().flatten(), "held_out": docs.column("held_out").combine_chunks().flatten(), "n_tokens": pa.array(np.diff(at)),
            "n_known": pa.array(sums((exact > 0).astype(np.int64)[back])), "train_tokens": pa.array(np.full(len(at) - 1, total, np.int64)),
            "base_score": pa.array(sums(np.log10((exact + 0.1) / (total + 0.1 * (distinct + 1)))[back])), "score": pa.array(sums(np.log10(np.minimum(p, 1.0)))),
        })

    return run


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    score is the log10 probability by the filter's counts, base_score the one by exact counts of single tokens. All
    words and pairs are in the filter, whatever their number: each shard of hashes has a filter of its own, and slices
    of documents ask the shards. Null and empty texts are the end alone; repeated rows are documents of their own; null
    doc_ids are trained on. Words are told apart by 64-bit hashes. Without training texts N and V are 0. Other columns
    are not read.
    """
    shards = fan_out(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", test_fold(F.col("doc_id")).alias("held_out"), "text")
    slices = stored(rows.mapInArrow(_sliced, f"slice long, doc_id array<{kind}>, held_out array<boolean>, lengths binary, packed binary"), "lm-slices")
    asked = slices.select("slice", "held_out", "lengths", "packed").mapInArrow(_asked(shards), "slice long, shard int, words binary, words_n binary, pairs binary, pairs_n binary")
    answers = stored(asked.groupBy("shard").applyInArrow(_answered, _ANSWERED), "lm-answers")
    sums = answers.where("slice is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOTALS]).first()
    told = answers.where("slice is not null").select("slice", "shard", "exact", "word_grades", "pair_grades")
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return slices.groupBy("slice").cogroup(told.groupBy("slice")).applyInArrow(_scored(tuple(int(sums[c]) for c in TOTALS)), out)
