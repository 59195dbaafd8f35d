"""Document fingerprints: chains of content words after common-word anchors (spot signatures)."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import fan_out, stored
from .shingles import Likeness, classed
from .text import LETTERS, mix, sliced, words_hashed

#: Words so common that they may stand anywhere; the content words after them make the signatures.
ANCHORS = (
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was we were which will with you "
    "als am auch auf aus bei das dass dem den der des die ein eine einer es für im ist mit nach nicht sich sie sind und von war wie zu zum "
    "au aux avec ce dans de des du elle en est et il la le les leur ne nous par pas plus pour que qui sa se son sur un une vous "
    "al como con del el ella ese esta lo los las más mi no o para pero por si sin su sus y ya"
).split()
#: Content words in a chain, signatures that a fingerprint keeps, and the least likeness of near copies.
CHAIN, KEPT, NEAR = 2, 128, 0.8

_SEED = np.uint64(0x9E3779B97F4A7C15)
_hashes = words_hashed([w.encode() for w in dict.fromkeys(ANCHORS)], LETTERS)[0]
_ANCHOR = np.sort(_hashes)
_MAYBE = np.zeros(1 << 16, bool)
_MAYBE[_ANCHOR & np.uint64(0xFFFF)] = True


def signatures(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 32-bit signatures of each text, end to end, and where each text's begin.

    A text without a chain has its words as signatures, one without letters and digits its bytes as one; only the empty
    text has none.
    """
    words, at = words_hashed(texts, LETTERS)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(at))
    anchor = _MAYBE[words & np.uint64(0xFFFF)]
    maybe = np.flatnonzero(anchor)
    anchor[maybe] = _ANCHOR[np.minimum(np.searchsorted(_ANCHOR, words[maybe]), len(_ANCHOR) - 1)] == words[maybe]
    content = np.flatnonzero(~anchor)
    spot = np.flatnonzero(anchor)
    rank = np.cumsum(~anchor)[spot] if len(spot) else spot
    whole = rank + CHAIN <= len(content)
    spot, rank = spot[whole], rank[whole]
    if len(spot):
        whole = owner[content[rank + CHAIN - 1]] == owner[spot]
        spot, rank = spot[whole], rank[whole]
    chain = words[spot]
    for k in range(CHAIN):
        chain = mix(chain * _SEED + words[content[rank + k]])
    keys = [owner[spot] << np.uint64(32) | chain >> np.uint64(32)]
    bare = np.ones(len(texts), bool)
    bare[owner[spot].astype(np.int64)] = False
    loose = bare[owner.astype(np.int64)]
    keys.append(owner[loose] << np.uint64(32) | mix(words[loose]) >> np.uint64(32))
    for i in np.flatnonzero(bare & (np.diff(at) == 0)).tolist():
        if texts[i]:
            keys.append(np.array([i << 32 | int.from_bytes(hashlib.blake2b(texts[i], digest_size=4).digest(), "big")], np.uint64))
    found = np.unique(np.concatenate(keys))
    ends = np.searchsorted(found, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(32))
    return (found & np.uint64(0xFFFFFFFF)).astype(np.uint32), ends


def sketches(texts: list[bytes]) -> list[bytes]:
    """Of each text the number of its signatures and the KEPT smallest, as big-endian 32-bit numbers."""
    found, ends = signatures(texts)
    values = found.astype(">u4")
    return [int(b - a).to_bytes(4, "big") + values[a : min(b, a + KEPT)].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def likeness(one: bytes, two: bytes) -> float:
    """The Jaccard index of two signature sets: exact up to KEPT signatures, else estimated from the KEPT smallest.

    It is pruned by the bound that the two set lengths give. Two empty sets are alike.
    """
    if one == two:
        return 1.0
    n, m = int.from_bytes(one[:4], "big"), int.from_bytes(two[:4], "big")
    if not n or not m:
        return 0.0
    a, b = np.frombuffer(one, ">u4", offset=4), np.frombuffer(two, ">u4", offset=4)
    both = np.sort(np.concatenate([a, b]).astype(np.uint32))
    again = both[1:] == both[:-1]
    union = len(both) - int(again.sum())
    if n <= KEPT and m <= KEPT:
        return float(again.sum() / union)
    first = np.ones(len(both), bool)
    first[1:] = ~again
    end = np.flatnonzero(first)[KEPT] if union > KEPT else len(both)
    return min(float(again[: max(0, end - 1)].sum() / min(KEPT, union)), min(n, m) / max(n, m))


def jaccard(one: np.ndarray, two: np.ndarray) -> float:
    """The Jaccard index of two whole sets of sorted distinct signatures. Two empty sets are alike."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    common = len(np.intersect1d(one, two, assume_unique=True))
    return common / (len(one) + len(two) - common)


def shown(sketch: bytes) -> str:
    return base64.b64encode(sketch).decode()


def _order(column: pa.Array) -> np.ndarray:
    """doc_ids as numbers to sort by; null ones are smallest."""
    return column.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy()


def _tops(splits: list[float]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[int, int] = {}
        for batch in batches:
            ids = _order(batch.column("doc_id"))
            for bucket, x in zip(np.searchsorted(splits, ids).tolist(), ids.tolist(), strict=True):
                most[bucket] = max(x, most.get(bucket, x))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(most), pa.int32()), "top": pa.array(list(most.values()), pa.int64())})

    return run


def _dealt(splits: list[float], tops: dict[int, int]):
    """Packs each text for its bucket; a bucket's highest document also goes to the bucket that it follows."""
    ordered = sorted(tops, reverse=True)
    above = {tops[b]: ordered[k - 1] for k, b in enumerate(ordered)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in sliced(batches, "text", 1 << 20):
            ids = _order(batch.column("doc_id"))
            buckets = np.searchsorted(splits, ids)
            extra = [i for i, x in enumerate(ids.tolist()) if x in above]
            take = np.concatenate([np.arange(len(texts)), extra]).astype(np.int64)
            packed = [pack(t) for t in texts]
            prints = sketches(texts)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array(np.concatenate([buckets, [above[int(ids[i])] for i in extra]]), pa.int32()),
                "ahead": pa.array(np.arange(len(take)) >= len(texts)),
                "place": pa.array(ids[take]),
                "doc_id": batch.column("doc_id").take(pa.array(take)),
                "sketch": pa.array([prints[i] for i in take], pa.binary()),
                "packed": pa.array([packed[i] for i in take], pa.binary()),
            })

    return run


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, a bucket's own ones in order and then the one that follows: each is held until the next."""
    unpack = zstandard.ZstdDecompressor().decompress
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    done: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        nonlocal size
        changed = sketches([d[2] for d in done])
        sets = lambda texts: (lambda found, ends: [found[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)])(*signatures(texts))
        mine, edited = sets([d[4] for d in done]), sets([d[2] for d in done])
        #: The document that follows is mostly the next one here.
        last = [k for k, d in enumerate(done) if k + 1 == len(done) or d[5] is not done[k + 1][4]]
        after = dict(enumerate(mine[1:])) | dict(zip(last, sets([done[k][5] for k in last]), strict=True))
        rows = [(d[0], d[1], hashlib.sha256(d[2]).hexdigest(), shown(d[3]), shown(c), jaccard(mine[k], edited[k]), jaccard(mine[k], after[k])) for k, (d, c) in enumerate(zip(done, changed, strict=True))]
        done.clear()
        size = 0
        kinds = [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))], names)

    held = None
    kind = pa.int64()
    for batch in batches:
        kind = batch.schema.field("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("bucket", "ahead", "doc_id", "sketch", "packed")]
        for bucket, ahead, doc_id, sketch, packed in zip(*columns, strict=True):
            if held is None and ahead:
                continue
            raw = unpack(packed) if packed else b""
            text = raw.decode("utf-8", "replace")
            if held is not None:
                mine = held[2]
                cut = len(mine) // 2
                edited = (mine[: len(mine) - cut] + text[:cut]).encode()
                done.append((held[1], len(mine), edited, held[3], held[4], raw))
                size += len(edited)
                if size > 1 << 20:
                    yield flush()
            held = None if ahead else (bucket, doc_id, text, sketch, raw)
    if done:
        yield flush()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row per document.

    The next document is the one of the next smaller doc_id, after the smallest the largest; repeated doc_ids follow
    each other in the order of their signatures, null ones come last. Null text counts as empty. Documents are dealt to
    buckets of neighbouring doc_ids, each with a copy of the one that follows its last; texts travel packed.
    A fingerprint is the number of signatures and the KEPT smallest, in base64; near_edited and near_next are the Jaccard
    index of the whole signature sets. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    ids = docs.select("doc_id")
    parts = fan_out(docs.sparkSession)
    splits = ids.where("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    splits = sorted(set(splits))
    found = ids.mapInArrow(_tops(splits), "bucket int, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()
    tops = {r["bucket"]: r["top"] for r in found}
    dealt = docs.select("doc_id", "text").mapInArrow(_dealt(splits, tops), f"bucket int, ahead boolean, place long, doc_id {kind}, sketch binary, packed binary")
    ordered = dealt.repartition(parts, "bucket").sortWithinPartitions("bucket", "ahead", F.desc("place"), "sketch", "packed")
    return ordered.mapInArrow(_edited, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def signature_sets(texts: list[bytes]) -> list[np.ndarray]:
    found, ends = signatures(texts)
    wide = found.astype(np.uint64)
    return [wide[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def near_copies(docs: DataFrame, percent: int = round(100 * NEAR)) -> DataFrame:
    """(doc_id, n_signatures, class_id), one row per document: class_id is the smallest doc_id that likeness reaches.

    Signature sets of percent likeness differ in length by that factor at most, so sets are indexed within partitions by
    length, each also in the next one, under the signatures of their prefix; lengths and counts of common signatures
    prune a pair before the whole sets are looked at. Texts without a signature, null ones too, stay alone; equal texts
    are together, also of repeated rows. A null doc_id is never the smallest unless all are null. An empty table gives
    an empty result; other columns are not read.
    """
    part = lambda n: (lambda p: F.array(p, p + 1))(F.floor(F.log(n.cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9))
    made, found = classed(docs, signature_sets, Likeness(0, percent), part)
    rows = made.join(found.select("h1", "h2", F.lit(1).alias("_hit"), "least"), ["h1", "h2"], "left")
    return rows.select("doc_id", F.col("n").alias("n_signatures"), F.when(F.col("_hit") == 1, F.col("least")).otherwise(F.col("doc_id")).alias("class_id"))
