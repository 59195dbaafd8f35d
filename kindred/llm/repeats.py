"""Removal of repeated passages: suffix arrays over shards of the passages that may repeat.

Every string of WIDTH bytes has a seed in it, chosen by its content alone: the GRAM bytes of the least hash, the
leftmost of equal ones. Neighbouring strings with one seed make up a context. Equal strings have equal seeds, so they
meet in the seed's shard; a seed that stands in one context only is done with. Of equal contexts the first stands for
all, as every string of a later one starts earlier too. What is left of a shard is one text, whose suffix array and
common prefixes show which strings are equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bloomlm import shard_of
from .session import fan_out, stored
from .suffixes import common_prefixes, suffix_array
from .text import mix, powers, sliced

WIDTH, GRAM = 100, 16
#: Strings of a text that are looked at together, and bytes of contexts in one suffix array.
RANGE, BLOCK = 1 << 20, 2 << 20


def contexts(texts: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, first string's start, strings, seed, content hash) of each context of all texts."""
    found, jobs, size = [], [], 0
    for i, t in enumerate(texts):
        for s in range(0, max(0, len(t) - width + 1), RANGE):
            jobs.append((i, s, t[s : s + RANGE + width - 1]))
            size += len(jobs[-1][2])
            if size >= RANGE:
                found.append(_contexts(jobs, width))
                jobs, size = [], 0
    if jobs:
        found.append(_contexts(jobs, width))
    if not found:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _contexts(jobs: list[tuple[int, int, bytes]], width: int) -> tuple[np.ndarray, ...]:
    """contexts of (text, first string's start, bytes), together at most two RANGEs and two widths: 24 bits hold a place."""
    spots = width - GRAM + 1
    buf = np.frombuffer(b"".join(j[2] for j in jobs), np.uint8)
    length = np.array([len(j[2]) for j in jobs], np.int64)
    start = np.cumsum(length) - length
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * down[: len(buf) - GRAM + 1])
    low = np.uint64((1 << 24) - 1)
    key = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    span = 1
    best = key
    while span * 2 <= spots:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < spots:
        best = np.minimum(best[: len(best) - (spots - span)], best[spots - span :])
    strings = length - width + 1
    place = np.arange(int(strings.sum())) + np.repeat(start - (np.cumsum(strings) - strings), strings)
    seed_at = (best[place] & low).astype(np.int64)
    job = np.repeat(np.arange(len(jobs)), strings)
    edge = np.flatnonzero(np.append(True, (seed_at[1:] != seed_at[:-1]) | (job[1:] != job[:-1])))
    times = np.diff(np.append(edge, len(place)))
    first, job = place[edge], job[edge]
    end = first + times + width - 1
    content = mix((sums[end] - sums[first]) * down[first] ^ times.astype(np.uint64))
    text = np.array([j[0] for j in jobs], np.int64)[job]
    offset = first - start[job] + np.array([j[1] for j in jobs], np.int64)[job]
    return text, offset, times, gram[seed_at[edge]], content


def _merged(order: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of (order, start, end), sorted, in which each next one begins within or just after what is covered."""
    if not len(order):
        return order, start, end
    rank = np.lexsort((start, order))
    order, start, end = order[rank], start[rank], end[rank]
    fresh = np.append(True, order[1:] != order[:-1])
    group = np.cumsum(fresh) - 1
    #: Ends within a document are made comparable over all by a step for each document.
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + group * step) - group * step
    begin = fresh.copy()
    begin[1:] |= start[1:] > reach[:-1]
    first = np.flatnonzero(begin)
    last = np.append(first[1:], len(order)) - 1
    return order[first], start[first], reach[last]


def _by_shard(shard: np.ndarray, shards: int, columns: dict[str, np.ndarray], kind: int) -> pa.RecordBatch:
    """Rows (shard, kind, blobs of the columns); "seed" and "content" may be missing."""
    rank = np.argsort(shard, kind="stable")
    edge = np.searchsorted(shard[rank], np.arange(shards + 1))
    full = [s for s in range(shards) if edge[s] < edge[s + 1]]
    out = {"shard": pa.array(full, pa.int32()), "kind": pa.array([kind] * len(full), pa.int32())}
    for name in ("seed", "content", "order", "start", "times"):
        if name in columns:
            v = columns[name][rank]
            out[name] = pa.array([v[edge[s] : edge[s + 1]].tobytes() for s in full], pa.binary())
        else:
            out[name] = pa.nulls(len(full), pa.binary())
    return pa.RecordBatch.from_pydict(out)


_BLOBS = "shard int, kind int, seed binary, content binary, order binary, start binary, times binary"
#: Kinds of rows: contexts by seed, covered bytes by document, wanted contexts by document.
SEEDED, COVERED, WANTED = 0, 1, 2


def _home(order: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a document."""
    return shard_of(mix(order.view(np.uint64)), shards)


def _seat(seed: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a seed. Seeds are least hashes, so they are hashed once more to fall everywhere."""
    return shard_of(mix(seed), shards)


def _firsts(seed: np.ndarray, content: np.ndarray, order: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a sorting by seed, content and place; whether each of it is the first of its equals)."""
    rank = np.lexsort((start, order, content, seed))
    s, c = seed[rank], content[rank]
    return rank, np.append(True, (s[1:] != s[:-1]) | (c[1:] != c[:-1])) if len(rank) else np.zeros(0, bool)


def _found(shards: int):
    """Contexts by seed; of equal ones in a slice of documents only the first, the others are covered already."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in sliced(batches, "text", 1 << 20):
            text, start, times, seed, content = contexts(texts)
            if not len(text):
                continue
            order = batch.column("order").to_numpy()[text]
            rank, first = _firsts(seed, content, order, start)
            keep, later = rank[first], rank[~first]
            yield _by_shard(_seat(seed[keep], shards), shards, {"seed": seed[keep], "content": content[keep], "order": order[keep], "start": start[keep].astype("<u4"), "times": times[keep].astype(np.uint8)}, SEEDED)
            if len(later):
                o, a, b = _merged(order[later], start[later], start[later] + times[later] + WIDTH - 1)
                yield _by_shard(_home(o, shards), shards, {"order": o, "start": a.astype("<u4"), "times": b.astype("<u4")}, COVERED)

    return run


def _read(table: pa.Table, kind: int, names: dict[str, object]) -> dict[str, np.ndarray]:
    import pyarrow.compute as pc

    rows = table.filter(pc.equal(table.column("kind"), kind))
    return {n: np.frombuffer(b"".join(rows.column(n).to_pylist()), k) for n, k in names.items()}


def _rivals(shards: int):
    """Of a shard's equal contexts later ones are covered; the first ones of a seed with several are wanted."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        x = _read(table, SEEDED, {"seed": "<u8", "content": "<u8", "order": "<i8", "start": "<u4", "times": np.uint8})
        start, times = x["start"].astype(np.int64), x["times"].astype(np.int64)
        rank, first = _firsts(x["seed"], x["content"], x["order"], start)
        later, keep = rank[~first], rank[first]
        seed = x["seed"][keep]
        other = np.zeros(len(seed), bool)
        other[1:] = seed[1:] == seed[:-1]
        other[:-1] |= seed[1:] == seed[:-1]
        want = keep[other]
        o, a, b = _merged(x["order"][later], start[later], start[later] + times[later] + WIDTH - 1)
        out = [
            _by_shard(_home(o, shards), shards, {"order": o, "start": a.astype("<u4"), "times": b.astype("<u4")}, COVERED),
            _by_shard(_home(x["order"][want], shards), shards, {"seed": x["seed"][want], "order": x["order"][want], "start": x["start"][want], "times": x["times"][want]}, WANTED),
        ]
        import pyarrow.compute as pc

        return pa.concat_tables([table.filter(pc.equal(table.column("kind"), COVERED)), *(pa.Table.from_batches([b]) for b in out)])

    return run


def _packed(shards: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch, texts in sliced(batches, "text", 4 << 20):
            home = _home(batch.column("order").to_numpy(), shards)
            yield pa.RecordBatch.from_pydict({"shard": pa.array(home, pa.int32()), "order": batch.column("order"), "doc_id": batch.column("doc_id"), "packed": pa.array([pack(t) for t in texts], pa.binary())})

    return run


def _cut(shards: int):
    """The bytes of wanted contexts, by seed."""

    def run(key: tuple, wanted: pa.Table, docs: pa.Table) -> pa.Table:
        x = _read(wanted, WANTED, {"seed": "<u8", "order": "<i8", "start": "<u4", "times": np.uint8})
        rank = np.argsort(x["order"], kind="stable")
        unpack = zstandard.ZstdDecompressor().decompress
        row_of = {o: i for i, o in enumerate(docs.column("order").to_pylist())}
        packed = docs.column("packed")
        blobs, now, text = [b""] * len(rank), None, b""
        start, times = x["start"].astype(np.int64), x["times"].astype(np.int64)
        for i in rank.tolist():
            o = int(x["order"][i])
            if o != now:
                now, text = o, unpack(packed[row_of[o]].as_py())
            blobs[i] = text[start[i] : start[i] + times[i] + WIDTH - 1]
        to = _seat(x["seed"], shards)
        rank = np.argsort(to, kind="stable")
        edge = np.searchsorted(to[rank], np.arange(shards + 1))
        full = [s for s in range(shards) if edge[s] < edge[s + 1]]
        out = {"shard": pa.array(full, pa.int32())}
        for name in ("seed", "order", "start", "times"):
            v = x[name][rank]
            out[name] = pa.array([v[edge[s] : edge[s + 1]].tobytes() for s in full], pa.binary())
        out["bytes"] = pa.array([b"".join(blobs[i] for i in rank[edge[s] : edge[s + 1]].tolist()) for s in full], pa.binary())
        return pa.table(out)

    return run


def repeated_strings(blobs: list[bytes], order: np.ndarray, start: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(blob, place in it) of each string of `width` bytes of the blobs that starts earlier too.

    A blob lies in document `order` at `start`; smaller ones are earlier. The blobs make one text; strings whose
    neighbours in its suffix array have a common prefix of width bytes are equal.
    """
    length = np.array([len(b) for b in blobs], np.int64)
    text = np.frombuffer(b"".join([b + b"\xff" for b in blobs]), np.uint8) + np.uint8(1)
    found = suffix_array(text)
    prefix = common_prefixes(text, found)
    begin = np.cumsum(length + 1) - (length + 1)
    blob = np.repeat(np.arange(len(blobs)), length + 1)
    inside = np.arange(len(text)) - begin[blob]
    whole = inside + width <= length[blob]
    found = found[whole[found]]
    if not len(found):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.append(True, prefix[found[1:]] < width)
    _, document = np.unique(order, return_inverse=True)
    place = document[blob[found]] * (int(start.max()) + int(length.max()) + 1) + start[blob[found]] + inside[found]
    least = np.minimum.reduceat(place, np.flatnonzero(first))
    later = found[place > least[np.cumsum(first) - 1]]
    return blob[later], inside[later]


def _compared(shards: int):
    """Suffix arrays of a shard's contexts, in blocks of whole seeds of about BLOCK bytes."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        seed, order, start, times = (np.frombuffer(b"".join(table.column(n).to_pylist()), k) for n, k in (("seed", "<u8"), ("order", "<i8"), ("start", "<u4"), ("times", np.uint8)))
        raw = b"".join(table.column("bytes").to_pylist())
        start, length = start.astype(np.int64), times.astype(np.int64) + WIDTH - 1
        at = np.cumsum(length) - length
        rank = np.argsort(seed, kind="stable")
        total = np.cumsum(length[rank])
        edge = np.append(np.flatnonzero(np.append(True, seed[rank][1:] != seed[rank][:-1])), len(rank)) if len(rank) else np.zeros(1, np.int64)
        parts = []
        i = 0
        while i < len(edge) - 1:
            j = i + 1
            base = total[edge[i] - 1] if edge[i] else 0
            while j < len(edge) - 1 and total[edge[j + 1] - 1] - base <= BLOCK:
                j += 1
            own = rank[edge[i] : edge[j]]
            blob, inside = repeated_strings([raw[at[k] : at[k] + length[k]] for k in own.tolist()], order[own], start[own])
            begin = start[own][blob] + inside
            parts.append(_merged(order[own][blob], begin, begin + WIDTH))
            i = j
        join = lambda k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64)
        o = join(0)
        return pa.Table.from_batches([_by_shard(_home(o, shards), shards, {"order": o, "start": join(1).astype("<u4"), "times": join(2).astype("<u4")}, COVERED)])

    return run


def _removed(kind: pa.DataType):
    def run(key: tuple, docs: pa.Table, covered: pa.Table) -> pa.Table:
        """What is left of each document of a shard."""
        x = _read(covered, COVERED, {"order": "<i8", "start": "<u4", "times": "<u4"})
        o, a, b = _merged(x["order"], x["start"].astype(np.int64), x["times"].astype(np.int64))
        edge = np.flatnonzero(np.append(True, o[1:] != o[:-1])) if len(o) else np.zeros(0, np.int64)
        spans = {int(o[i]): (i, j) for i, j in zip(edge.tolist(), np.append(edge[1:], len(o))[: len(edge)].tolist(), strict=True)}
        unpack = zstandard.ZstdDecompressor().decompress
        out: list[tuple[int, int, int, str, list[dict]]] = []
        for order, packed in zip(docs.column("order").to_pylist(), docs.column("packed"), strict=True):
            text = unpack(packed.as_py())
            i, j = spans.get(order, (0, 0))
            cuts = list(zip(a[i:j].tolist(), b[i:j].tolist(), strict=True))
            sha, at = hashlib.sha256(), 0
            for s, e in cuts:
                sha.update(text[at:s])
                at = e
            sha.update(text[at:])
            out.append((len(text), sum(e - s for s, e in cuts), len(cuts), sha.hexdigest(), [{"start": s, "end": e} for s, e in cuts]))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), span)
        names = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")
        return pa.table({"doc_id": docs.column("doc_id").cast(kind), **{n: pa.array([r[k] for r in out], t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}})

    return run


def _ordered(docs: DataFrame) -> DataFrame:
    """(order, doc_id, text) with a number of its own for each row, rising with doc_id; repeated ids by their texts, null ones last."""
    rows = docs.select("doc_id", "text")
    known = rows.agg(F.count("doc_id"), F.count(F.lit(1)), F.max("doc_id")).first()
    if known[0] == known[1] and rows.groupBy("doc_id").count().where("count > 1").isEmpty():
        return rows.select(F.col("doc_id").cast("long").alias("order"), "doc_id", "text")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text")) - 1
    counted = stored(rows.withColumn("_k", number), "repeat-rows")
    most = counted.agg(F.max("_k")).first()[0] + 1
    last = F.coalesce(F.col("doc_id").cast("long"), F.lit((known[2] or 0) + 1))
    return counted.select((last * most + F.col("_k")).cast("long").alias("order"), "doc_id", "text")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per document.

    A byte goes if a string of WIDTH bytes that covers it also starts earlier: in a document of smaller doc_id, or in
    the same one before it. spans are the maximal removed runs [start, end). Null text counts as empty; texts shorter
    than WIDTH stay whole. Of repeated doc_ids the order of the texts' hashes decides, null doc_ids are last. An empty
    table gives an empty result; other columns are not read. Contexts are told apart by 128 bits of hash.
    """
    shards = fan_out(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = _ordered(docs)
    seeded = rows.select("order", "text").mapInArrow(_found(shards), _BLOBS)
    told = stored(seeded.groupBy("shard").applyInArrow(_rivals(shards), _BLOBS), "repeat-told")
    texts = rows.mapInArrow(_packed(shards), f"shard int, order long, doc_id {kind}, packed binary")
    wanted = told.where(F.col("kind") == WANTED).groupBy("shard").cogroup(texts.select("shard", "order", "packed").groupBy("shard"))
    cut = wanted.applyInArrow(_cut(shards), "shard int, seed binary, order binary, start binary, times binary, bytes binary")
    more = cut.groupBy("shard").applyInArrow(_compared(shards), _BLOBS)
    covered = told.where(F.col("kind") == COVERED).union(more).select("shard", "kind", "order", "start", "times")
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "string": pa.string()}[kind]
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    return texts.groupBy("shard").cogroup(covered.groupBy("shard")).applyInArrow(_removed(arrow), out)
