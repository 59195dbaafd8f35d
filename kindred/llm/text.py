"""Words of many texts at once: bytes in one numpy array, hashes from prefix sums."""

from __future__ import annotations

import contextlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are turned into arrays at once; a longer run without white space is taken whole.
SLICE = 1 << 20

#: The white space of the contracts: [\x20\x09-\x0D].
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

#: LOWER, with ASCII punctuation as white space.
LETTERS = LOWER.copy()
LETTERS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 0x20

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[:] = out
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """The finalizer of a 64-bit hash: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def spans_hashed(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each buf[start:end]; equal bytes give equal hashes at any place."""
    up, down = powers(len(buf) + 1)
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without white space."""
    inside = np.zeros(len(buf) + 2, np.int8)
    inside[1:-1] = ~SPACE[buf]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(first, last, bytes): joined texts first..last-1 of about SLICE bytes, or a part of one text that is longer.

    Parts of a long text end at white space, so that no word is cut.
    """
    i = 0
    while i < len(texts):
        if len(texts[i]) > SLICE:
            text, at = texts[i], 0
            while at < len(text):
                to = min(at + SLICE, len(text))
                while to < len(text) and not SPACE[text[to]]:
                    to += 1
                yield i, i + 1, text[at:to]
                at = to
            i += 1
            continue
        j, size = i, 0
        while j < len(texts) and len(texts[j]) <= SLICE and (j == i or size + len(texts[j]) <= SLICE):
            size += len(texts[j]) + 1
            j += 1
        yield i, j, b"\n".join(texts[i:j])
        i = j


def words_hashed(texts: list[bytes], fold: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, in order, and where each text's words begin (one entry more than texts).

    fold: the byte that stands for each byte.
    """
    hashes, counts = [], np.zeros(len(texts) + 1, np.int64)
    for first, last, joined in pieces(texts):
        buf = fold[np.frombuffer(joined, np.uint8)]
        starts, ends = word_bounds(buf)
        hashes.append(spans_hashed(buf, starts, ends))
        if last - first == 1:
            counts[first + 1] += len(starts)
        else:
            edges = np.cumsum([len(t) + 1 for t in texts[first:last]])
            counts[first + 1 : last + 1] += np.diff(np.searchsorted(starts, edges), prepend=0)
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), np.cumsum(counts)


def release() -> None:
    """Gives freed memory back to the system, as workers live on from task to task."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sliced(batches: Iterable[pa.RecordBatch], column: str, size: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about size bytes of text, with these texts as bytes; small batches are joined."""
    held: list[pa.RecordBatch] = []
    total = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
        at = 0
        while at < batch.num_rows:
            reach = np.cumsum(lengths[at:]) + total
            n = int(np.searchsorted(reach, size)) + 1
            part = batch.slice(at, n)
            held.append(part)
            total = int(reach[part.num_rows - 1])
            at += part.num_rows
            if total >= size:
                yield _joined(held, column)
                held, total = [], 0
    if held:
        yield _joined(held, column)
    release()


def _joined(held: list[pa.RecordBatch], column: str) -> tuple[pa.RecordBatch, list[bytes]]:
    batch = held[0] if len(held) == 1 else pa.concat_batches(held)
    return batch, text_bytes(batch.column(column))
