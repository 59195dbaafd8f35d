"""Encoding and decoding by pieces: unigram Viterbi over a double-array trie, byte fallback, white-space marker."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import sliced

MARK = "▁".encode()
#: A byte that UTF-8 never has stands for a marker that the text itself holds; it is encoded by bytes.
_OWN_MARK = b"\xff"
UNKNOWN_PENALTY = 10.0
#: Units whose ids a worker remembers; then it begins anew.
MEMORY = 400_000
#: Bytes of units that are searched together and remembered; longer ones are rare and searched one by one.
TOGETHER = 96


class DoubleArray:
    """A trie of byte strings: child = base[node] + byte + 1, valid if check[child] is node; value holds piece ids."""

    def __init__(self, keys: dict[bytes, int]):
        ordered = sorted(keys)
        size = 1 << 16
        self.base, self.check, self.value = [0] * size, [-1] * size, [-1] * size
        self.check[0] = 0
        free, wide_from = 257, 257
        work = [(0, 0, len(ordered), 0)] if ordered else []
        while work:
            node, lo, hi, depth = work.pop()
            if len(ordered[lo]) == depth:
                self.value[node] = keys[ordered[lo]]
                lo += 1
            if lo == hi:
                continue
            edges, at = [], lo
            while at < hi:
                b, to = ordered[at][depth], at
                while to < hi and ordered[to][depth] == b:
                    to += 1
                edges.append((b, at, to))
                at = to
            while self._slot(free):
                free += 1
            #: Nodes of many edges are not tried again where such nodes have found no room.
            spot = free if len(edges) == 1 else max(free, wide_from)
            tries = 0
            while self._slot(spot) or any(self._slot(spot - edges[0][0] + b) for b, _, _ in edges):
                spot += 1
                tries += 1
            if len(edges) > 1 and tries > 8:
                wide_from = spot
            base = spot - edges[0][0] - 1
            self.base[node] = base
            for b, at, to in edges:
                child = base + b + 1
                self.check[child] = node
                work.append((child, at, to, depth + 1))

    def _slot(self, at: int) -> bool:
        """Whether a slot is taken; the arrays always go a byte's range beyond any slot asked for."""
        if at + 257 >= len(self.check):
            grow = len(self.check)
            self.base += [0] * grow
            self.check += [-1] * grow
            self.value += [-1] * grow
        return self.check[at] >= 0


class Pieces:
    """A vocabulary of pieces with log scores."""

    def __init__(self, pieces: list[tuple[bytes, float]], kinds: list[str]):
        """kinds: of each piece "normal", "byte" (its piece is that one byte) or "other", which no text becomes."""
        self.bytes = [p if k != "other" else b"" for (p, _), k in zip(pieces, kinds, strict=True)]
        self.scores = [s for _, s in pieces]
        self.byte_id = {p[0]: i for i, ((p, _), k) in enumerate(zip(pieces, kinds, strict=True)) if k == "byte"}
        normal = {p: i for i, ((p, _), k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        self.trie = DoubleArray(normal)
        self.unknown = min(self.scores[i] for i in normal.values()) - UNKNOWN_PENALTY
        #: Where no piece goes across, a text may be cut and each unit encoded alone.
        cut_space = not any(re.search(rb"[^ ] ", p.replace(MARK, b" ")) for p in normal)
        cut_line = not any(b"\n" in p for p in normal)
        self.unit = re.compile((rb" *[^ \n]+| +|\n" if cut_line else rb" *[^ ]+| +") if cut_space else rb"(?s).+")
        self.shown = [p if k == "byte" else p.replace(MARK, b" ") for p, k in zip(self.bytes, kinds, strict=True)]
        self.is_byte = np.array([k == "byte" for k in kinds])
        self.memory: dict[bytes, bytes] = {}

    @classmethod
    def from_model(cls, path: str) -> Pieces:
        """The pieces of a sentencepiece model file; their scores are taken as log probabilities, whatever its kind."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, kinds = [], []
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            if model.is_byte(i):
                pieces.append((bytes([int(name[1:-1], 16)]), 0.0))
                kinds.append("byte")
            else:
                pieces.append((name.encode(), model.get_score(i)))
                kinds.append("other" if model.is_control(i) or model.is_unknown(i) or model.is_unused(i) else "normal")
        return cls(pieces, kinds)

    def best(self, unit: bytes) -> list[int]:
        """The ids of the path of the highest sum of scores; of equal paths the one whose pieces start first from the end.

        A character that is no piece costs `unknown` and becomes its bytes.
        """
        base, check, value, scores = self.trie.base, self.trie.check, self.trie.value, self.scores
        n = len(unit)
        total: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        total[0] = 0.0
        i = 0
        while i < n:
            lead = unit[i]
            width = 1 if lead < 0xC0 or lead == 0xFF else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            so_far = total[i]
            if so_far is not None:
                node, single = 0, False
                for j in range(i, n):
                    child = base[node] + unit[j] + 1
                    if check[child] != node:
                        break
                    node = child
                    piece = value[node]
                    if piece >= 0:
                        score = so_far + scores[piece]
                        old = total[j + 1]
                        if old is None or score > old:
                            total[j + 1] = score
                            back[j + 1] = (i, piece)
                        if j + 1 - i == width:
                            single = True
                if not single:
                    to = min(n, i + width)
                    score = so_far + self.unknown
                    old = total[to]
                    if old is None or score > old:
                        total[to] = score
                        back[to] = (i, -1)
            i += width
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            if piece >= 0:
                out.append(piece)
            else:
                raw = MARK if unit[start:at] == _OWN_MARK else unit[start:at]
                out.extend(self.byte_id[b] for b in reversed(raw))
            at = start
        return out[::-1]

    def best_of_many(self, units: list[bytes]) -> list[list[int]]:
        """best() of each unit; all units take each step together."""
        arrays = self._arrays()
        base, check, value, scores, width_of = arrays
        lengths = np.array([len(u) for u in units])
        longest, n = int(lengths.max()), len(units)
        text = np.frombuffer(b"".join(u.ljust(longest, b"\0") for u in units), np.uint8).reshape(n, longest).astype(np.int64)
        total = np.full((n, longest + 5), -np.inf)
        total[:, 0] = 0.0
        piece_at = np.full((n, longest + 5), -1, np.int32)
        from_at = np.zeros((n, longest + 5), np.int32)
        for i in range(longest):
            rows = np.flatnonzero((lengths > i) & (total[:, i] > -np.inf))
            if not len(rows):
                continue
            begun, width = rows, width_of[text[rows, i]]
            single = np.zeros(n, bool)
            wide = np.zeros(n, np.int64)
            wide[rows] = width
            node = np.zeros(len(rows), np.int64)
            for j in range(i, longest):
                inside = lengths[rows] > j
                rows, node = rows[inside], node[inside]
                child = base[node] + text[rows, j] + 1
                ok = check[child] == node
                rows, node = rows[ok], child[ok]
                if not len(rows):
                    break
                piece = value[node]
                has = piece >= 0
                hit, piece = rows[has], piece[has]
                score = total[hit, i] + scores[piece]
                better = score > total[hit, j + 1]
                hit = hit[better]
                total[hit, j + 1] = score[better]
                piece_at[hit, j + 1] = piece[better]
                from_at[hit, j + 1] = i
                single[rows[has]] |= wide[rows[has]] == j + 1 - i
            lost = begun[~single[begun]]
            to = np.minimum(lengths[lost], i + wide[lost])
            score = total[lost, i] + self.unknown
            better = score > total[lost, to]
            lost, to = lost[better], to[better]
            total[lost, to] = score[better]
            piece_at[lost, to] = -1
            from_at[lost, to] = i
        paths: list[list[int]] = [[] for _ in units]
        steps, at, odd = [], lengths.copy(), np.zeros(n, bool)
        rows = np.arange(n)
        while len(rows):
            piece = piece_at[rows, at[rows]]
            odd[rows[piece < 0]] = True
            steps.append((rows, piece))
            at[rows] = from_at[rows, at[rows]]
            rows = rows[at[rows] > 0]
        for rows, piece in reversed(steps):
            for r, p in zip(rows.tolist(), piece.tolist(), strict=True):
                paths[r].append(p)
        for r in np.flatnonzero(odd).tolist():
            paths[r] = self.best(units[r])
        return paths

    def _arrays(self) -> tuple[np.ndarray, ...]:
        if not hasattr(self, "_tables"):
            lead = np.arange(256)
            width = np.where((lead < 0xC0) | (lead == 0xFF), 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            self._tables = (*(np.array(x, np.int64) for x in (self.trie.base, self.trie.check, self.trie.value)), np.array(self.scores, np.float64), width)
        return self._tables

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. A text that isn't empty begins with one more space."""
        units = [self.unit.findall(b" " + t) if t else [] for t in texts]
        seen = set().union(*units)
        new = [u for u in seen if u not in self.memory]
        if len(self.memory) + len(new) > MEMORY:
            self.memory.clear()
            new = list(seen)
        marked = {u: u.replace(MARK, _OWN_MARK).replace(b" ", MARK) for u in new}
        new.sort(key=lambda u: len(marked[u]))
        once: dict[bytes, bytes] = {}
        at = 0
        while at < len(new):
            to = at + 1
            limit = len(marked[new[at]]) + 4
            while to < len(new) and to - at < 4096 and len(marked[new[to]]) <= limit:
                to += 1
            group = new[at:to]
            short = limit <= TOGETHER
            paths = self.best_of_many([marked[u] for u in group]) if short and len(group) > 8 else [self.best(marked[u]) for u in group]
            (self.memory if short else once).update((u, np.array(p, "<i4").tobytes()) for u, p in zip(group, paths, strict=True))
            at = to
        known = self.memory.get
        return [b"".join([known(u) or once[u] for u in us]) for us in units]

    def encode(self, text: bytes) -> bytes:
        return self.encode_many([text])[0]

    def decode(self, ids: Iterable[int]) -> bytes:
        shown = self.shown
        return b"".join([shown[i] for i in ids])[1:]


def _batches(pieces):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces.value
        for batch, texts in sliced(batches, "text", 2 << 20):
            coded = model.encode_many(texts)
            ids = np.frombuffer(b"".join(coded), "<i4")
            ends = np.cumsum([0] + [len(c) // 4 for c in coded])
            back = [model.decode(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            fallen = np.concatenate([[0], np.cumsum(model.is_byte[ids])])
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            out = {
                "doc_id": batch.column("doc_id"), "n_ids": pa.array(np.diff(ends)), "n_byte_ids": pa.array(fallen[ends[1:]] - fallen[ends[:-1]]), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids)),
                "ids_sha256": sha(coded), "decoded_sha256": sha(back), "round_trip": pa.array([a == b for a, b in zip(texts, back, strict=True)]),
            }
            yield pa.RecordBatch.from_pydict(out)

    return run


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, n_ids, n_byte_ids, ids, ids_sha256, decoded_sha256, round_trip), one row per document.

    Null and empty texts have no ids. Spaces become the marker, every other byte that no piece covers a byte piece, so
    decoding gives each text back, also one that holds the marker. Only the vocabulary, of fixed size, is broadcast.
    ids_sha256 is over the ids as little-endian 32-bit numbers. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Pieces.from_model(model_path))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_ids long, n_byte_ids long, ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(_batches(shared), schema)
