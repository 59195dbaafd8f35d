"""Language ID: scripts narrow the candidates, Viterbi with a switching penalty labels spans of words."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER, SPACE, mix, pieces, sliced, spans_hashed, word_bounds
from .toxicity import held_out

#: Buckets of letter trigrams and of whole words; documents that are learned from at most, those of the smallest hashes.
BITS, SAMPLE = 15, 8_000
#: What a change of language costs, in nats; what a word costs in a language that isn't written in its script.
SWITCH, FOREIGN = 8.0, 40.0
#: The least part of a language's words in a script that makes it one of the language's scripts.
OWN_SCRIPT = 0.01
#: Words that are searched together; from WIDE candidates on, texts are searched word by word, side by side.
STEP, WIDE = 32, 16

#: Code point ranges of scripts.
SCRIPTS = (
    ("Latin", 0x41, 0x5A), ("Latin", 0x61, 0x7A), ("Latin", 0xC0, 0x24F), ("Greek", 0x370, 0x3FF), ("Cyrillic", 0x400, 0x4FF), ("Hebrew", 0x590, 0x5FF), ("Arabic", 0x600, 0x6FF),
    ("Indic", 0x900, 0xDFF), ("Thai", 0xE00, 0xE7F), ("Kana", 0x3040, 0x30FF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7AF),
)


def _script_tables() -> tuple[np.ndarray, np.ndarray]:
    """The bit of each byte's script where the first byte of UTF-8 tells it, and of each first two bytes beyond."""
    names = list(dict.fromkeys(n for n, _, _ in SCRIPTS))
    one, two = np.zeros(256, np.uint16), np.zeros(1 << 16, np.uint16)
    for name, first, last in SCRIPTS:
        bit = np.uint16(1 << names.index(name))
        for c in range(first, last + 1):
            raw = chr(c).encode("utf-8", "surrogatepass")
            if len(raw) == 1:
                one[raw[0]] |= bit
            else:
                two[raw[0] << 8 | raw[1]] |= bit
    return one, two


_ONE, _TWO = _script_tables()


def distinct_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """(number of the distinct word at each place, where texts begin, trigram buckets etc. of the distinct words).

    Of each distinct word: its word bucket, the trigram buckets with their owners, and its scripts' bits.
    """
    hashes, scripts, grams, gram_of, base = [], [], [], [], 0
    counts = np.zeros(len(texts) + 1, np.int64)
    for first, last, joined in pieces(texts):
        buf = LOWER[np.frombuffer(b" " + joined + b" ", np.uint8)]
        buf[SPACE[buf]] = 0x20  # a word's edge trigrams are the same beside any white space
        starts, ends = word_bounds(buf)
        if last - first == 1:
            counts[first + 1] += len(starts)
        else:
            edges = np.cumsum([len(t) + 1 for t in texts[first:last]]) + 1
            counts[first + 1 : last + 1] += np.diff(np.searchsorted(starts, edges), prepend=0)
        if not len(starts):
            continue
        h = spans_hashed(buf, starts, ends)
        _, at, back = np.unique(h, return_index=True, return_inverse=True)
        hashes.append((h[at], back + base))
        wide = buf.astype(np.uint32)
        bits = _ONE[buf]
        bits[:-1] |= _TWO[wide[:-1] << 8 | wide[1:]]
        lengths = (ends - starts)[at]
        place = np.repeat(starts[at] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        code = (wide[place - 1] << np.uint32(16) | wide[place] << np.uint32(8) | wide[place + 1]) * np.uint32(0x9E3779B1)
        grams.append((code >> np.uint32(32 - BITS)).astype(np.int32))
        gram_of.append(np.repeat(np.arange(len(at)) + base, lengths))
        scripts.append(np.bitwise_or.reduceat(bits[place], np.cumsum(lengths) - lengths))
        base += len(at)
    join = lambda xs, kind: np.concatenate(xs) if xs else np.zeros(0, kind)
    words = (mix(join([h for h, _ in hashes], np.uint64)) >> np.uint64(64 - BITS)).astype(np.int32)
    return join([b for _, b in hashes], np.int64), np.cumsum(counts), [words, join(grams, np.int32), join(gram_of, np.int64)], join(scripts, np.uint16)


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts by language: trigram buckets, then word buckets, then words with each script's bit."""
    for batch, texts in sliced(batches, "text", 1 << 20):
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            number, _, (word, gram, of), script = distinct_words([t for t, x in zip(texts, langs, strict=True) if x == lang])
            times = np.bincount(number, minlength=len(word))
            out = np.bincount(gram, times[of], 1 << BITS), np.bincount(word, times, 1 << BITS), np.array([times[(script >> np.uint16(b)) & np.uint16(1) == 1].sum() for b in range(16)])
            flat = np.concatenate(out).astype(np.int64)
            found = np.flatnonzero(flat)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(found)), "bucket": pa.array(found, pa.int32()), "n": pa.array(flat[found])})


class Model:
    """Log probabilities of buckets by language, and each language's scripts."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        n = 1 << BITS
        logs = lambda c: np.log((c + 0.5) / (c.sum(axis=1, keepdims=True) + 0.5 * n)).T
        self.grams, self.words = (logs(counts[:, a : a + n]).astype(np.float32) for a in (0, n))
        scripts = counts[:, 2 * n :]
        own = scripts >= OWN_SCRIPT * np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.scripts = (own * (1 << np.arange(16))).sum(axis=1).astype(np.uint16)

    def word_scores(self, word: np.ndarray, gram: np.ndarray, of: np.ndarray, script: np.ndarray) -> np.ndarray:
        """A row of log scores for each distinct word; all zero for a word without a letter of a known script."""
        sums = np.add.reduceat(self.grams[gram], np.searchsorted(of, np.arange(len(word))), axis=0) if len(word) else np.zeros((0, len(self.langs)))
        scores = (sums * 0.5 + self.words[word]).astype(np.float64)
        fits = (script[:, None] & self.scripts[None, :]) != 0
        scores -= FOREIGN * (~fits & fits.any(axis=1, keepdims=True))
        scores[script == 0] = 0.0
        return scores - scores.max(axis=1, keepdims=True, initial=-1e9)


def viterbi(scores: np.ndarray, at: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The state of each row on each text's best path: row scores less penalty at each change.

    Texts are cut into STEP rows. All cuts go forward at once for every state before them; then the cuts of each text
    are joined in order, forward and back. That takes a table of states by states for each cut, so many states go
    another way with the same result. There may be 2**15 - 1 states.
    """
    n_states = scores.shape[1]
    if n_states > WIDE:
        return _side_by_side(scores, at, penalty)
    lengths = np.diff(at)
    cuts = -(-lengths // STEP)
    first = np.cumsum(cuts) - cuts
    total = int(cuts.sum())
    if not total:
        return np.zeros(0, np.int64)
    row = np.arange(len(scores))
    text = np.repeat(np.arange(len(lengths)), lengths)
    inside = row - at[text]
    cut, step = first[text] + inside // STEP, inside % STEP
    table = np.zeros((STEP, total, n_states))
    table[step, cut] = scores
    #: way[c, e, s]: the best score of cut c that ends in s when e came before it.
    way = np.where(np.eye(n_states, dtype=bool), 0.0, -penalty)[None] + table[0][:, None, :]
    for t in range(1, STEP):
        way = np.maximum(way, way.max(axis=2, keepdims=True) - penalty) + table[t][:, None, :]
    before = np.zeros((total, n_states))
    rank = np.argsort(-cuts, kind="stable")
    ordered = cuts[rank]
    for k in range(1, int(ordered[0])):
        c = first[rank[: np.searchsorted(-ordered, -k)]] + k
        before[c] = (before[c - 1][:, :, None] + way[c - 1]).max(axis=1)
        before[c] -= before[c].max(axis=1, keepdims=True)
    state, back = before, np.zeros((STEP, total, n_states), np.int16)
    for t in range(STEP):
        best = state.argmax(axis=1)
        switched = state.max(axis=1, keepdims=True) - penalty
        back[t] = np.where(switched > state, best[:, None], np.arange(n_states)[None, :])
        state = np.maximum(state, switched) + table[t]
    origin = np.tile(np.arange(n_states), (total, 1))
    for t in range(STEP - 1, -1, -1):
        origin = np.take_along_axis(back[t], origin, axis=1).astype(np.int64)
    end = state.argmax(axis=1)
    for k in range(int(ordered[0]) - 1, 0, -1):
        c = first[rank[: np.searchsorted(-ordered, -k)]] + k
        end[c - 1] = origin[c, end[c]]
    labels = np.zeros((STEP, total), np.int64)
    for t in range(STEP - 1, -1, -1):
        labels[t] = end
        end = back[t][np.arange(total), end]
    return labels[step, cut]


def _side_by_side(scores: np.ndarray, at: np.ndarray, penalty: float) -> np.ndarray:
    """viterbi with one step for each place in the texts, of all texts that are long enough."""
    lengths = np.diff(at)
    rank = np.argsort(-lengths, kind="stable")
    live = [rank[:k] for k in np.searchsorted(-lengths[rank], -np.arange(int(lengths.max(initial=0))), side="left").tolist()]
    state, back = np.zeros((len(lengths), scores.shape[1])), np.zeros(scores.shape, np.int16)
    for t, now in enumerate(live):
        before, row = state[now], at[now] + t
        if t:
            switched = before.max(axis=1, keepdims=True) - penalty
            back[row] = np.where(switched > before, before.argmax(axis=1)[:, None], np.arange(scores.shape[1])[None, :])
            before = np.maximum(before, switched)
        state[now] = before + scores[row]
    end, labels = state.argmax(axis=1), np.zeros(len(scores), np.int64)
    for t in range(len(live) - 1, -1, -1):
        row = at[live[t]] + t
        labels[row] = end[live[t]]
        end[live[t]] = back[row, end[live[t]]]
    return labels


def narrowed(model: Model, number: np.ndarray, at: np.ndarray, scores: np.ndarray, script: np.ndarray) -> np.ndarray:
    """Each word's language. Only languages that are written in some script of a text are candidates for its words."""
    whole = np.zeros(len(at) - 1, np.uint16)
    some = np.flatnonzero(np.diff(at))
    if len(some):
        whole[some] = np.bitwise_or.reduceat(script[number], at[some])
    labels = np.zeros(len(number), np.int64)
    fits = lambda mask: np.flatnonzero((model.scripts & mask) != 0)
    groups: dict[tuple[int, ...], list[int]] = {}
    for mask in np.unique(whole).tolist():
        chosen = fits(np.uint16(mask))
        groups.setdefault(tuple((chosen if len(chosen) else np.arange(len(model.langs))).tolist()), []).append(mask)
    for chosen, masks in groups.items():
        texts = np.flatnonzero(np.isin(whole, masks))
        lengths = np.diff(at)[texts]
        row = np.repeat(at[texts] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        if len(row):
            found = viterbi(scores[np.ix_(number[row], chosen)], np.append(0, np.cumsum(lengths)))
            labels[row] = np.array(chosen)[found]
    return labels


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Counts of a bounded sample of the training documents with a language; at most 2**16 numbers a language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.select("doc_id").withColumn("_seeded", F.xxhash64("doc_id", F.lit(5))).orderBy("_seeded", "doc_id").limit(sample)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id").select("lang", "text")
    counts = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counts.column("lang").to_pylist()
    langs = sorted(set(names))
    place = {x: i for i, x in enumerate(langs)}
    table = np.zeros((len(langs), 2 * (1 << BITS) + 16))
    table[[place[x] for x in names], counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return Model(langs, table)


def _spanned(shared):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch, texts in sliced(batches, "text", 1 << 20):
            n, size = len(texts), max(1, len(model.langs))
            number, at, (word, gram, of), script = distinct_words(texts)
            lettered = script[number] != 0 if len(number) else np.zeros(0, bool)
            owner = np.repeat(np.arange(n), np.diff(at))
            if model.langs and len(number):
                labels = narrowed(model, number, at, model.word_scores(word, gram, of, script), script)
            else:
                labels = np.zeros(len(number), np.int64)
            votes = np.bincount(owner[lettered] * size + labels[lettered], minlength=n * size).reshape(n, size)
            winner, words = votes.argmax(axis=1), votes.sum(axis=1)
            edge = np.ones(len(labels), bool)
            edge[1:] = (labels[1:] != labels[:-1]) | (owner[1:] != owner[:-1])
            begin = np.flatnonzero(edge)
            end = np.append(begin[1:], len(labels))[: len(begin)]
            span_at = np.searchsorted(owner[begin], np.arange(n + 1)) if len(begin) else np.zeros(n + 1, np.int64)
            start_of = at[owner[begin]] if len(begin) else begin
            pred, score = [], []
            for i, t in enumerate(texts):
                und = not model.langs or not words[i] and not any(c.isalpha() for c in t.decode("utf-8", "replace"))
                pred.append("und" if und else model.langs[winner[i]])
                score.append(0.0 if und or not words[i] else float(votes[i, winner[i]] / words[i]))
            names = np.array(model.langs or ["und"], object)
            spans = pa.ListArray.from_arrays(pa.array(span_at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - start_of, pa.int32()), pa.array(end - start_of, pa.int32()), pa.array(names[labels[begin]], pa.string())], ["first_word", "end_word", "lang"]))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(pred), "score": pa.array(score, pa.float64()), "spans": spans})

    return run


def label(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, spans), one row per document.

    spans: [first_word, end_word) by language, on the best path of the word scores; a word without a letter goes with
    its neighbours. lang_pred has most words with letters, the first in code point order of equal ones, and score is
    its part of them; letters of no known script give score 0. Null, empty and letterless texts are "und" with score 0,
    and so is everything without a learned language. The broadcast model has 2**16 numbers a language. Repeated rows
    are rows of their own, an empty table gives an empty result, and other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, spans array<struct<first_word:int,end_word:int,lang:string>>"
    return rows.mapInArrow(_spanned(shared), schema)
