"""Each operator against a plain version, and on odd rows: nulls, empty and very long texts, ties, repeats, extra columns."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.llm import bloomlm, chat, exact, language, mixing, pieces, repeats, shingles, spots, suffixes, text, toxicity
from kindred.llm.graph import components
from kindred.llm.queries import MODEL

from .conftest import LONG, ROWS, SF, same_on_all

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def sha(b):
    return hashlib.sha256(b).hexdigest()


def by_id(rows):
    return {r["doc_id"]: r for r in rows}


# words


@settings(deadline=None)
@given(st.lists(st.text("aB \n.é", max_size=30), max_size=6))
def test_words_hashed_equal_only_for_equal_words(texts):
    h, at = text.words_hashed([t.encode() for t in texts])
    plain = [words(t) for t in texts]
    assert np.diff(at).tolist() == [len(w) for w in plain]
    names = defaultdict(set)
    for x, w in zip(h.tolist(), [w for ws in plain for w in ws], strict=True):
        names[x].add(w)
    assert all(len(v) == 1 for v in names.values()) and len(names) == len({w for ws in plain for w in ws})


def test_long_texts_are_cut_at_white_space(monkeypatch):
    whole = text.words_hashed([LONG.encode(), b"", b"x y"])
    monkeypatch.setattr(text, "SLICE", 1000)
    cut = text.words_hashed([LONG.encode(), b"", b"x y"])
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_sliced_joins_and_cuts():
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(["a" * 5, None, "b" * 30]), "k": pa.array([1, 2, 3])}), pa.RecordBatch.from_pydict({"text": pa.array(["c"]), "k": pa.array([4])})]
    found = [(b.column("k").to_pylist(), t) for b, t in text.sliced(batches, "text", 10)]
    assert [k for ks, _ in found for k in ks] == [1, 2, 3, 4] and [x for _, t in found for x in t] == [b"aaaaa", b"", b"b" * 30, b"c"]


# 1


@settings(deadline=None, max_examples=60)
@given(st.lists(st.binary(max_size=25).map(lambda b: bytes(1 + x % 3 for x in b)), min_size=1, max_size=5))
def test_suffix_array_and_prefixes(strings):
    t = np.frombuffer(b"".join(s + b"\0" for s in strings), np.uint8)
    raw = t.tobytes()
    order = suffixes.suffix_array(t)
    suffix = [raw[i : raw.index(b"\0", i)] for i in range(len(raw))]
    assert sorted(order.tolist()) == list(range(len(raw))) and [suffix[i] for i in order] == sorted(suffix)
    common = suffixes.common_prefixes(t, order)
    for a, b in zip(order[:-1], order[1:], strict=True):
        assert common[b] == next((k for k, (x, y) in enumerate(zip(suffix[a], suffix[b], strict=False)) if x != y), min(len(suffix[a]), len(suffix[b])))


def plain_repeats(rows):
    """rows: (doc_id, bytes) in order."""
    seen, out = set(), []
    for _, x in rows:
        gone = bytearray(len(x))
        for p in range(len(x) - 99):
            w = x[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(w)
        out.append((len(x), sum(gone), len(re.findall(b"\1+", bytes(gone))), sha(bytes(c for c, g in zip(x, gone, strict=True) if not g))))
    return out


def test_repeats(documents):
    found = by_id(repeats.remove_repeats(documents).collect())
    rows = sorted((r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect())
    assert [tuple(found[i][1:5]) for i, _ in rows] == plain_repeats(rows)


def test_repeats_of_odd_rows(odd, wide, none):
    found = same_on_all(lambda d: repeats.remove_repeats(d), odd, wide, none)
    assert len(found) == len(ROWS)
    by = defaultdict(list)
    for r in found:
        by[r["doc_id"]].append(tuple(r[1:5]))
    long = LONG.encode()
    assert by[3] == by[4] == [(0, 0, 0, sha(b""))]
    first = ROWS[0][1].encode()
    assert len(first) >= 100
    assert sorted(by[1]) == sorted([(len(first), 0, 0, sha(first)), (len(first), len(first), 1, sha(b""))])
    assert by[13][0][:3] == (400, 400, 1)
    assert by[10][0][:2] == plain_repeats([(9, long), (10, long + b" end")])[1][:2]


def test_repeats_across_ranges(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = bytes(rng.integers(97, 123, 700).astype(np.uint8))
    rows = [(1, x), (2, x[50:400] + b"#" + x[100:260]), (3, b"#" * 30 + x[300:650])]
    monkeypatch.setattr(repeats, "RANGE", 128)
    cut = repeats.contexts([r[1] for r in rows])
    monkeypatch.undo()
    whole = repeats.contexts([r[1] for r in rows])
    assert cut[2].sum() == whole[2].sum() == sum(len(r[1]) - 99 for r in rows)
    df = spark.createDataFrame([(i, b.decode()) for i, b in rows], "doc_id long, text string")
    assert [tuple(r[1:5]) for r in repeats.remove_repeats(df).orderBy("doc_id").collect()] == plain_repeats(rows)


def test_repeats_far_into_a_long_text(spark):
    """Places beyond 2^24 in what is looked at together."""
    x = bytes(np.random.default_rng(0).integers(97, 123, (1 << 24) + 5000).astype(np.uint8))
    at = (1 << 24) + 1000
    text, offset, times, seed, content = repeats.contexts([x[:3000], x])
    far = (text == 1) & (offset >= at)
    tail = repeats.contexts([x[at:]])
    assert set(zip(seed[far].tolist(), content[far].tolist(), strict=True)) >= set(zip(tail[3][1:].tolist(), tail[4][1:].tolist(), strict=True))
    assert times[text == 1].sum() == len(x) - 99
    df = spark.createDataFrame([(1, x.decode()), (2, "#" + x[at : at + 300].decode() + "#"), (3, x[5000:5300].decode())], "doc_id long, text string")
    found = by_id(repeats.remove_repeats(df).collect())
    assert [tuple(found[i][1:4]) for i in (1, 2, 3)] == [(len(x), 0, 0), (302, 300, 1), (300, 300, 1)]


# 2


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Pieces.from_model(MODEL)


def plain_best(model, unit):
    """The best path by looking at every piece in a dictionary."""
    table = {p.replace(b" ", pieces.MARK): (i, model.scores[i]) for i, p in enumerate(model.shown) if p and not model.is_byte[i]}
    chars = [c.encode() for c in unit.decode()]
    total = [0.0] + [-math.inf] * len(chars)
    for i in range(len(chars)):
        single = b"".join(chars[i : i + 1]) in table
        for j in range(i + 1, len(chars) + 1):
            p = b"".join(chars[i:j])
            if p in table:
                total[j] = max(total[j], total[i] + table[p][1])
        if not single:
            total[i + 1] = max(total[i + 1], total[i] + model.unknown)
    return total[-1]


def test_pieces_find_the_best_path(vocabulary):
    m = vocabulary
    units = [u.replace(b" ", pieces.MARK) for u in (b" thanedble", "▁x".encode(), " Éçment".encode(), " 漢字🎉z".encode(), b"  a", b" ")]
    for u, together in zip(units, m.best_of_many(units), strict=True):
        ids = m.best(u)
        assert together == ids
        score = sum(m.scores[i] for i in ids if not m.is_byte[i])
        fallen = sum(m.shown[i][0] & 0xC0 != 0x80 for i in ids if m.is_byte[i])  # characters that became bytes
        assert score + fallen * m.unknown == pytest.approx(plain_best(m, u)), u


def test_pieces_trie_holds_all_keys_and_no_more():
    keys = {b"a": 1, b"ab": 2, b"b": 3, b"abcde": 4, bytes(range(1, 200)): 5}
    t = pieces.DoubleArray(keys)

    def find(k):
        node = 0
        for b in k:
            child = t.base[node] + b + 1
            if child >= len(t.check) or t.check[child] != node:
                return -1
            node = child
        return t.value[node]

    assert {k: find(k) for k in keys} == keys and find(b"abc") == -1 and find(b"c") == -1


@settings(deadline=None, max_examples=50)
@given(t=st.text(max_size=40))
def test_pieces_round_trip(vocabulary, t):
    ids = np.frombuffer(vocabulary.encode(t.encode("utf-8", "ignore")), "<i4")
    assert vocabulary.decode(ids.tolist()) == t.encode("utf-8", "ignore")


def test_pieces_of_odd_rows(odd, wide, none):
    found = same_on_all(lambda d: pieces.encode(d, MODEL), odd, wide, none)
    assert all(r["round_trip"] for r in found) and len(found) == len(ROWS)
    by = by_id(found)
    assert by[3]["ids"] == by[4]["ids"] == [] and by[11]["n_byte_ids"] > 3 and by[11]["decoded_sha256"] == sha(next(t for i, t, *_ in ROWS if i == 11).encode())
    assert all(r["n_ids"] == len(r["ids"]) and r["ids_sha256"] == sha(np.array(r["ids"], "<i4").tobytes()) for r in found)


# 3


@settings(deadline=None)
@given(st.binary(max_size=1500), st.binary(max_size=1500))
def test_fingerprints_compose(a, b):
    fa, fb, both = (tuple(int(x) for x in r) for r in exact.fingerprints([a, b, a + b]))
    assert exact.combine((fa, len(a)), (fb, len(b))) == (both, len(a) + len(b))
    value = 0
    for x in a:
        value = (value * exact.BASES[0] + x + 1) % exact.PRIMES[0]
    assert value == fa[0]


def plain_exact(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    least = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    return sorted(repr((i, least[t], len(groups[t]), sha(t.encode()))) for i, t in norm)


@pytest.mark.parametrize("bits", [31, 1])
def test_exact_groups(documents, bits):
    """One bit a residue makes almost all fingerprints collide; the comparison then parts the texts."""
    found = exact.exact_groups(documents, bits).collect()
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == plain_exact(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_exact_groups_of_rows_without_ids(spark):
    """Rows of no id, or of one, meet their own texts only, also when fingerprints collide."""
    rows = [(None, f"text {i % 5}") for i in range(20)] + [(7, f"text {i % 3}") for i in range(6)]
    for bits in (31, 1):
        found = exact.exact_groups(spark.createDataFrame(rows, "doc_id long, text string"), bits).collect()
        assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == plain_exact(rows)
        assert sum(r.kept for r in found) == 5


def test_exact_groups_of_odd_rows(odd, wide, none):
    found = same_on_all(exact.exact_groups, odd, wide, none)
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in found) == plain_exact([(r[0], r[1]) for r in ROWS])
    assert sum(r.kept for r in found) == len({r.text_sha256 for r in found})


def test_deduplicated_keeps_one_whole_row_of_each_text(odd):
    left = exact.deduplicated(odd)
    assert left.columns == odd.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in left.collect()]
    assert len(norm) == len(set(norm)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, *_ in ROWS})


# 4


@settings(deadline=None, max_examples=40)
@given(st.lists(st.integers(0, 90), min_size=1, max_size=4), st.integers(0, 10**6))
def test_viterbi(lengths, seed):
    rng = np.random.default_rng(seed)
    at = np.append(0, np.cumsum(lengths))
    scores = rng.normal(size=(int(at[-1]), 3)) * 3
    labels = language.viterbi(scores, at, 4.0)

    def value(path, s):
        return sum(s[i, p] for i, p in enumerate(path)) - 4.0 * sum(a != b for a, b in zip(path[:-1], path[1:], strict=True))

    for a, b in zip(at[:-1], at[1:], strict=True):
        s = scores[a:b]
        best = s[0].copy() if b > a else None
        for row in s[1:]:
            best = row + np.maximum(best, best.max() - 4.0)
        if b > a:
            assert value(labels[a:b].tolist(), s) == pytest.approx(best.max())


@pytest.mark.parametrize("n_states", [17, 150, 200])
def test_viterbi_of_many_languages(n_states):
    rng = np.random.default_rng(n_states)
    at = np.array([0, 40, 40, 41, 130])
    scores = rng.normal(size=(130, n_states)) * 3
    labels = language.viterbi(scores, at, 4.0)
    assert labels.min() >= 0 and labels.max() > 10
    language_wide, language.WIDE = language.WIDE, 1 << 20
    try:
        assert (labels == language.viterbi(scores, at, 4.0)).all()
    finally:
        language.WIDE = language_wide


def plain_language(model, t):
    """(lang_pred, score) of a text, word by word with Python numbers."""
    names = list(dict.fromkeys(x for x, _, _ in language.SCRIPTS))
    ws, rows, masks = words(t), [], []
    for w in ws:
        raw = f" {w} ".encode()
        grams = [((raw[k - 1] << 16 | raw[k] << 8 | raw[k + 1]) * 0x9E3779B1 % 2**32) >> (32 - language.BITS) for k in range(1, len(raw) - 1)]
        whole = int(text.mix(text.words_hashed([w.encode()])[0])[0]) >> (64 - language.BITS)
        mask = sum({1 << names.index(x) for c in w for x, a, b in language.SCRIPTS if a <= ord(c) <= b})
        row = [0.5 * sum(float(model.grams[g, k]) for g in grams) + float(model.words[whole, k]) for k in range(len(model.langs))]
        fits = [bool(mask & int(x)) for x in model.scripts]
        rows.append([0.0 if not mask else r - (0 if f or not any(fits) else language.FOREIGN) for r, f in zip(row, fits, strict=True)])
        masks.append(mask)
    if not any(masks):
        return "und", 0.0
    every = range(len(model.langs))
    chosen = [k for k in every if any(m & int(model.scripts[k]) for m in masks)] or list(every)
    paths = {k: (rows[0][k], [k]) for k in chosen}
    for row in rows[1:]:
        best = max(chosen, key=lambda k: paths[k][0])
        change = paths[best][0] - language.SWITCH
        paths = {k: (max(paths[k][0], change) + row[k], (paths[best][1] if change > paths[k][0] else paths[k][1]) + [k]) for k in chosen}
    votes = Counter(k for k, m in zip(max(paths.values(), key=lambda p: p[0])[1], masks, strict=True) if m)
    winner = min(votes, key=lambda k: (-votes[k], k))
    return model.langs[winner], votes[winner] / sum(votes.values())


def test_language_is_a_plain_search(spark, documents):
    model = language.fit(documents)
    rows = [(r.doc_id, " ".join((r.text or "").split()[:80])) for r in documents.orderBy("doc_id").limit(150).collect()]
    rows += [(10**6 + i, t.replace(" ", "\n\t")) for i, t in rows[:50]]  # any white space parts words alike
    rows += [(2 * 10**6 + i, f"{rows[i][1]} {rows[i + 1][1]}") for i in range(50)]
    found = by_id(language.label(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), model).collect())
    for i, t in rows:
        pred, score = plain_language(model, t)
        assert (found[i].lang_pred, found[i].score) == (pred, pytest.approx(score)), (i, t)


def test_distinct_words_do_not_depend_on_white_space():
    apart, joined = (language.distinct_words([sep.join((b"one", b"two", b"one"))]) for sep in (b" ", b"\n\t"))
    assert all((a == b).all() for a, b in zip([*apart[:2], *apart[2], apart[3]], [*joined[:2], *joined[2], joined[3]], strict=True))


def test_language_narrows_by_script():
    """Each language's words only in its own scripts, whatever the scores say; a text without a script has all candidates."""
    counts = np.zeros((3, 2 * (1 << language.BITS) + 16))
    counts[0, -16], counts[1, -16], counts[2, -14] = 5, 5, 5
    model = language.Model(["a", "b", "c"], counts)
    number, at = np.array([0, 1, 0, 2, 2]), np.array([0, 2, 3, 5])
    script = np.array([1, 4, 0], np.uint16)
    scores = np.array([[-1.0, -2.0, 0.0], [-50.0, -50.0, 0.0], [0.0, -1.0, -2.0]])
    assert language.narrowed(model, number, at, scores, script).tolist() == [2, 2, 0, 0, 0]


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.label(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.98 and all(0 <= r.score <= 1 for r in found)


def test_language_spans_follow_a_switch(spark, documents):
    model = language.fit(documents)
    parts = {r.lang: r.text for r in documents.where("n_chars > 600 and lang is not null").orderBy("doc_id").collect()}
    one, two = WORD.findall(parts["de"])[:60], WORD.findall(parts["es"])[:60]
    row = language.label(spark.createDataFrame([(1, " ".join(one + two))], "doc_id long, text string"), model).first()
    assert [s.lang for s in row.spans] == ["de", "es"] and abs(row.spans[1].first_word - 60) <= 3


def test_language_of_odd_rows(odd, wide, none, documents):
    model = language.fit(documents)
    by = by_id(same_on_all(lambda d: language.label(d, model), odd, wide, none))
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (3, 4, 5, 8)) and by[14]["lang_pred"] == "de"
    nothing = language.label(odd, language.fit(none)).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


# 5


def plain_components(rows, k, percent):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(repr((i, len(sets[x]), least.get(find(x)))) for x, (i, _) in enumerate(rows))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_shingle_components(documents, k, percent):
    found = shingles.jaccard_components(documents, k, percent).collect()
    assert sorted(repr(tuple(r)) for r in found) == plain_components([(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()], k, percent)


def plain_components_of(texts, percent, words_of=3):
    return plain_components(list(enumerate(texts)), words_of, percent)


@pytest.mark.parametrize("often", [64, 2])
def test_shingle_components_of_a_large_group_of_near_copies(spark, monkeypatch, often):
    """Copies with a few changed words each, some of which only others than the first connect; with frequent tokens by combinations."""
    monkeypatch.setattr(shingles, "FREQUENT", often)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(int(rng.integers(0, 6))):
            w[int(rng.integers(0, 120))] = f"x{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    chain = [f"c{i}" for i in range(100)]
    for i in range(12):
        chain = chain[3:] + [f"d{i}a", f"d{i}b", f"d{i}c"]
        rows.append((100 + i, " ".join(chain)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(repr(tuple(r)) for r in shingles.jaccard_components(df, 3, 90).collect()) == plain_components(rows, 3, 90)


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_shingle_components_of_long_and_hot_sets(spark, k, percent):
    """Long texts in families, of which some members are just not linked; a passage that many others share; short texts."""
    rng = np.random.default_rng(5)
    rows = []
    for size, members, most in ((1500, 24, 60), (700, 12, 40), (30, 30, 3), (8, 20, 2)):
        base = [f"{size}w{i}" for i in range(size)]
        for _ in range(members):
            w = list(base)
            for _ in range(int(rng.integers(0, most))):
                w[int(rng.integers(0, size))] = f"{size}x{rng.integers(0, 9)}"
            rows.append((len(rows), " ".join(w[: size - int(rng.integers(0, 1 + size // 50))])))
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(40):
        rows.append((len(rows), " ".join(f"o{rng.integers(0, 9000)}" for _ in range(int(rng.integers(0, 30)))) + " " + passage + f" e{i}"))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert sorted(repr(tuple(r)) for r in shingles.jaccard_components(df, k, percent).collect()) == plain_components(rows, k, percent)


@settings(deadline=None, max_examples=80)
@given(st.integers(2, 260), st.sampled_from([80, 90]), st.integers(0, 10**6))
def test_linked_sets_share_a_combination(size, percent, seed):
    """Pairs that differ as much as a link allows, of all sizes."""
    rng = np.random.default_rng(seed)
    like = shingles.Likeness(3, percent)
    pool = text.mix(rng.integers(1, 1 << 60, 2 * size + 2).astype(np.uint64))
    n = size
    both = like.overlap(n)
    one, two = np.unique(pool[:n]), np.unique(pool[n - both : n - both + max(both, int(rng.integers(both, n + 1)))])
    common = len(np.intersect1d(one, two))
    if 100 * common >= percent * (len(one) + len(two) - common):
        a, b = shingles.combinations(like, [one, two])
        assert len(np.intersect1d(a, b))


def test_shingle_components_of_odd_rows(odd, wide, none):
    found = same_on_all(lambda d: shingles.jaccard_components(d, 3, 90), odd, wide, none)
    assert sorted(repr(tuple(r)) for r in found) == plain_components([(r[0], r[1]) for r in ROWS], 3, 90)


def test_one_row_of_each_component_stays(spark):
    """Repeated rows and ids: a row stays for each component, and rows without words stay."""
    t, u = " ".join(f"t{i}" for i in range(50)), " ".join(f"u{i}" for i in range(50))
    rows = [(0, t), (1, t), (1, u), (1, u), (2, u + " more"), (None, t), (3, None), (3, None), (4, " ")]
    left = sorted(repr(tuple(r)) for r in shingles.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert left == sorted(repr(r) for r in [(0, t), (1, u), (3, None), (3, None), (4, " ")])


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 3), (20, 21), (21, 22), (22, 20), (5, 5), (30, 31)] + [(100 + i, 101 + i) for i in range(40)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[x] == 1 for x in (1, 2, 3, 9)) and all(found[x] == 20 for x in (20, 21, 22)) and all(found[100 + i] == 100 for i in range(41))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 6


def plain_edits(rows):
    order = sorted(rows, reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][1] or ""
        t = t or ""
        cut = len(t) // 2
        out[i] = (len(t), sha((t[: len(t) - cut] + n[:cut]).encode()))
    return out


def test_fingerprint_edits(documents):
    found = spots.fingerprint_edits(documents).collect()
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in found} == plain_edits(rows)
    text_of, print_of = dict(rows), {}
    for r in found:
        assert print_of.setdefault(text_of[r.doc_id], r.fingerprint) == r.fingerprint
    assert np.mean([r.near_edited for r in found]) > 5 * np.mean([r.near_next for r in found])


def test_near_edited_and_near_next_are_of_whole_sets(spark):
    """Long texts, of more signatures than a fingerprint keeps, in several buckets."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"the w{x} v{y}" for x, y in rng.integers(0, 40, (n, 2))) for n in (900, 800, 3, 1200, 700, 950, 600, 0)]
    found = by_id(spots.fingerprint_edits(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect())
    plain = lambda a, b: (lambda x, y: len(x & y) / len(x | y) if x | y else 1.0)(*(set(spots.signatures([t.encode()])[0].tolist()) for t in (a, b)))
    for i, t in enumerate(texts):
        other, cut = texts[i - 1], len(t) // 2
        assert found[i].near_edited == pytest.approx(plain(t, t[: len(t) - cut] + other[:cut]), rel=1e-12)
        assert found[i].near_next == pytest.approx(plain(t, other), rel=1e-12)


def test_likeness_is_exact_for_small_sets_and_near_for_large_ones():
    a, b = b"the cat sat of dogs run", b"the cat sat of birds fly"
    x, y = (set(spots.signatures([t])[0].tolist()) for t in (a, b))
    assert spots.likeness(*spots.sketches([a, b])) == pytest.approx(len(x & y) / len(x | y)) and len(x & y) == 1
    big = [" ".join(f"the {c}{i} z{i}" for i in range(n, n + 3000)).encode() for c, n in (("k", 0), ("k", 1000))]
    assert spots.likeness(*spots.sketches(big)) == pytest.approx(0.5, abs=0.15)
    assert spots.likeness(*spots.sketches([b"", b""])) == 1 and spots.likeness(*spots.sketches([b"", b"x"])) == 0


def test_fingerprint_edits_of_odd_rows(odd, wide, none):
    found = same_on_all(spots.fingerprint_edits, odd, wide, none)
    assert len(found) == len(ROWS) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    by = by_id(found)
    assert by[6].fingerprint == by[7].fingerprint and by[3].fingerprint == by[4].fingerprint and by[3].n_chars == 0
    one = odd.where("doc_id = 6")
    assert spots.fingerprint_edits(one).first().edited_sha256 == sha(b"x")


def test_near_copies(documents):
    rows = [(r.doc_id, (r.text or "").encode()) for r in documents.select("doc_id", "text").collect()]
    found, ends = spots.signatures([t for _, t in rows])
    sets = [set(found[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:], strict=True)]
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in enumerate(sets):
        for b in range(a):
            y = sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                one, two = sorted((find(rows[a][0]), find(rows[b][0])))
                root[two] = one
    assert {r.doc_id: (r.n_signatures, r.class_id) for r in spots.near_copies(documents).collect()} == {i: (len(x), find(i)) for (i, _), x in zip(rows, sets, strict=True)}
    assert len({find(i) for i, _ in rows}) < len(rows)


# 7


def test_toxicity_of_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.fit(docs, labels, 4000)).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r.predicted for r in found if r.toxic == k] for k in (1, 0))
    assert np.mean(toxic) > 0.75 and np.mean(clean) < 0.02
    assert all(r.predicted == int(r.score >= 0.3) for r in found)


def plain_features(t):
    """Words of lower case with ASCII punctuation as white space, pairs of neighbours, and pairs with one word between."""
    ws = words("".join(" " if "!" <= c <= "~" and not c.isalnum() else c for c in t or ""))
    return {(w,) for w in ws} | {("next", *p) for p in zip(ws, ws[1:], strict=False)} | {("skip", *p) for p in zip(ws, ws[2:], strict=False)}


def plain_ftrl(rows):
    """Weights by feature of (features, label) in order, by the published update, over dicts instead of buckets."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return -(z[f] - math.copysign(toxicity.L1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for found, label in rows:
            w = {f: weight(f) for f in [*found, "constant"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for f in w:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    return {f: weight(f) for f in [*z]}


def test_toxicity_is_plain_ftrl(spark):
    rng = np.random.default_rng(3)
    vocabulary = ["Good", "day", "you", "vile,", "fool!", "the", "dog", "über"]
    texts = {i: " ".join(rng.choice(vocabulary, rng.integers(0, 12))) for i in range(400)} | {400: None}
    toxic = {i: int("fool" in (t or "") and "vile" in t) for i, t in texts.items()}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, x) for i, x in toxic.items()] + [(0, None), (1, 0)], "doc_id long, toxic int")
    seeded = {r.doc_id: r.s for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit(7)).alias("s")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}
    weights = plain_ftrl([(plain_features(texts[i]), toxic[i]) for i in sorted(texts, key=seeded.get) if not held[i]])
    assert weights[("fool",)] > 0 and weights["constant"] < 0 and sum(w != 0 for w in weights.values()) > 10
    found = by_id(toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    assert len(found) == len(texts)
    for i, t in texts.items():
        want = 1 / (1 + math.exp(-sum(weights.get(f, 0.0) for f in [*plain_features(t), "constant"])))
        assert found[i].score == pytest.approx(want, abs=1e-7) and found[i].held_out == held[i] and found[i].predicted == (found[i].score >= 0.3)


def test_ftrl_leaves_rare_features_out():
    model = toxicity.Ftrl(10)
    for i in range(200):
        model.learn(np.array([0, 2] if i % 4 else [0, 1]), 0.0 if i % 4 else 1.0)
    model.learn(np.array([5]), 1.0)
    w = model.weights(np.arange(10))
    assert w[1] > 0 > w[2] and w[5] == 0 and w[9] == 0


def test_toxicity_of_odd_rows(spark, odd, wide, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 16)] + [(None, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    found = same_on_all(lambda d: toxicity.score(d, model), odd, wide, none)
    by = by_id(found)
    assert len(found) == len(ROWS) and by[3].score == by[4].score == by[5].score
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    blank = toxicity.fit(odd, labels.where("toxic > 1"))
    assert {r.score for r in toxicity.score(odd, blank).collect()} == {0.5}
    left = toxicity.clean(wide, model)
    assert left.columns == wide.columns and left.count() == sum(r.predicted == 0 for r in found)


# 8


def plain_targets(sizes):
    """Rounds of sharing by weight, each capping what is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            target |= share
            break
        for s in above:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in above)
        free -= above
    return target


@pytest.mark.parametrize("shard_words", [1 << 20, 3000])
def test_mix(documents, shard_words):
    found = mixing.mix(documents, shard_words=shard_words).collect()
    texts = {r.doc_id: (r.text, r.source) for r in documents.collect()}
    sizes = Counter()
    for t, s in texts.values():
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), Counter()
    for r in found:
        t, s = texts[r.doc_id]
        assert r["size"] == len(WORD.findall(t or "")) and r.source_size == sizes[s] and r.target == pytest.approx(want[s]) and 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    parts = 1 if shard_words > 10**6 else 10
    assert all(abs(taken[s] - want[s]) <= parts * mixing.BLOCK_WORDS for s in sizes)
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(documents.repartition(5), shard_words=shard_words).collect()))


def plain_sainte_lague(votes, seats):
    won = Counter()
    for _ in range(seats):
        won[max(votes, key=lambda k: (votes[k] / (2 * won[k] + 1), -k))] += 1
    return won


@pytest.mark.parametrize("seed", range(4))
def test_sainte_lague(spark, seed):
    rng = np.random.default_rng(seed)
    votes = {k: float(v) for k, v in enumerate(rng.pareto(1, 30) * 100)}
    seats = int(rng.integers(1, 400))
    df = spark.createDataFrame([(0, k, v, seats) for k, v in votes.items()], "g int, k int, v double, s long")
    found = {r.k: r.quota for r in mixing.sainte_lague(df, ["g"], "k", "v", "s").collect()}
    want = plain_sainte_lague(votes, seats)
    assert found == {k: want[k] for k in votes}


def test_mix_of_odd_rows(odd, wide, none):
    found = same_on_all(lambda d: mixing.mix(d), odd, wide, none)
    assert len(found) == len(ROWS) and all(0 <= r.taken <= 2 * r["size"] for r in found) and by_id(found)[3].taken == 0


@pytest.mark.parametrize("stage", [exact.deduplicated, shingles.one_of_each, mixing.mixed])
def test_stages_keep_columns_and_take_odd_rows(stage, odd, wide, none):
    assert stage(wide).columns == wide.columns and stage(wide).count() == stage(odd).count() > 0 and stage(none).count() == 0


def test_mixed_rows_hold_the_words_taken(documents, wide):
    taken = {r.doc_id: r.taken for r in mixing.mix(documents).collect()}
    rows, have = mixing.mixed(documents), Counter()
    assert rows.columns == documents.columns and mixing.mixed(wide).columns == wide.columns
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in rows.collect():
        have[r.doc_id] += len(WORD.findall(r.text))
        assert texts[r.doc_id].startswith(r.text) and r.n_chars == len(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(have)


def test_mixed_takes_equal_rows_each_for_itself(spark):
    rows = [(5, "a b c d e f g h " * 24, "x", 0)] * 3 + [(6, "k " * 300, "y", 0), (7, None, "y", 0), (8, " ", "z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long")
    want, have = Counter(), Counter()
    for r in mixing.mix(df).collect():
        want[r.doc_id] += r.taken
    for r in mixing.mixed(df).collect():
        have[r.doc_id] += len(WORD.findall(r.text))
    assert have == Counter({k: v for k, v in want.items() if v}) and have[5] > 0


# 9


def test_chat_of_long_dialogues(spark):
    """More turns than a part has: parts are one text, with offsets in it; ties and long texts; columns of other names."""
    rng = np.random.default_rng(0)
    names = ["system", "ann", "bob", "a|b\\\\"]
    rows = [(1, int(t), names[int(rng.integers(0, 4))], f"t{t} <|x " * int(rng.integers(0, 3))) for t in range(700)] + [(1, 5, "ann", "z" * 100_000), (1, 5, "ann", "z" * 100_000), (2, 3, "system", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").repartition(3)
    views = chat.rotate(df.withColumn("begin", F.lit(9)).withColumn("own", F.lit(9)))
    assert views.count() == 3 * 3
    for r in chat.whole(views).collect():
        esc = lambda x: x.replace("\\", "\\\\").replace("<|", "<\\|")
        want, spans = "", []
        for _, _, role, t in sorted(x for x in rows if x[0] == 1):
            want += "<|assistant|>\n" if role == r.speaker else "<|system|>\n" if role == "system" else f"<|user:{esc(role)}|>\n"
            said = esc(t) + "<|end|>\n"
            if role == r.speaker:
                spans.append(f"{len(want)}-{len(want) + len(said)}")
            want += said
        assert r.rendered == want and r["mask"] == ",".join(spans)


def test_chat_views(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", None), (1, 3, "ann", "bye"), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 300, "ann", "y"), (None, 1, "ann", "z"), (1, 3, "ann", "bye")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    found = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(df.withColumn("speaker", F.lit("s")).withColumn("part", F.lit(1))).collect()}
    assert set(found) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", -1), (None, "ann", 0), (None, "ann", 1)}
    ann = found[(1, "ann", 0)]
    assert ann.rendered == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi <\\|end|><|end|>\n<|user:bob|>\n<|end|>\n<|assistant|>\nbye<|end|>\n<|assistant|>\nbye<|end|>\n"
    spans = [tuple(map(int, s.split("-"))) for s in ann["mask"].split(",")]
    assert [ann.rendered[a:b] for a, b in spans] == ["hi <\\|end|><|end|>\n", "bye<|end|>\n", "bye<|end|>\n"]
    assert ann.n_chars == len(ann.rendered) and (ann.n_turns, ann.n_own) == (5, 3)
    bob = found[(1, "bob", 0)]
    assert bob.n_own == 1 and "<|user:ann|>\nhi" in bob.rendered
    assert chat.rotate(df.limit(0)).count() == 0


# 10


def test_bloom_lm(documents):
    found = by_id(bloomlm.score(documents).collect())
    texts = {r.doc_id: [*words(r.text), "\0"] for r in documents.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in texts.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in c for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_bloom_filter_gives_quantised_counts():
    rng = np.random.default_rng(0)
    h = text.mix(np.arange(20_000, dtype=np.uint64))
    c = np.maximum(1, (rng.pareto(1, len(h)) * 2).astype(np.int64))
    model = bloomlm.Filter(1, {0: bloomlm._sub_filter(h, c).tobytes()}, (0, 0, 0, 0.0), h[:0], c[:0])
    got = model.counts(h)
    assert (got >= c / bloomlm.GRADE**1.01).all() and np.mean(np.abs(got - c) <= 0.3 * c) > 0.97
    assert np.mean(model.counts(text.mix(np.arange(10**6, 10**6 + 20_000, dtype=np.uint64))) > 0) < 0.02


def test_bloom_lm_of_odd_rows(odd, wide, none):
    found = same_on_all(bloomlm.score, odd, wide, none)
    by = by_id(found)
    assert len(found) == len(ROWS) and by[3].n_tokens == by[4].n_tokens == 1 and all(math.isfinite(r.score) and r.score <= 0 for r in found)


def test_bloom_lm_keeps_every_pair(spark):
    """Also pairs that occur once count, and what they lose is what the words get. Few of the filter's answers are wrong."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 50, rng.integers(1, 8)))) for i in range(400)]
    texts = {i: [*words(t), "\0"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    ones = Counter(w for i, t in texts.items() if not held[i] for w in t)
    twos = Counter(p for i, t in texts.items() if not held[i] for p in zip([None, *t], t, strict=False))
    n, v, starts = sum(ones.values()), len(ones), sum(not h for h in held.values())
    assert min(twos.values()) == 1
    contexts = np.array([starts, *(c for w, c in ones.items() if w != "\0")])
    assert contexts.sum() == n and (contexts * bloomlm.backed_off(contexts, n, v, len(twos))).sum() == pytest.approx(bloomlm.DISCOUNT * len(twos))
    near = lambda c: bloomlm.COUNT_OF[bloomlm.graded(np.array([c]))[0]] if c else 0.0

    def plain(t):
        total = 0.0
        for a, b in zip([None, *t], t, strict=False):
            context, base = near(ones[a]) if a else starts, (near(ones[b]) + v / (v + 1)) / (n + v)
            rest = float(bloomlm.backed_off(np.array([context]), n, v, len(twos))[0])
            total += math.log10(min(1.0, max(near(twos[a, b]) - bloomlm.DISCOUNT, 0) / max(context, 1) + rest * base if context else base))
        return total

    found = by_id(bloomlm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    close = [math.isclose(found[i].score, plain(t), rel_tol=1e-9) for i, t in texts.items()]
    assert np.mean(close) > 0.7


def test_queries_are_complete():
    from kindred.llm.queries import QUERIES

    assert [q.split("_")[0] for q in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert SF.startswith("/root/testdata")
