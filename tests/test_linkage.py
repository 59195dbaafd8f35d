"""Hand tables, properties, a generated data set from end to end, and a negative case for each check."""

from __future__ import annotations

import itertools
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kindred.functions import similarity as sim
from kindred.functions import text as tx
from kindred.operators import blocking, evaluate, features, matcher, rules, validate
from kindred.plans import pipeline
from kindred.sources import records as rec
from kindred.sources import sinks, synthetic
from kindred.streaming.incremental import linked_stream


def one(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").select("x").collect()]


def test_clean_text(spark):
    assert one(spark, tx.clean_text, ["Café–Nº5 & Co.", "  A\tB ", None, "ﬁne ½"]) == ["cafeno5 co", "a b", "", "fine 12"]


def test_fold_ascii_equals_the_decomposition_of_every_character(spark):
    chars = [chr(c) for c in itertools.chain(range(0x20, 0x3000), range(0xF900, 0x10000), range(0x1D400, 0x1D800)) if not 0xD800 <= c < 0xE000]
    found = one(spark, tx.fold_ascii, chars)
    want = ["".join(x for x in unicodedata.normalize("NFKD", c) if x < "\x80") for c in chars]
    assert [(c, f, w) for c, f, w in zip(chars, found, want, strict=True) if f != w] == []


def test_canonical_forms(spark):
    assert one(spark, tx.canonical_name, ["The Blue-Fin Trading Co., Ltd", "Tech Solutions", "Zed Zed A", None]) == ["blue fin trading", "", "zed", ""]
    assert one(spark, tx.canonical_address, ["12 New St., 5 Fl nr Oak Ave Oak", ""]) == ["12 5 avenue floor oak oak street", ""]


def test_ngrams(spark):
    found = one(spark, tx.ngrams, ["ab", ""])
    assert set(found[0]) == {" a", "ab", "b ", " ab", "ab "} and found[1] == []


def test_soundex(spark):
    names = {"pfister": "P123", "ashcraft": "A226", "tymczak": "T522", "bob": "B100", "lloyd": "L430", "acme": "A250"}
    assert one(spark, tx.soundex, list(names)) == list(names.values())


def test_norm_key_and_list_size(spark):
    assert one(spark, lambda c: tx.norm_key(c, " "), ["Café & Co.", None]) == ["caf co", ""]
    assert one(spark, lambda c: tx.norm_key(c, ""), [" A-b c"]) == ["abc"]
    assert one(spark, tx.list_size, [None, "", "a", "a,b"]) == [0, 0, 1, 2]


@pytest.mark.parametrize(("a", "b", "jaccard", "dice", "overlap", "contain"), [([], [], 1, 1, 1, 1), ([], ["x"], 0, 0, 0, 0), (["x"], [], 0, 0, 0, 0), (["a", "b"], ["b", "c"], 1 / 3, 0.5, 0.5, 0.5), (["a", "b"], ["b"], 0.5, 2 / 3, 1, 0.5)])
def test_set_likeness(spark, a, b, jaccard, dice, overlap, contain):
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    found = df.select(*[f(F.col("a"), F.col("b")) for f in (sim.jaccard, sim.dice, sim.overlap, sim.containment)]).first()
    assert found == pytest.approx((jaccard, dice, overlap, contain))


def test_string_likeness(spark):
    df = spark.createDataFrame([("kitten", "sitting"), ("", ""), ("", "x")], "a string, b string")
    assert [r[0] for r in df.select(sim.levenshtein_ratio(F.col("a"), F.col("b"))).collect()] == pytest.approx([1 - 3 / 7, 1, 0])
    want = {("martha", "marhta"): 0.961111, ("dixon", "dicksonx"): 0.813333, ("abcd", "axyz"): 0.55, ("ab", "ba"): 0, ("", ""): 1, ("a", "b"): 0}
    assert [sim.jaro_winkler_of(*p) for p in want] == pytest.approx(list(want.values()), abs=1e-6)
    df = spark.createDataFrame(list(want), "a string, b string")
    assert sorted(r[0] for r in df.select(sim.jaro_winkler(F.col("a"), F.col("b"))).collect()) == pytest.approx(sorted(want.values()), abs=1e-6)


@given(st.text("abcd", max_size=8), st.text("abcd", max_size=8))
def test_jaro_winkler_is_symmetric_in_range(a, b):
    assert 0 <= sim.jaro_winkler_of(a, b) <= 1.0000001
    assert (sim.jaro_winkler_of(a, b) == 1) == (a == b) or a[:4] == b[:4]


@pytest.mark.parametrize(("tp", "p", "a", "f", "f2"), [(3, 4, 7, 0.652174, 0.46875), (2, 9, 3, 0.25641, 0.47619), (5, 5, 7, 0.925926, 0.757576), (0, 0, 0, 1, 1), (0, 0, 2, 0, 0), (0, 2, 0, 0, 0)])
def test_fbeta(spark, tp, p, a, f, f2):
    df = spark.createDataFrame([(tp, p, a)], "tp int, p int, a int")
    c = (F.col("tp"), F.col("p"), F.col("a"))
    assert df.select(evaluate.fbeta(*c), evaluate.f2_sqlform(*c)).first() == pytest.approx((f, f2), abs=1e-5)


def made(spark, rows):
    """Records of (id, name, address, country)."""
    data = [(i, int(i[1]), int(i[1]) * 10**15 + k, n, a, c) for k, (i, n, a, c) in enumerate(rows)]
    return spark.createDataFrame(data, "entity_id string, source int, ord long, business_name string, business_address string, country string")


ROWS = [
    ("S1-1", "Blue Fin", "12 Oak St", "US"), ("S1-2", "Lone Star", "", ""), ("S1-3", "Inc", "77", "India"),
    ("S2-1", "BLUE fin, Inc", "12 Oak Street", "us"), ("S2-2", "Blue Fin", "99 Elm Rd", "France"), ("S3-1", "Bluebell", "12 Oak Street", "US"), ("S3-2", "", "77", "India"), ("S3-3", "Blue Fin", "", "US"),
]


def test_blocking_scores_keys_and_countries(spark):
    r = made(spark, ROWS)
    found = {(x.s1_id, x.target_id): x.score for x in blocking.scored(rec.entities_of(r), rec.targets_of(r)).collect()}
    assert found[("S1-1", "S2-1")] == 100 and found[("S1-1", "S2-2")] == 100 and found[("S1-1", "S3-1")] == 90 and found[("S1-3", "S3-2")] == 90
    assert not any(a == "S1-2" for a, _ in found)
    ranked = blocking.top(blocking.scored(rec.entities_of(r), rec.targets_of(r)), 2).where("s1_id = 'S1-1'").orderBy("rank").collect()
    assert [x.target_id for x in ranked] == ["S2-1", "S2-2"]
    capped = blocking.capped(blocking.keyed(rec.targets_of(r)), 1).where("key_type = 'name' and key = 'blue fin'").collect()
    assert [x.entity_id for x in capped] == ["S2-1"]
    assert tuple(blocking.candidates_per_entity(rec.entities_of(r), blocking.candidates(rec.entities_of(r), rec.targets_of(r))).first())[0] == 0


def test_recall_without_truth_is_one(spark):
    r = made(spark, ROWS)
    none = spark.createDataFrame([], "s1_id string, target_id string")
    assert blocking.blocking_recall(rec.entities_of(r), none, none).first()["recall_ceiling"] == 1.0


def test_rules_ask_for_the_country_and_unique_keys(spark):
    norm = rules.normalised(made(spark, ROWS))
    pairs = lambda rule: {(x.s1_id, x.target_id) for x in rules.matches(norm, rule).collect()}
    assert pairs("NAME_ONLY") == {("S1-1", "S3-3")}
    assert pairs("V1_ORIGINAL") == {("S1-1", "S3-3"), ("S1-3", "S3-2")}
    assert pairs("NAME_UNIQUE") == {("S1-1", "S3-3")}
    assert pairs("FULL_EXACT_UNIQUE") == set()
    more = rules.normalised(made(spark, [*ROWS, ("S3-4", "blue fin", "x", "US")]))
    assert {(x.s1_id, x.target_id) for x in rules.matches(more, "NAME_UNIQUE").collect()} == set()
    assert rules.run_summary(rec.entities_of(made(spark, ROWS)), rules.strongest(norm)).first() == (3, 2, 2)


def test_features_are_named_and_in_range(spark):
    r = made(spark, ROWS)
    pairs = features.paired(blocking.candidates(rec.entities_of(r), rec.targets_of(r)), r)
    rows = features.featured(pairs).collect()
    assert len(features.FEATURES) == 50 == len(set(features.FEATURES))
    for row in rows:
        assert all(0 <= row[n] <= 1 + 1e-9 for n in features.FEATURES if "common_tokens" not in n)
    best = next(x for x in rows if (x.s1_id, x.target_id) == ("S1-1", "S2-1"))
    assert best.canon_exact_name == best.canon_exact_addr == best.country_match == best.name_jw_canon == 1.0


def test_lists_and_files(spark, tmp_path):
    r = made(spark, ROWS)
    links = spark.createDataFrame([("S1-1", "S3-1"), ("S1-1", "S2-1"), ("S1-1", "S2-1")], "s1_id string, target_id string")
    lists = sinks.match_lists(rec.entities_of(r), links)
    assert {x[0]: x[1] for x in lists.collect()} == {"S1-1": "S2-1,S3-1", "S1-2": "", "S1-3": ""}
    assert {x[1] for x in sinks.match_lists(rec.entities_of(r), links, brackets=True).collect()} == {"[S2-1,S3-1]", "[]"}
    sinks.write_tsv(lists, str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\nS1-3\t\n"
    assert sinks.check_row_count(lists, rec.entities_of(r)) == 3
    with pytest.raises(ValueError, match="2 rows for 3"):
        sinks.check_row_count(lists.limit(2), rec.entities_of(r))
    profile = evaluate.output_profile(lists, "matched_entity_ids").first()
    assert tuple(profile) == (3, 2, pytest.approx(2 / 3), 2)


def test_reading_keeps_na_and_quotes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A ""x"" B"\t NA \t\n')
    assert tuple(rec.read_tsv(spark, str(tmp_path / "a.tsv"), rec.RECORD).first()) == ("S1-1", 'A "x" B', " NA ", "")
    with pytest.raises(FileNotFoundError):
        rec.read_tsv(spark, str(tmp_path / "none.tsv"), rec.RECORD).count()
    (tmp_path / "t.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1, S2-2,,S2-1\nS1-2\t\n")
    links, entities = rec.load_ground_truth(spark, str(tmp_path / "t.tsv"))
    assert {tuple(x) for x in links.collect()} == {("S1-1", "S2-1"), ("S1-1", "S2-2")} and entities.count() == 2


def test_threshold_curve_takes_the_lowest_of_equal_ones(spark):
    scored = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.2), ("b", "x", 0.4)], "s1_id string, target_id string, proba double")
    truth = spark.createDataFrame([("a", "x")], "s1_id string, target_id string")
    best, score = matcher.tune_threshold(scored, truth)
    assert score == 1.0 and best == pytest.approx(0.40)
    assert len(matcher.THRESHOLDS) == 91


def test_models(spark):
    rng = np.random.default_rng(0)
    rows = [(f"a{i}", f"b{i}", int(x > 0.5), *(float(x) for _ in features.FEATURES)) for i, x in enumerate(rng.random(120))]
    df = spark.createDataFrame(rows, "s1_id string, target_id string, label int, " + ", ".join(f"{n} double" for n in features.FEATURES))
    for backend in ("gbt", "logreg", "weights"):
        m = matcher.Matcher(backend=backend, rounds=5, steps=10).train(df)
        p = {r.s1_id: r.proba for r in m.predict_proba(df).collect()}
        assert all(0 <= x <= 1 for x in p.values()), backend
        high, low = ([p[r[0]] for r in rows if r[2] == k] for k in (1, 0))
        assert np.mean(high) > np.mean(low), backend
    with pytest.raises(RuntimeError):
        matcher.Matcher().predict(df)
    assert matcher.Matcher().train(df.where("label = 1")).model == "weights"


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory) -> Path:
    at = tmp_path_factory.mktemp("data")
    for split, sizes, seed in (("train", (40, 80, 60), 0), ("test", (30, 70, 50), 1)):
        (at / split).mkdir()
        rows = synthetic.records(spark, sizes, seed)
        for k in (1, 2, 3):
            lines = ["\t".join(rec.FIELDS), *("\t".join(r) for r in rows.where(F.col("source") == k).orderBy("ord").select(*rec.FIELDS).collect())]
            (at / split / f"{split}_source{k}.tsv").write_text("\n".join(lines) + "\n")
        if split == "train":
            lists = sinks.match_lists(rec.entities_of(rows), synthetic.truth(rows))
            (at / split / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"{r[0]}\t{r[1]}\n" for r in lists.orderBy("ord").collect()))
    return at


def test_pipeline_from_end_to_end(spark, dataset, tmp_path):
    out = pipeline.run_pipeline(spark, str(dataset), str(tmp_path), backend="logreg")
    assert out.n_test_s1 == 30 and out.recall_ceiling > 0.8 and out.val_fbeta > 0.6
    assert 0 < out.total_matches <= out.total_candidates <= 30 * 50
    found = validate.validate(spark, str(tmp_path / "matching_results.tsv"), str(tmp_path / "candidate_pairs.tsv"), str(dataset / "test"), check_ids=True)
    assert found.ok and not found.warnings, (found.errors, found.warnings)


def test_given_threshold_holds(spark, dataset):
    out = pipeline.run_pipeline(spark, str(dataset), train_only=True, settings=rec.Settings(threshold=0.7), backend="weights", tune=False)
    assert out.threshold == 0.7 and out.n_test_s1 is None


HEAD = "source1_entity_id\tmatched_entity_ids\n"


@pytest.mark.parametrize(
    ("body", "check"),
    [
        (None, "V01"), ("", "V01"), ("source1_entity_id,matched_entity_ids\n", "V02"), ("a\tb\n", "V03"), (HEAD + "S1-1\t\nS1-2\n", "V04"), (HEAD + "S1-1\t\nS1-1\t\nS1-2\t\n", "V05"), (HEAD + "S1-1\tS2-1,S2-1\nS1-2\t\n", "V06"),
        (HEAD + "S1-1\tS1-2\nS1-2\t\n", "V07"), (HEAD + "S1-1\tX9-1\nS1-2\t\n", "V08"), (HEAD + "S1-1\t[S2-1]\nS1-2\t\n", "V08"), (HEAD + "S1-1\t[]\nS1-2\t\n", "V08"), (HEAD + "S1-1\tS2-9\nS1-2\t\n", "V09"),
        (HEAD + "S1-1\t\n", "V10"), (HEAD + "S1-1\t\nS1-2\t\nS1-3\t\n", "V11"), (HEAD + "S1-1\tS2-1\nS1-2\t\n", "V12"), (HEAD + "S1-1\tS2-1, S3-1\nS1-2\t\n", "V08"),
    ],
)
def test_validator_finds(spark, tmp_path, body, check):
    head = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"
    for k, ids in ((1, ("S1-1", "S1-2")), (2, ("S2-1",)), (3, ("S3-1",))):
        (tmp_path / f"test_source{k}.tsv").write_text(head + "".join(f"{i}\ta\tb\tc\n" for i in ids))
    if body is not None:
        (tmp_path / "m.tsv").write_text(body)
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-1\nS1-2\t\n")
    found = validate.validate(spark, str(tmp_path / "m.tsv"), str(tmp_path / "c.tsv"), str(tmp_path), check_ids=True)
    assert check in {c for c, _ in found.errors + found.warnings}, (found.errors, found.warnings)
    assert (check == "V12") == found.ok


def test_validator_without_tests_or_candidates(spark, tmp_path):
    assert [c for c, _ in validate.validate(spark, "m", "c", str(tmp_path)).errors] == ["V16"]


def test_streamed_entities_are_linked(spark, tmp_path):
    r = made(spark, ROWS)
    rec.entities_of(r).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(r.schema).parquet(str(tmp_path / "in"))
    q = linked_stream(stream, rec.targets_of(r), "NAME_ONLY", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out"))
    assert {(x.s1_id, x.target_id) for x in found.collect()} == {("S1-1", "S3-3")}


def test_long_keys_stay_apart(spark, tmp_path):
    """Keys of eight digits and more, in records and in known links."""
    keys = [5, 10_000_000, 10_000_003, 10_000_006, 1_000_000_000]
    same = [(k, "bolt", "b", 1, "t") for k in keys] + [(10_000_002, "bolt", "b", 1, "t"), (10_000_005, "bolt", "b", 1, "t")]
    spark.createDataFrame(same, "p_partkey long, p_name string, p_brand string, p_size int, p_type string").write.parquet(f"{tmp_path}/part.parquet")
    found = [r[0] for r in rec.part_records(spark, str(tmp_path)).select("entity_id").collect()]
    links = [tuple(r) for r in rec.part_truth(spark, str(tmp_path)).collect()]
    ids = {k % 3 + 1: [] for k, *_ in same}
    for k, *_ in same:
        ids[k % 3 + 1].append(f"S{k % 3 + 1}-{k:07d}")
    assert sorted(found) == sorted(x for xs in ids.values() for x in xs)
    assert sorted(links) == sorted((a, b) for a in ids.get(1, []) for s in (2, 3) for b in ids.get(s, []))
