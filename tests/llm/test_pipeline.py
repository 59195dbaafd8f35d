"""Each stage of corpus_pipeline on its predecessor's rows, against a plain version."""

from __future__ import annotations

import re
from collections import Counter

import pytest

import corpus_pipeline
from kindred.llm import mixing, toxicity

from .test_operators import SF, WORD, plain_components, plain_targets


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, SF).write.parquet(str(at / name))
        after = spark.read.parquet(str(at / name))
        out.append((name, docs, after))
        docs = after
    return {name: (a, b) for name, a, b in out}


def test_order_and_columns(stages):
    assert list(stages) == ["toxicity", "exact_dedup", "shingle_join", "mixing", "pieces"]
    assert all(a.columns == b.columns for n, (a, b) in stages.items() if n != "pieces")


def test_toxicity_drops_what_is_predicted(spark, stages):
    docs, left = stages["toxicity"]
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in toxicity.score(docs, model).collect() if not r.predicted}
    assert {r.doc_id for r in left.collect()} == want


def test_exact_copies_go(stages):
    docs, left = stages["exact_dedup"]
    least: dict[str, int] = {}
    for r in docs.collect():
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")
        least[t] = min(r.doc_id, least.get(t, r.doc_id))
    assert sorted(r.doc_id for r in left.collect()) == sorted(least.values())


def test_one_of_each_group_of_near_copies_stays(stages):
    docs, left = stages["shingle_join"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(i for i, _, c in (eval(x) for x in plain_components(rows, 5, 80)) if i == c)  # noqa: S307
    assert sorted(r.doc_id for r in left.collect()) == want


def test_mixing_gives_each_source_its_target(stages):
    docs, left = stages["mixing"]
    sizes, have = Counter(), Counter()
    for df, c in ((docs, sizes), (left, have)):
        for r in df.collect():
            c[r.source] += len(WORD.findall(r.text or ""))
    want = plain_targets(sizes)
    assert all(abs(have[s] - want[s]) <= mixing.BLOCK_WORDS for s in sizes)


def test_run_encodes_all_rows(spark, stages):
    docs, left = stages["pieces"]
    assert left.count() == docs.count() and left.where("not round_trip").isEmpty()
    found = corpus_pipeline.run(spark, SF)
    assert sorted(r.ids_sha256 for r in found.collect()) == sorted(r.ids_sha256 for r in left.collect())
