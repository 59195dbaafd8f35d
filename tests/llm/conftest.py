from __future__ import annotations

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for columns of their own.
CLASHING = ("n", "node", "keep_id", "score", "shard", "order", "row", "seeded", "_id", "_key", "_sha", "_text", "size", "taken", "print", "key", "kind", "bucket", "held_out", "predicted", "packed", "place", "rep", "count", "turns")

LONG = " ".join(f"word{i % 977} filler{i % 13}" for i in range(20_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest of the north today", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest of the north today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs far away into the deep dark forest of the north today again", "en", "b"),
    (3, None, "en", "b"), (4, "", None, None), (5, " \t\n", None, None), (6, "x", "de", "c"), (7, "x", None, "c"), (8, "12 34 !!", "en", None), (None, "der die das und nicht", "de", None), (None, None, None, None),
    (9, LONG, "en", "a"), (10, LONG + " end", "en", "a"), (11, "漢字 ▁ émoji 🎉 Ünïcode <|x|> \\ \x0b done", "fr", "d"), (12, "a" * 400, None, "d"), (13, "a" * 400, None, "d"), (14, "die  Katze\nund der Hund", "de", "a"),
    (15, "die Katze und der Hund", "de", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in ROWS], DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def wide(odd):
    return odd.select("*", *[F.lit(7).alias(c) for c in CLASHING])


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows_of(df):
    return sorted((repr(tuple(r)) for r in df.select(*sorted(df.columns)).collect()))


def same_on_all(f, odd, wide, none):
    """The result of f on the odd rows, also the same with clashing columns; an empty one has no rows."""
    found = rows_of(f(odd))
    assert rows_of(f(wide)) == found
    assert f(none).count() == 0
    return f(odd).collect()
