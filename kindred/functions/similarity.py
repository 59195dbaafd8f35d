"""Likeness of sets, strings and vectors. What empty sides give is part of each measure."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def _by_size(a: Column, b: Column, value: Column) -> Column:
    n, m = F.size(a), F.size(b)
    return F.when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(value)


def jaccard(a: Column, b: Column) -> Column:
    c = common(a, b)
    return _by_size(a, b, c / (F.size(a) + F.size(b) - c))


def dice(a: Column, b: Column) -> Column:
    return _by_size(a, b, common(a, b) * 2 / (F.size(a) + F.size(b)))


def overlap(a: Column, b: Column) -> Column:
    return _by_size(a, b, common(a, b) / F.least(F.size(a), F.size(b)))


def containment(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == 0, (F.size(b) == 0).cast("double")).otherwise(common(a, b) / F.size(a))


def levenshtein_ratio(a: Column, b: Column) -> Column:
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def jaro_winkler_of(a: str, b: str, weight: float = 0.1) -> float:
    """Half transpositions count as halves, and the prefix bonus has no threshold."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    if not first:
        return 0.0
    second = [ch for ch, u in zip(b, used, strict=True) if u]
    m, t = len(first), sum(x != y for x, y in zip(first, second, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    same = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * weight * (1 - jaro)


def _jaro_winkler_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    memory: dict[tuple[str, str], float] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in memory:
            memory[pair] = jaro_winkler_of(*pair)
        out.append(memory[pair])
    return pd.Series(out, dtype="float64")


def jaro_winkler(a: Column, b: Column) -> Column:
    """Spark has no such function; each distinct pair of an Arrow batch is computed once."""
    return F.pandas_udf(_jaro_winkler_batch, "double")(a, b)


def cosine(a: Column, b: Column) -> Column:
    """The dot product of unit vectors; 0 where one is missing."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.coalesce(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), F.lit(0.0))


def vectors_or_zero(v: Column, n: int) -> Column:
    return F.coalesce(v, F.array_repeat(F.lit(0.0).cast("float"), n))
