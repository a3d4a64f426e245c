"""Likeness of short strings by matching blocks: twice the letters in common blocks over the letters of both.

The longest common block (the first in one string, then in the other) parts both strings; what is left of it and right
of it is compared alike. Candidates are met by length and by shared letter pairs, so only near strings are compared.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@lru_cache(1 << 16)
def matched(a: str, b: str) -> int:
    """Letters in matching blocks; the strings are short, so blocks are found by growing runs of equal letters."""
    todo, total = [(0, len(a), 0, len(b))], 0
    while todo:
        i0, i1, j0, j1 = todo.pop()
        size, at, to, runs = 0, i0, j0, {}
        for i in range(i0, i1):
            now = {j: runs.get(j - 1, 0) + 1 for j in range(j0, j1) if a[i] == b[j]}
            for j, n in now.items():
                if n > size:
                    size, at, to = n, i - n + 1, j - n + 1
            runs = now
        if size:
            total += size
            todo += [(i0, at, j0, to), (at + size, i1, to + size, j1)]
    return total


def ratio(a: str, b: str) -> float:
    return 2.0 * matched(a, b) / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(DoubleType())
def block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b, strict=True)], dtype=float)


def pairs_of(c):
    """The distinct pairs of neighbouring letters, with both ends marked."""
    marked = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(marked, i, F.lit(2))))


def nearest(values: DataFrame, known: DataFrame, least: float = 0.82) -> DataFrame:
    """value, nearest, likeness of the distinct values (value) that are not known: the known name (name) most like each,
    from `least` (over 2/3) on; of equals the last by code points.

    Two strings of such a likeness share a pair of neighbours, ends included: without one, every two matched letters
    have an unmatched one between them in either string, and so have both ends, so that at most a third of all letters
    could be matched. Their lengths differ by a factor of 2 / least - 1 at most.
    """
    apart = 2.0 / least - 1.0
    v = values.select("value").filter("value IS NOT NULL").distinct().join(known.select(F.col("name").alias("value")), "value", "left_anti")
    n, m = F.length("value"), F.length("name")
    met = v.withColumn("pair", F.explode(pairs_of(F.col("value")))).join(known.select("name").withColumn("pair", F.explode(pairs_of(F.col("name")))), "pair")
    met = met.filter((m <= n * apart) & (n <= m * apart)).select("value", "name").distinct()
    scored = met.withColumn("likeness", block_ratio("name", "value")).filter(F.col("likeness") >= least)
    return scored.groupBy("value").agg(F.max_by("name", F.struct("likeness", "name")).alias("nearest"), F.max("likeness").alias("likeness"))
