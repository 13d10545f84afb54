"""String similarity: Indel ratio by a native longest common subsequence, difflib's ratio, bounded edit distance."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence; one fold over a's characters, each a fold over b's."""
    row = F.array_repeat(F.lit(0), F.length(b) + 1)

    def step(p: Column, i: Column) -> Column:
        cell = lambda c, j: F.array_append(c, F.when(F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1)), F.get(p, j - 1) + 1).otherwise(F.greatest(F.get(p, j), F.element_at(c, -1))))
        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    full = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(a)), row, step), -1)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(full)


def indel_ratio(a: Column, b: Column) -> Column:
    """100 times twice the common subsequence by both lengths; 100 for two empty texts."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 100.0).otherwise(200.0 * lcs(a, b) / total)


def may_reach(a: str, b: str, threshold: int) -> str:
    """SQL: whether the Indel ratio of two columns can reach threshold. The lengths bound it, and the Indel distance is
    no less than the edit distance, which is built in and stops early."""
    total = f"(length({a}) + length({b}))"
    allowed = f"cast(floor({total} * {100 - threshold} / 100.0) as int)"
    return f"(200 * least(length({a}), length({b})) >= {threshold} * {total} and levenshtein({a}, {b}, {allowed}) >= 0)"


def reaches(a: Column, b: Column, threshold: int) -> Column:
    return 200 * lcs(a, b) >= threshold * (F.length(a) + F.length(b))


def close_match(words: Column, terms: list[str], cutoff: float) -> Column:
    """difflib's closest term for each word, or null. Arrow batches; call it on distinct words only."""
    known = sorted(set(terms))

    @F.pandas_udf("string")
    def nearest(series: pd.Series) -> pd.Series:
        return series.map(lambda w: (difflib.get_close_matches(w, known, n=1, cutoff=cutoff) or [None])[0])

    return nearest(words)
