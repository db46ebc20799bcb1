"""Sequential matching: greedy one-to-one pairs, and greedy exclusion in time. Each group is one task's work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def greedy(rows: pd.DataFrame, ascending: bool = False) -> pd.DataFrame:
    """Best score first, ties by a, then b; a pair is skipped if either side is taken."""
    a_taken, b_taken, kept = set(), set(), []
    ordered = rows.sort_values(["score", "a", "b"], ascending=[ascending, True, True])
    for i, a, b in zip(ordered.index, ordered["a"], ordered["b"], strict=True):
        if a not in a_taken and b not in b_taken:
            a_taken.add(a)
            b_taken.add(b)
            kept.append(i)
    return rows.loc[kept]


def greedy_pairs(pairs: DataFrame, by: list[str], ascending: bool = False) -> DataFrame:
    """One-to-one pairs of ``(*by, a, b, score)`` within each group."""
    return pairs.groupBy(*by).applyInPandas(lambda pdf: greedy(pdf, ascending), pairs.schema)


def spaced(rows: pd.DataFrame, at: str, score: str, apart: float) -> pd.DataFrame:
    """Best score first, a row only if it lies at least ``apart`` from all that are kept."""
    kept: list = []
    for i in rows.sort_values([score, at], ascending=[False, True]).index:
        if all(abs(rows[at][i] - rows[at][j]) >= apart for j in kept):
            kept.append(i)
    return rows.loc[kept]


def spaced_rows(rows: DataFrame, by: list[str], at: str, score: str, apart: float) -> DataFrame:
    return rows.groupBy(*by).applyInPandas(lambda pdf: spaced(pdf, at, score, apart), rows.schema)
