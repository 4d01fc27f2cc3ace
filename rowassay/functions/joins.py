"""Joins whose keys may be NULL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``names`` where NULL meets NULL; the names appear once, from the left side."""
    renamed = right.withColumnsRenamed({n: f"_right_{n}" for n in names})
    on = [F.col(n).eqNullSafe(F.col(f"_right_{n}")) for n in names]
    return left.join(renamed, on, how).drop(*[f"_right_{n}" for n in names])
