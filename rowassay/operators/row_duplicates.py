"""Duplicate rows and distinct rows of whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowassay.operators.value_counts import cell_text, slots

NARROW_COLUMNS = 4
FIXED_WIDTH = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def row_key(df: DataFrame) -> list[Column]:
    """What identifies a row: its few fixed-width columns, else a 32-byte SHA-256 over all cells.

    With the digest the shuffle carries 40 bytes per row however wide the table is.
    """
    members = slots(df)
    if len(members) <= NARROW_COLUMNS and all(isinstance(s.type, FIXED_WIDTH) for s in members):
        return [s.value.alias(f"k{s.position}") for s in members]
    parts = ", ".join(cell_text(s.sql, s.type) for s in members)
    return [F.expr(f"unhex(sha2(concat({parts}), 256))").alias("k")]


def row_duplicates(df: DataFrame) -> DataFrame:
    """One row: row_count, distinct_rows, duplicate_members, removable_rows (A9 exact, A10).

    Copies collapse on the map side, so a row repeated across a third of the table stays one entry per task.
    """
    keyed = df.select(*row_key(df))
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_members"),
    )
    return totals.withColumn("removable_rows", F.col("row_count") - F.col("distinct_rows"))
