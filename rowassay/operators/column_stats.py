"""Per-column statistics from one unshuffled pass over the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rowassay.functions.cleaning import utc_ntz_sql
from rowassay.functions.logical_types import NUMERIC, TEMPORAL, logical_type, physical_type
from rowassay.operators.value_counts import Slot, slots

NUMBER_PARTS = ("min", "max", "mean", "std", "sum")


def is_numeric(data_type: T.DataType, boolean_as_number: bool = False) -> bool:
    kind = logical_type(data_type)
    return kind in NUMERIC or (boolean_as_number and kind == "boolean")


def _counts(slot: Slot) -> str:
    return f"count(1) AS sample_size, count({slot.sql}) AS non_null_count"


def _finite(value: str) -> str:
    return f"CASE WHEN NOT isnan({value}) AND abs({value}) < double('infinity') THEN {value} END"


def _numbers(slot: Slot, boolean_as_number: bool = False) -> str:
    """min and max skip NaN; mean, deviation and sum turn to NULL when a NaN or infinity is in them.

    Sums run in double so that whole-number columns of any length cannot overflow.
    """
    if not is_numeric(slot.type, boolean_as_number):
        return "named_struct(" + ", ".join(f"'{p}', CAST(NULL AS DOUBLE)" for p in NUMBER_PARTS) + ")"
    value = f"CAST({slot.sql} AS DOUBLE)"
    known = f"nullif({value}, double('NaN'))" if isinstance(slot.type, (T.FloatType, T.DoubleType)) else value
    parts = (
        f"min({known})",
        f"max({known})",
        f"avg({value})",
        f"CASE WHEN count({slot.sql}) = 1 THEN 0.0D ELSE stddev_samp({value}) END",
        f"sum({value})",
    )
    return "named_struct(" + ", ".join(f"'{n}', {_finite(p)}" for n, p in zip(NUMBER_PARTS, parts)) + ")"


def _times(slot: Slot) -> str:
    if logical_type(slot.type) not in TEMPORAL:
        return "named_struct('min', CAST(NULL AS TIMESTAMP_NTZ), 'max', CAST(NULL AS TIMESTAMP_NTZ))"
    value = utc_ntz_sql(slot.sql, slot.type)
    return f"named_struct('min', min({value}), 'max', max({value}))"


def _lengths(slot: Slot) -> str:
    if not isinstance(slot.type, T.StringType):
        return "named_struct('min', CAST(NULL AS INT), 'max', CAST(NULL AS INT), 'mean', CAST(NULL AS DOUBLE))"
    length = f"length({slot.sql})"
    return f"named_struct('min', min({length}), 'max', max({length}), 'mean', avg({length}))"


def unpivot(df: DataFrame, entries: list[str]) -> DataFrame:
    """Aggregate once into one struct per column, then turn the single row into one row per column."""
    names = [f"c{i}" for i in range(len(entries))]
    wide = df.agg(*[F.expr(f"struct({e})").alias(n) for e, n in zip(entries, names)])
    return wide.selectExpr(f"inline(array({', '.join(names)}))")


def _identity(slot: Slot) -> str:
    name = slot.field.name.replace("\\", "\\\\").replace("'", "\\'")
    kinds = f"'{physical_type(slot.type)}' AS physical_type, '{logical_type(slot.type)}' AS logical_type"
    return f"{slot.position} AS ordinal_position, '{name}' AS name, {kinds}"


def _with_nulls(rows: DataFrame) -> DataFrame:
    nulls = "sample_size - non_null_count"
    return rows.selectExpr("*", f"{nulls} AS null_count", f"CASE WHEN sample_size > 0 THEN ({nulls}) / sample_size ELSE 0.0D END AS null_rate")


def column_counts(df: DataFrame, columns=None) -> DataFrame:
    """Row, NULL and non-NULL counts with the NULL rate (A1)."""
    return _with_nulls(unpivot(df, [f"{_identity(s)}, {_counts(s)}" for s in slots(df, columns)]))


def _statistics(df: DataFrame, members: list[Slot], entry, missing: str) -> DataFrame:
    if not members:
        raise ValueError(f"the table has no {missing} column")
    rows = unpivot(df, [f"{_identity(s)}, {entry(s)} AS stats" for s in members])
    return rows.select("ordinal_position", "name", "stats.*")


def numeric_stats(df: DataFrame, columns=None, boolean_as_number: bool = False) -> DataFrame:
    """min, max, mean, sample deviation and sum of the numeric columns (A3; medians are separate)."""
    members = [s for s in slots(df, columns) if is_numeric(s.type, boolean_as_number)]
    return _statistics(df, members, lambda s: _numbers(s, boolean_as_number), "numeric")


def temporal_stats(df: DataFrame, columns=None) -> DataFrame:
    """Earliest and latest moment of date and timestamp columns (A4)."""
    return _statistics(df, [s for s in slots(df, columns) if logical_type(s.type) in TEMPORAL], _times, "date or timestamp")


def length_stats(df: DataFrame, columns=None) -> DataFrame:
    """Character length of text columns: min, max, mean (A5)."""
    return _statistics(df, [s for s in slots(df, columns) if isinstance(s.type, T.StringType)], _lengths, "text")


def one_pass_stats(df: DataFrame, columns=None, boolean_as_number: bool = False, extra=None) -> DataFrame:
    """All of the above in one row per column; ``extra(slot)`` may add further aggregates as SQL."""
    entries = [
        f"{_identity(s)}, {_counts(s)}, {_numbers(s, boolean_as_number)} AS numeric, {_times(s)} AS temporal, "
        f"{_lengths(s)} AS string_length" + (f", {extra(s)}" if extra else "")
        for s in slots(df, columns)
    ]
    return _with_nulls(unpivot(df, entries))
