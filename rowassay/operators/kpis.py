"""Headline indicators of a profiled table, and the display form of its columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowassay import constants as C
from rowassay.functions.logical_types import NUMERIC
from rowassay.functions.predicates import is_identifier_name


def completeness() -> Column:
    """Non-NULL cells over all cells (A15); needs the NULL counts of a profile."""
    share = F.sum("non_null_count") / F.nullif(F.sum("sample_size"), F.lit(0))
    return F.coalesce(share, F.lit(0.0))


def uniqueness() -> Column:
    """Mean distinct rate of the columns."""
    return F.coalesce(F.avg("distinct_rate"), F.lit(0.0))


def validity() -> Column:
    """One minus a hundredth of the mean capped |mean / deviation| of the numeric columns."""
    numeric = F.col("logical_type").isin(*NUMERIC)
    mean, std = F.coalesce("numeric.mean", F.lit(0.0)), F.coalesce("numeric.std", F.lit(0.0))
    spread = F.when(std == 0, F.lit(0.0)).otherwise(F.least(F.abs(mean / F.nullif(std, F.lit(0.0))), F.lit(1.0)))
    return F.coalesce(F.lit(1.0) - F.avg(F.when(numeric, spread)) * 0.01, F.lit(C.VALIDITY_DEFAULT))


def timeliness() -> Column:
    """Mean covered share of 1800 days over the temporal columns."""
    first, last = F.col("temporal.min"), F.col("temporal.max")
    days = F.timestamp_diff("MICROSECOND", first, last) / F.lit(86_400_000_000.0)
    covered = F.when(days > 0, F.least(days / C.TIMELINESS_DAYS, F.lit(1.0))).otherwise(F.lit(0.0))
    return F.coalesce(F.avg(F.when(first.isNotNull() | last.isNotNull(), covered)), F.lit(C.TIMELINESS_DEFAULT))


def indicators(profiled: DataFrame, keys=()) -> DataFrame:
    """All four indicators per table in one aggregation."""
    measures = {"completeness": completeness(), "uniqueness": uniqueness(), "validity": validity(), "timeliness": timeliness()}
    return profiled.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])


def column_display(profiled: DataFrame, examples: int = 3) -> DataFrame:
    """Range, example values and identifier flag per column."""
    values = F.transform(F.slice("top_values", 1, examples), lambda e: e["value"])
    return profiled.select(
        "name",
        F.coalesce(F.col("numeric.min").cast("string"), F.col("temporal.min").cast("string")).alias("min_shown"),
        F.coalesce(F.col("numeric.max").cast("string"), F.col("temporal.max").cast("string")).alias("max_shown"),
        F.array_join(values, ", ").alias("examples"),
        is_identifier_name(F.col("name")).alias("is_identifier"),
    )
