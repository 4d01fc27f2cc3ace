"""The full table profile: one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowassay import constants as C
from rowassay.functions.cleaning import finite
from rowassay.operators.column_stats import is_numeric, one_pass_stats
from rowassay.operators.medians import medians, order_statistics
from rowassay.operators.profile_state import TOP_TYPE, estimated_profile, profile_state
from rowassay.operators.value_counts import Counted, counted_families, distinct_counts, leading_values, name_of, slots

NUMERIC_PARTS = ("min", "max", "mean", "median", "std", "sum")


def bounded_sample(df: DataFrame, rows: int = C.SAMPLE_ROWS, fraction: float | None = None, seed: int = 42) -> tuple[DataFrame, str]:
    """The rows to analyse and whether they are ``full`` or ``sampled`` (S3).

    Counting stops after ``rows + 1`` rows. With ``fraction`` the sample is spread over the table and
    drawn by every task on its own; without it the first ``rows`` rows are taken in file order.
    """
    if df.select(F.lit(1)).limit(rows + 1).count() <= rows:
        return df, "full"
    return (df.sample(fraction=fraction, seed=seed) if fraction is not None else df.limit(rows)), "sampled"


def _numeric_counts(counted: Counted) -> dict[str, DataFrame]:
    return {name: counts for name, (members, counts) in counted.items() if is_numeric(members[0].type)}


def column_medians(df: DataFrame, columns=None) -> DataFrame:
    """Exact median of each numeric column: ordinal_position, name, median; no rows without one."""
    members = [s for s in slots(df, columns) if is_numeric(s.type)]
    if not members:
        return df.sparkSession.createDataFrame([], "ordinal_position int, name string, median double")
    found = medians(_numeric_counts(counted_families(df, {s.field.name for s in members})))
    return found.select(F.col("position").alias("ordinal_position"), name_of(members).alias("name"), finite(F.col("median")).alias("median"))


def column_order_statistics(df: DataFrame, fractions=(0.0, 0.5, 1.0), columns=None, counted: Counted | None = None) -> DataFrame:
    """Exact values of each numeric column at fractions of its order, as text of the column's own type.

    One row for each column and fraction: ordinal_position, name, fraction, lower, upper; both differ where the fraction lies between two
    values. Whole numbers and decimals never pass through a double. ``counted`` may be counts of the same columns made before.
    """
    members = [s for s in slots(df, columns) if is_numeric(s.type)]
    if not members:
        return df.sparkSession.createDataFrame([], "ordinal_position int, name string, fraction double, lower string, upper string")
    counted = counted_families(df, {s.field.name for s in members}) if counted is None else counted
    found = order_statistics(_numeric_counts(counted), tuple(map(float, fractions)))
    return found.select(F.col("position").alias("ordinal_position"), name_of(members).alias("name"), "fraction", "lower", "upper")


def _tagged(keys: dict | None, rows: DataFrame) -> DataFrame:
    return rows.select(*[F.lit(v).alias(k) for k, v in (keys or {}).items()], "*")


def _finished(rows: DataFrame, sampling: str) -> DataFrame:
    """Profile column order, with rates and empty lists in place of missing values."""
    numeric = ", ".join(f"'{p}', {'median' if p == 'median' else 'numeric.' + p}" for p in NUMERIC_PARTS)
    distinct = "coalesce(distinct_count, 0L)"
    return rows.selectExpr(
        "ordinal_position",
        "name",
        "physical_type",
        "logical_type",
        f"'{sampling}' AS sampling",
        "sample_size",
        "non_null_count",
        "null_count",
        "null_rate",
        f"{distinct} AS distinct_count",
        f"CASE WHEN non_null_count > 0 THEN {distinct} / non_null_count ELSE 0.0D END AS distinct_rate",
        f"coalesce(top_values, CAST(array() AS {TOP_TYPE})) AS top_values",
        "placeholders",
        f"named_struct({numeric}) AS numeric",
        "temporal",
        "string_length",
    )


PARTS = ("distinct", "top", "median")


def profile(
    df: DataFrame,
    *,
    top_limit: int = C.TOP_VALUES,
    keys: dict | None = None,
    sampling: str = "full",
    approximate: bool = False,
    parts=PARTS,
) -> DataFrame:
    """Profile every column of ``df``.

    Exact by default: one pass for the plain statistics, one shuffle of value counts per type family
    for distinct counts, top values and medians. ``parts`` leaves out those a caller does not need;
    what is left out reads as 0, empty or NULL. ``approximate=True`` answers everything in a single
    pass without any shuffle of values, from the sketches of ``profile_state``.
    ``keys`` are constant columns put in front, such as the dataset and version.
    """
    if approximate:
        return _tagged(keys, estimated_profile(profile_state(df), top_limit).withColumn("sampling", F.lit(sampling)))
    counted, found = counted_families(df), []
    numbers = _numeric_counts(counted)
    if "distinct" in parts and counted:
        found.append(_padded(distinct_counts(counted)))
    if "top" in parts and counted:
        lists = "array_sort(collect_list(struct(rank, value, count))) AS ranked"
        found.append(_padded(leading_values(df, counted, top_limit).groupBy("position").agg(F.expr(lists))))
    if "top" in parts and "text" in counted:
        spelled = counted["text"][1].where("digest IS NULL").where(F.lower("head").isin(*C.PLACEHOLDERS))
        entries = "transform(array_sort(collect_list(struct(-n AS back, head AS value))), e -> struct(0 AS rank, e.value, -e.back AS count)) AS hits"
        found.append(_padded(spelled.groupBy("position").agg(F.expr(entries))))
    if "median" in parts and numbers:
        found.append(_padded(medians(numbers)))
    stats = one_pass_stats(df)
    if not found:
        missing = [F.lit(None).cast(t).alias(c) for c, t in {"distinct_count": "bigint", "median": "double", "top_values": TOP_TYPE, "placeholders": TOP_TYPE}.items()]
        return _tagged(keys, _finished(stats.select("*", *missing), sampling))
    # At most three rows per column meet here, and one per column is broadcast.
    merged = (
        reduce(DataFrame.unionAll, found)
        .groupBy("position")
        .agg(*[F.expr(e) for e in ("max(distinct_count) AS distinct_count", "max(median) AS median", "first(ranked, true) AS ranked", "first(hits, true) AS hits")])
    )
    rows = stats.join(F.broadcast(merged.withColumnRenamed("position", "ordinal_position")), "ordinal_position", "left")
    cell = "e -> named_struct('value', e.value, 'count', e.count, 'frequency', e.count / non_null_count)"
    top = f"transform(filter(ranked, e -> e.value IS NOT NULL), {cell}) AS top_values"
    # all placeholder spellings of the whole column, not only those among the top values
    hits = f"coalesce(transform(hits, {cell}), CAST(array() AS {TOP_TYPE})) AS placeholders" if "top" in parts else f"CAST(NULL AS {TOP_TYPE}) AS placeholders"
    median = "CASE WHEN NOT isnan(median) AND abs(median) < double('infinity') THEN median END AS median"
    kept = [c for c in rows.columns if c not in ("median", "ranked", "hits", "distinct_count")]
    return _tagged(keys, _finished(rows.selectExpr(*kept, "distinct_count", median, top, hits), sampling))


def _padded(rows: DataFrame) -> DataFrame:
    """Missing columns of the merge layout filled with NULL."""
    layout = {"distinct_count": "bigint", "ranked": "array<struct<rank:int,value:string,count:bigint>>", "hits": "array<struct<rank:int,value:string,count:bigint>>", "median": "double"}
    return rows.selectExpr("position", *[c if c in rows.columns else f"CAST(NULL AS {t}) AS {c}" for c, t in layout.items()])


def smallest_distinct(profiled: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Smallest per-column distinct count, the column-wise guess at distinct rows."""
    return profiled.groupBy(*(keys or [])).agg(
        F.coalesce(F.min(F.when(F.col("sample_size") > 0, F.col("distinct_count"))), F.lit(0)).cast("bigint").alias("distinct_rows"),
        F.coalesce(F.max("sample_size"), F.lit(0)).cast("bigint").alias("row_count"),
    )
