"""Detectors: profile rows in, finding rows out. They never touch the data again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowassay import constants as C
from rowassay.operators.profile import smallest_distinct
from rowassay.operators.value_counts import by_family, family_counts, name_of



def percent(value: Column) -> Column:
    """Share as a percentage with one decimal, ties to even."""
    return F.format_string("%.1f%%", F.bround(value * 100, 1))


def _details(**values: Column) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v.cast("string"))])


def _finding(kind: str, severity: Column, column: Column, metric: str, value: Column, threshold, description: Column, details: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"),
        severity.alias("severity"),
        column.cast("string").alias("column_name"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        description.alias("description"),
        details.alias("details"),
    )


def _missingness(threshold: float) -> Column:
    """Share of NULLs at or above the threshold."""
    share, name = F.col("null_rate"), F.col("name")
    severity = (
        F.when(share >= 0.9, "critical")
        .when(share >= max(threshold, 0.5), "high")
        .when(share >= threshold, "medium")
        .otherwise("low")
    )
    description = F.format_string(
        C.DESCRIPTION[C.MISSINGNESS], name, F.col("null_count"), percent(share), percent(F.lit(threshold))
    )
    details = _details(null_count=F.col("null_count"), non_null_count=F.col("non_null_count"), sample_size=F.col("sample_size"))
    row = _finding(C.MISSINGNESS, severity, name, "null_rate", share, threshold, description, details)
    return F.when((F.col("sample_size") > 0) & (share >= threshold), row)


def _cardinality() -> Column:
    """Columns whose values hardly ever repeat."""
    share, name = F.col("distinct_count") / F.nullif(F.col("non_null_count"), F.lit(0)), F.col("name")
    severity = F.when(F.col("sample_size") < 100, "info").when(share >= 0.95, "high").when(share >= 0.8, "medium").otherwise("low")
    description = F.format_string(
        C.DESCRIPTION[C.CARDINALITY],
        name, F.col("distinct_count"), F.col("non_null_count"), percent(share),
    )
    details = _details(distinct_count=F.col("distinct_count"), non_null_count=F.col("non_null_count"))
    row = _finding(C.CARDINALITY, severity, name, "distinct_rate", share, C.CARDINALITY_THRESHOLD, description, details)
    return F.when(share >= C.CARDINALITY_THRESHOLD, row)


def is_placeholder(value: Column) -> Column:
    return F.lower(value).isin(*C.PLACEHOLDERS)


def _placeholders() -> Column:
    """Placeholder spellings of a column; the value counts spellings."""
    hits = F.col("placeholders")
    description = F.format_string(C.DESCRIPTION[C.INVALID_VALUES], F.col("name"))
    row = _finding(
        C.INVALID_VALUES, F.lit("medium"), F.col("name"), "placeholder_top_value_count", F.size(hits), 0.0, description, _details(sentinels=F.to_json(hits))
    )
    return F.when(F.size(hits) > 0, row)


def _skew() -> Column:
    """Mean far from the median."""
    n = F.col("numeric")
    mean, median, std = n["mean"], n["median"], n["std"]
    value = F.abs(mean - median) / (F.abs(median) + F.abs(std))
    usable = n["min"].isNotNull() & n["max"].isNotNull() & mean.isNotNull() & (std != 0) & (F.abs(median) >= 1e-9)
    severity = F.when(value >= 0.5, "high").otherwise("medium")
    description = F.format_string(
        C.DESCRIPTION[C.OUTLIER],
        F.col("name"), F.format_string("%.2f", F.bround(value, 2)),
    )
    details = _details(mean=mean, median=median, std_deviation=std, min_value=n["min"], max_value=n["max"])
    row = _finding(C.OUTLIER, severity, F.col("name"), "mean_median_skew", value, C.SKEW_THRESHOLD, description, details)
    return F.when(usable & (value >= C.SKEW_THRESHOLD), row)


def _duplicates() -> Column:
    """Share of rows that repeat another row."""
    rows, distinct = F.col("row_count"), F.col("distinct_rows")
    extra = F.greatest(rows - distinct, F.lit(0))
    share = extra / F.nullif(rows, F.lit(0))
    severity = F.when(share >= 0.5, "high").when(share >= 0.2, "medium").otherwise("low")
    description = F.format_string(C.DESCRIPTION[C.DUPLICATES], extra, rows, percent(share))
    details = _details(duplicate_count=extra, row_count=rows, distinct_count=distinct)
    row = _finding(C.DUPLICATES, severity, F.lit(None), "duplicate_rate", share, C.DUPLICATE_THRESHOLD, description, details)
    return F.when((rows > 0) & (distinct > 0) & (share >= C.DUPLICATE_THRESHOLD), row)


def _emit(rows: DataFrame, keys: list[str], *found: Column) -> DataFrame:
    return rows.select(*keys, F.inline(F.array_compact(F.array(*found))))


def _with_placeholders(profiled: DataFrame) -> DataFrame:
    """Profiles without the spellings of whole columns (sketches, older ones) offer those among the top values."""
    among_top = F.filter("top_values", lambda e: is_placeholder(e["value"]))
    known = F.coalesce("placeholders", among_top) if "placeholders" in profiled.columns else among_top
    return profiled.withColumn("placeholders", known)


def missingness_findings(profiled: DataFrame, threshold: float = C.NULL_RATE_THRESHOLD, keys=()) -> DataFrame:
    """D1. Needs only the NULL counts of a profile."""
    return _emit(profiled, list(keys), _missingness(threshold))


def cardinality_findings(profiled: DataFrame, keys=()) -> DataFrame:
    """D2."""
    return _emit(profiled, list(keys), _cardinality())


def duplicate_findings(row_counts: DataFrame, keys=()) -> DataFrame:
    """D3 from row and distinct-row counts: exact ones, or the column-wise guess ``smallest_distinct``."""
    return _emit(row_counts, list(keys), _duplicates())


def placeholder_findings(profiled: DataFrame, keys=()) -> DataFrame:
    """D4 over all values of the columns of a profile."""
    return _emit(_with_placeholders(profiled), list(keys), _placeholders())


def skew_findings(profiled: DataFrame, keys=()) -> DataFrame:
    """D5."""
    return _emit(profiled, list(keys), _skew())


def placeholder_rows(df: DataFrame) -> DataFrame:
    """Rows holding a placeholder, per text column of the whole table (D4, full mode): name, spellings, rows."""
    members = by_family(df).get("text", [])
    if not members:
        return df.sparkSession.createDataFrame([], "ordinal_position int, name string, spellings bigint, rows bigint")
    hits = family_counts(df, "text", members).where("digest IS NULL").where(is_placeholder(F.col("head")))
    return (
        hits.groupBy("position")
        .agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("rows"))
        .select(F.col("position").alias("ordinal_position"), name_of(members).alias("name"), "spellings", "rows")
    )


def run_detectors(
    profiled: DataFrame,
    row_counts: DataFrame | None = None,
    threshold: float = C.NULL_RATE_THRESHOLD,
    keys=(),
) -> DataFrame:
    """All findings of a profile (U1). Column detectors share one pass over the profile rows.

    ``row_counts`` holds exact row counts (``row_duplicates``); without it the smallest column-wise
    distinct count stands in for distinct rows.
    """
    keys = list(keys)
    columns = _emit(_with_placeholders(profiled), keys, _missingness(threshold), _cardinality(), _placeholders(), _skew())
    rows = smallest_distinct(profiled, keys) if row_counts is None else row_counts
    return columns.unionByName(duplicate_findings(rows, keys))


def with_finding_ids(findings: DataFrame, keys=()) -> DataFrame:
    """A stable id per finding from its keys, kind, column and metric."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (*keys, "kind", "column_name", "metric")]
    return findings.withColumn("finding_id", F.sha2(F.concat_ws("|", *parts), 256))
