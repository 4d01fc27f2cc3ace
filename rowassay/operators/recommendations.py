"""Findings to constrained repair recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowassay import constants as C
from rowassay.functions import scoring as X

PARAMS = "map<string,string>"


def impute_strategy(metric: Column) -> Column:
    """``mean`` when the finding's metric names a numeric statistic, else ``mode`` (R2)."""
    return F.when(F.lower(metric).isin(*C.NUMERIC_METRIC_NAMES), "mean").otherwise("mode")


def _four(value: Column) -> Column:
    return F.format_string("%.4f", F.bround(value, 4))


def _action(title: Column, rationale: Column, operation: str, **params: Column) -> Column:
    pairs = [x for k, v in params.items() for x in (F.lit(k), v.cast("string"))]
    values = F.create_map(*pairs)
    return F.struct(
        title.alias("title"),
        rationale.alias("rationale"),
        F.struct(F.lit(operation).alias("kind"), values.cast(PARAMS).alias("params"), F.lit(True).alias("preview_only")).alias("operation"),
    )


def _actions(strategy: Column) -> Column:
    """Title, rationale and operation per finding: the whole rule table as one CASE."""
    kind, severity, value = F.col("kind"), F.col("severity"), F.col("value")
    column = F.coalesce("column_name", F.lit(C.DATASET_SCOPE))
    severe = severity.isin("critical", "high")
    seen, limit = _four(value), _four(F.col("threshold"))

    def titled(case: str) -> Column:
        return F.format_string(C.TITLE[case], column)

    drop = _action(
        titled("drop_column"),
        F.format_string("Null rate %s of '%s' is beyond the usable limit (0.80); check for consumers, then drop it.", seen, column),
        "drop_column", column=column, strategy=F.lit("drop"),
    )
    impute = _action(
        titled("impute_missing"),
        F.format_string("Null rate %s of '%s' exceeds its threshold (%s); fill the gaps by '%s' and keep all rows.", seen, column, limit, strategy),
        "impute_missing", column=column, strategy=strategy,
    )
    watch_nulls = _action(
        titled("review_missing"),
        F.format_string("Null rate %s of '%s' is mild and may be intended; look upstream first.", seen, column),
        "review", column=column, reason=F.lit("low_severity_missingness"),
    )
    dedupe = _action(
        F.lit(C.TITLE["drop_duplicates"]),
        F.format_string("Duplicate rate %s exceeds its threshold (%s); rule out history tables, then keep one row of each.", seen, limit),
        "drop_duplicates", scope=F.lit("exact_rows"),
    )
    cast = _action(
        titled("cast_type"),
        F.format_string("'%s' shows %s placeholder spellings (threshold %s); turn them into NULL or cast to the intended type.", column, seen, limit),
        "cast_type", column=column, reason=F.lit("invalid_values"),
    )
    cap = _action(
        titled("cap_outliers"),
        F.format_string("Skew %s of '%s' exceeds its threshold (%s); cap the values beyond it.", seen, column, limit),
        "cap_outliers", column=column, threshold=F.col("threshold"),
    )
    watch_skew = _action(
        titled("review_outliers"),
        F.format_string("Skew %s of '%s' is moderate; the values may be genuine.", seen, column),
        "review", column=column, reason=F.lit("moderate_outliers"),
    )
    group = _action(
        titled("group_rare_categorical"),
        F.format_string("Distinct rate %s of '%s' exceeds its threshold (%s); fold rare values into one bucket.", seen, column, limit),
        "group_rare_categorical", column=column, min_count=F.lit(C.RARE_CATEGORY_MIN_COUNT),
    )
    unknown = _action(
        F.lit(C.TITLE["review_unknown"]),
        F.format_string("No rule covers findings of kind '%s'.", kind),
        "review", reason=F.lit("unsupported_finding_kind"),
    )
    return (
        F.when((kind == C.MISSINGNESS) & (severe | (value >= C.DROP_COLUMN_NULL_RATE)), drop)
        .when((kind == C.MISSINGNESS) & (severity == "medium"), impute)
        .when(kind == C.MISSINGNESS, watch_nulls)
        .when(kind == C.DUPLICATES, dedupe)
        .when(kind == C.INVALID_VALUES, cast)
        .when((kind == C.OUTLIER) & severe, cap)
        .when(kind == C.OUTLIER, watch_skew)
        .when(kind == C.CARDINALITY, group)
        .otherwise(unknown)
    )


def confidence_and_priority(findings: DataFrame) -> DataFrame:
    """Rounded confidence and integer priority, ties to even."""
    raw = X.detection_confidence(F.col("value"), F.col("threshold")) * X.data_error_confidence(F.col("kind"), F.col("value"))
    weight = X.mapped(F.col("severity"), C.SEVERITY_PRIORITY_WEIGHT, 0)
    return findings.withColumn("confidence", F.bround(raw, 4)).withColumn("priority", F.bround(weight * X.clamp01(raw), 0).cast("int"))


def recommend(findings: DataFrame, keys=(), strategy: Column | None = None) -> DataFrame:
    """One recommendation per finding, untrimmed.

    ``strategy`` may replace the metric-based choice of imputation, for instance by the column's type.
    """
    chosen = impute_strategy(F.col("metric")) if strategy is None else strategy
    rows = confidence_and_priority(findings).withColumn("action", _actions(chosen))
    supporting = F.array(F.col("finding_id")) if "finding_id" in findings.columns else F.array().cast("array<string>")
    return rows.select(
        *keys,
        X.mapped(F.col("kind"), C.RECOMMENDATION_KIND, C.REVIEW_KIND).alias("kind"),
        "severity",
        F.col("action.title").alias("title"),
        F.col("action.rationale").alias("rationale"),
        F.array(F.coalesce("column_name", F.lit(C.DATASET_SCOPE))).alias("affected_columns"),
        supporting.alias("supporting_findings"),
        "confidence",
        "priority",
        F.col("action.operation").alias("operation"),
    )


def keep_best(recommendations: DataFrame, limit: int | None = C.MAX_RECOMMENDATIONS, keys=()) -> DataFrame:
    """The ``limit`` first recommendations per key, by priority, then title (T6); None keeps all.

    The rank limit is applied in every task before the shuffle, so no key brings all its rows together.
    """
    order = [F.desc("priority"), F.asc("title"), F.asc(F.col("affected_columns")[0])]
    window = Window.partitionBy(*keys).orderBy(*order) if keys else Window.partitionBy(F.lit(0)).orderBy(*order)
    ranked = recommendations.withColumn("rank", F.row_number().over(window))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def recommendation_counts(recommendations: DataFrame, keys=()) -> DataFrame:
    """Counts per kind and per severity over the untrimmed set."""
    keys = list(keys)
    sets = [[F.col(c) for c in (*keys, d)] for d in ("kind", "severity")]
    grouped = recommendations.groupingSets(sets, *[F.col(c) for c in (*keys, "kind", "severity")]).agg(
        F.count(F.lit(1)).alias("recommendation_count"), F.grouping("kind").alias("_by_severity")
    )
    return grouped.select(
        *keys,
        F.when(F.col("_by_severity") == 1, "severity").otherwise("kind").alias("axis"),
        F.coalesce("kind", "severity").alias("bucket"),
        "recommendation_count",
    )
