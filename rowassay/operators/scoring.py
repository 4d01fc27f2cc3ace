"""Findings to penalties, scores, grades and their breakdown."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowassay import constants as C
from rowassay.functions import scoring as X


def scored_findings(findings: DataFrame) -> DataFrame:
    """Findings with both confidences, the severity weight and the penalty."""
    kind, severity, value, threshold = (F.col(c) for c in ("kind", "severity", "value", "threshold"))
    return (
        findings.withColumn("detection_confidence", X.detection_confidence(value, threshold))
        .withColumn("data_error_confidence", X.data_error_confidence(kind, value))
        .withColumn("severity_weight", X.penalty_weight(severity))
        .withColumn("penalty", F.col("severity_weight") * F.col("detection_confidence") * F.col("data_error_confidence"))
    )


def quality_scores(tables: DataFrame, scored: DataFrame, keys: list[str]) -> DataFrame:
    """Score and grade per table (A12). ``tables`` has the keys and ``column_count``.

    Tables without findings keep their row and score 100. Penalties are summed before the join, so the
    join sees one row per table on either side.
    """
    sums = scored.groupBy(*keys).agg(F.sum("penalty").alias("total_penalty"), F.count(F.lit(1)).alias("finding_count"))
    joined = tables.join(sums, keys, "left")
    total = F.coalesce("total_penalty", F.lit(0.0))
    divisor = F.greatest(F.col("column_count"), F.lit(1))
    share = F.least(F.lit(1.0), total / divisor)
    rows = joined.select(
        *keys,
        "column_count",
        F.coalesce("finding_count", F.lit(0)).alias("finding_count"),
        total.alias("total_penalty"),
        share.alias("normalized_penalty"),
        F.bround(F.lit(100.0) * (1.0 - share), 2).alias("score"),
    )
    return rows.withColumn("grade", X.grade(F.col("score")))


def score_breakdown(scored: DataFrame, tables: DataFrame | None = None, keys=()) -> DataFrame:
    """Penalty per kind, per severity, per column and overall, in one aggregation.

    With ``tables`` (keys and ``column_count``) each bucket also gets its share of the score.
    """
    keys = list(keys)
    rows = scored.withColumn("column_name", F.coalesce("column_name", F.lit(C.DATASET_SCOPE)))
    dimensions = ("kind", "severity", "column_name")
    sets = [[*keys, d] for d in dimensions] + [list(keys)]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in (*keys, *dimensions)]).agg(
        F.count(F.lit(1)).alias("finding_count"),
        F.sum("penalty").alias("penalty_total"),
        *[F.grouping(d).alias(f"_{d}") for d in dimensions],
    )
    axis = F.when(F.col("_kind") == 0, "kind").when(F.col("_severity") == 0, "severity").when(F.col("_column_name") == 0, "column")
    buckets = grouped.select(
        *keys,
        axis.otherwise("all").alias("axis"),
        F.coalesce("kind", "severity", "column_name", F.lit("all")).alias("bucket"),
        "finding_count",
        "penalty_total",
    )
    if tables is None:
        return buckets
    divisor = F.greatest(F.col("column_count"), F.lit(1))
    joined = buckets.join(tables.select(*keys, "column_count"), keys)
    return joined.withColumn("normalized_penalty", F.least(F.lit(1.0), F.col("penalty_total") / divisor)).drop("column_count")


def findings_per_kind(findings: DataFrame, keys=()) -> DataFrame:
    """A13."""
    return findings.groupBy(*keys, "kind").agg(F.count(F.lit(1)).alias("finding_count"))


def table_sizes(profiled: DataFrame, keys: list[str]) -> DataFrame:
    """Column count per profiled table."""
    return profiled.groupBy(*keys).agg(F.count(F.lit(1)).alias("column_count"))
