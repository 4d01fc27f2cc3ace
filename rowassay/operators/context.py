"""Bounded, readable context of a table's findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from rowassay import constants as C
from rowassay.functions.scoring import severity_rank

ITEM = ("finding_id", "kind", "severity", "column_name", "value", "threshold", "description")


def leading_findings(findings: DataFrame, keys: list[str], limit: int = C.CONTEXT_FINDINGS) -> DataFrame:
    """The ``limit`` worst findings per table; the limit is applied before the shuffle."""
    order = [F.desc(severity_rank(F.col("severity"))), F.desc("value"), F.asc("column_name"), F.asc("kind"), F.asc("finding_id")]
    window = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)


def finding_context(findings: DataFrame, keys: list[str], limit: int = C.CONTEXT_FINDINGS) -> DataFrame:
    """At most ``limit`` findings per table as one ordered list."""
    items = F.array_sort(F.collect_list(F.struct("rank", *ITEM)))
    return leading_findings(findings, keys, limit).groupBy(*keys).agg(items.alias("findings"))


def context_text(findings: DataFrame, scores: DataFrame, keys: list[str], header: str, limit: int = C.CONTEXT_FINDINGS) -> DataFrame:
    """Header, key lines and one line per finding as text (C2). ``scores`` has keys, name, score, grade."""
    line = F.format_string(
        C.CONTEXT_LINE,
        F.col("finding_id"),
        F.col("kind"),
        F.col("severity"),
        F.coalesce("column_name", F.lit(C.DATASET_SCOPE)),
        F.col("value").cast("string"),
        F.col("threshold").cast("string"),
        F.col("description"),
    )
    listed = leading_findings(findings, keys, limit).withColumn("line", line)
    lines = listed.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("lines"), F.count(F.lit(1)).alias("finding_count")
    )
    unknown = F.lit("unknown")
    head = F.concat_ws(
        "\n",
        F.lit(header),
        F.concat(F.lit("dataset_name: "), F.col("name")),
        F.concat(F.lit("profile_id: "), F.concat_ws("/", *keys)),
        F.concat(F.lit("current_score: "), F.coalesce(F.col("score").cast("string"), unknown)),
        F.concat(F.lit("current_grade: "), F.coalesce("grade", unknown)),
        F.concat(F.lit("finding_count: "), F.coalesce("finding_count", F.lit(0)).cast("string")),
    )
    body = F.concat(F.lit("\nfindings:\n"), F.array_join(F.transform("lines", lambda e: e["line"]), "\n"))
    return scores.join(lines, keys, "left").select(
        *keys, F.concat(head, F.when(F.col("lines").isNotNull(), body).otherwise(F.lit(""))).alias("context")
    )


def hypotheses(findings: DataFrame, keys: list[str], limit: int = C.HYPOTHESES) -> DataFrame:
    """A placeholder hypothesis for each of the worst findings."""
    kind = F.col("kind")
    category = (
        F.when(kind.isin("missingness", "outlier"), "data_quality")
        .when(kind.isin("type_changed", "cardinality"), "schema_drift")
        .otherwise("other")
    )
    return leading_findings(findings, keys, limit).select(
        *keys,
        "rank",
        category.alias("category"),
        F.coalesce("column_name", F.lit(C.DATASET_SCOPE)).alias("column_name"),
        F.col("finding_id"),
        F.lit(C.HYPOTHESIS_CONFIDENCE).alias("confidence"),
    )
