"""Comparison of two table versions: schema, distributions and scores.

Both sides are summary tables (one row per column, or one score per table), so every join here is an
equi-join of small inputs whatever the size of the profiled data; AQE picks broadcast or shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowassay import constants as C
from rowassay.functions import drift as X
from rowassay.functions.logical_types import CATEGORICAL, NUMERIC, logical_type
from rowassay.operators.value_counts import by_family, family_counts, name_of


def schema_diff(base: DataFrame, target: DataFrame, keys=()) -> DataFrame:
    """Added, removed and type-changed columns between two column lists."""
    on = [*keys, "name"]
    side = ("physical_type", "logical_type")
    left = base.select(*on, *[F.col(c).alias(f"base_{c}") for c in side], F.lit(True).alias("in_base"))
    right = target.select(*on, *[F.col(c).alias(f"target_{c}") for c in side], F.lit(True).alias("in_target"))
    joined = left.join(right, on, "full_outer")
    same = F.lit(True)
    for c in side:
        same = same & F.col(f"base_{c}").eqNullSafe(F.col(f"target_{c}"))
    change = F.when(F.col("in_base").isNull(), "added").when(F.col("in_target").isNull(), "removed").when(~same, "type_changed")
    columns = [f"{s}_{c}" for c in side for s in ("base", "target")]
    return joined.select(*on, change.alias("change"), *columns).where(F.col("change").isNotNull())


def column_names_diff(base: DataFrame, target: DataFrame) -> DataFrame:
    """Set difference and intersection of two column-name lists (U2): name, membership."""
    left, right = base.select("name"), target.select("name")
    return (
        right.exceptAll(left).withColumn("membership", F.lit("added"))
        .unionByName(left.exceptAll(right).withColumn("membership", F.lit("removed")))
        .unionByName(left.intersect(right).withColumn("membership", F.lit("common")))
    )


def _paired(base: DataFrame, target: DataFrame, keys) -> DataFrame:
    on = [*keys, "name"]
    parts = ("logical_type", "numeric", "top_values")
    left = base.select(*on, *[F.col(c).alias(f"base_{c}") for c in parts if c in base.columns])
    right = target.select(*on, *[F.col(c).alias(f"target_{c}") for c in parts if c in target.columns])
    return left.join(right, on)


def _metric(name: str, base: Column, target: Column, psi: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), base.cast("double").alias("base_value"), target.cast("double").alias("target_value"), psi.alias("psi"))


def _numbers() -> Column:
    """The compared statistics of a column pair."""
    none = F.lit(None).cast("double")
    return F.array(*[_metric(m, F.col(f"base_numeric.{m}"), F.col(f"target_numeric.{m}"), none) for m in C.DRIFT_METRICS])


def _changes(rows: DataFrame) -> DataFrame:
    base, target = F.col("base_value"), F.col("target_value")
    known = rows.where(base.isNotNull() | target.isNotNull() | F.col("psi").isNotNull())
    return known.select("*", X.absolute_change(base, target).alias("absolute_change"), X.relative_change(base, target).alias("relative_change"))


def numeric_drift(base: DataFrame, target: DataFrame, keys=()) -> DataFrame:
    """Change of mean, median, deviation, min and max per common column.

    A metric missing on one side keeps its row with NULL changes; missing on both it is left out.
    """
    pairs = _paired(base, target, keys)
    return _changes(pairs.select(*keys, F.col("name").alias("column"), F.inline(_numbers()))).drop("psi")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, e: acc + e["count"])


def category_counts(df: DataFrame, columns=None) -> DataFrame:
    """Every value of every categorical column with its count: name, head, digest, n.

    Long texts are named by their head and digest, so values of any length compare exactly.
    """
    members = [s for s in by_family(df, columns).get("text", []) if logical_type(s.type) in CATEGORICAL]
    if not members:
        return df.sparkSession.createDataFrame([], "name string, head string, digest binary, n bigint")
    return family_counts(df, "text", members).select(name_of(members).alias("name"), "head", "digest", "n")


def category_union(base: DataFrame, target: DataFrame) -> DataFrame:
    """Values of either side with both counts (U3): name, head, digest, base_count, target_count."""
    zero = F.lit(0).cast("bigint")
    both = base.select("name", "head", "digest", F.col("n").alias("b"), zero.alias("t")).unionByName(
        target.select("name", "head", "digest", zero.alias("b"), F.col("n").alias("t"))
    )
    return both.groupBy("name", "head", "digest").agg(F.sum("b").alias("base_count"), F.sum("t").alias("target_count"))


def population_stability(base: DataFrame, target: DataFrame) -> DataFrame:
    """Population-stability index per column over all values of both sides (J3), from ``category_counts``.

    A column that has values on one side only has no index.
    """
    values = category_union(base, target)
    totals = values.groupBy("name").agg(F.sum("base_count").alias("base_total"), F.sum("target_count").alias("target_total"))
    joined = values.join(totals.where("base_total > 0 AND target_total > 0"), "name")
    term = X.psi_term(F.col("base_count"), F.col("base_total"), F.col("target_count"), F.col("target_total"))
    return joined.groupBy("name").agg(F.sum(term).alias("psi"))


def _with_psi(pairs: DataFrame) -> DataFrame:
    """Add ``psi`` over the union of both top-value lists, which are short by construction."""

    def counts(side: str) -> Column:
        # other types may show unlike values alike, which a map refuses
        categorical = F.col(f"{side}_logical_type").isin(*CATEGORICAL)
        return F.when(categorical, F.map_from_entries(F.transform(f"{side}_top_values", lambda e: F.struct(e["value"], e["count"]))))

    zero = F.lit(0).cast("bigint")

    def add(acc: Column, key: Column) -> Column:
        b, t = F.coalesce(F.col("_b")[key], zero), F.coalesce(F.col("_t")[key], zero)
        return acc + X.psi_term(b, F.col("_b_total"), t, F.col("_t_total"))

    ready = pairs.select(
        "*",
        counts("base").alias("_b"),
        counts("target").alias("_t"),
        _total(F.col("base_top_values")).alias("_b_total"),
        _total(F.col("target_top_values")).alias("_t_total"),
    )
    psi = F.aggregate(F.array_union(F.map_keys("_b"), F.map_keys("_t")), F.lit(0.0), add)
    return ready.withColumn("psi", psi).drop("_b", "_t", "_b_total", "_t_total")


def short_list_drift(base: DataFrame, target: DataFrame, keys=()) -> DataFrame:
    """The index over the union of both profiles' top values only, for when nothing but profiles is at hand."""
    rows = _with_psi(_paired(base, target, keys))
    return rows.select(*keys, F.col("name").alias("column"), "psi", "base_top_values", "target_top_values")


def distribution_drift(base: DataFrame, target: DataFrame, keys=(), psi: DataFrame | None = None) -> DataFrame:
    """Numeric columns by metric, text and boolean columns by PSI, from one join and one pass.

    ``psi`` holds the indices over all values (``population_stability``, with the keys); without it the
    profiles' top values stand in. A column that is numeric on one side only is compared as numbers.
    """
    numeric = F.col("base_logical_type").isin(*NUMERIC) | F.col("target_logical_type").isin(*NUMERIC)
    text = F.col("base_logical_type").isin(*CATEGORICAL) | F.col("target_logical_type").isin(*CATEGORICAL)
    none = F.lit(None).cast("double")
    measured = F.when(numeric, _numbers()).when(text, F.array(_metric("psi", none, none, F.col("psi"))))
    paired = _paired(base, target, keys)
    indexed = _with_psi(paired) if psi is None else paired.join(psi, [*keys, "name"], "left")
    pairs = indexed.select(*keys, F.col("name").alias("column"), F.inline(measured))
    band = F.coalesce(X.psi_drift_band(F.col("psi")), X.numeric_drift_band(F.col("relative_change")))
    return _changes(pairs).withColumn("band", band)


def score_drift(base: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Score and grade change per table (J5); a grade change needs both grades."""
    left = base.select(*keys, F.col("score").alias("base_score"), F.col("grade").alias("base_grade"))
    right = target.select(*keys, F.col("score").alias("target_score"), F.col("grade").alias("target_grade"))
    delta = F.bround(F.col("target_score") - F.col("base_score"), 4)
    return left.join(right, keys, "full_outer").select(
        *keys,
        "base_score",
        "target_score",
        delta.alias("delta"),
        F.bround(F.abs(delta), 4).alias("absolute_delta"),
        "base_grade",
        "target_grade",
        F.coalesce(F.col("base_grade") != F.col("target_grade"), F.lit(False)).alias("grade_changed"),
        X.score_drift_band(delta).alias("band"),
    )


def drift_flags(schema: DataFrame, distribution: DataFrame, scores: DataFrame) -> DataFrame:
    """Whether two versions differ (J7), one row.

    ``has_drift`` looks at the schema and the grade; ``banded_drift`` also counts any number, PSI or
    score that reaches a band above ``info``.
    """
    none = F.lit(False)
    flags = (
        schema.select(F.lit(True).alias("plain"), F.lit(True).alias("banded"))
        .unionByName(scores.select(F.col("grade_changed").alias("plain"), F.coalesce(F.col("band") != C.NO_DRIFT_BAND, none).alias("banded")))
        .unionByName(distribution.select(none.alias("plain"), F.coalesce(F.col("band") != C.NO_DRIFT_BAND, none).alias("banded")))
    )
    return flags.agg(
        F.coalesce(F.max("plain"), none).alias("has_drift"),
        F.coalesce(F.max(F.col("plain") | F.col("banded")), none).alias("banded_drift"),
    )


def any_entry(schema: DataFrame, distribution: DataFrame, scores: DataFrame) -> DataFrame:
    """The looser flag (J7): any schema, distribution or score entry at all."""
    one = F.lit(1).alias("one")
    scored = scores.where(F.col("base_score").isNotNull() | F.col("target_score").isNotNull())
    entries = schema.select(one).union(distribution.select(one)).union(scored.select(one))
    return entries.agg((F.count("one") > 0).alias("has_entry"))
