"""Hand-checked cases: detectors, scoring, drift, recommendations, previews."""

import pytest
from pyspark.sql import functions as F

from rowassay.functions import drift, scoring as X
from rowassay.operators import comparison, detectors, previews, recommendations as rec, scoring
from rowassay.operators.profile import profile

PROFILE = (
    "name string, logical_type string, sample_size bigint, non_null_count bigint, null_count bigint, null_rate double, distinct_count bigint, "
    "top_values array<struct<value:string,count:bigint,frequency:double>>, numeric struct<min:double,max:double,mean:double,median:double,std:double,sum:double>"
)


def column(spark, **values):
    base = dict(name="c", logical_type="integer", sample_size=10, null_count=0, distinct_count=1, top_values=[], numeric=(None,) * 6)
    base.update(values)
    base["non_null_count"] = base.get("non_null_count", base["sample_size"] - base["null_count"])
    base["null_rate"] = base["null_count"] / base["sample_size"] if base["sample_size"] else 0.0
    return spark.createDataFrame([tuple(base[p.split()[0]] for p in (
        "name", "logical_type", "sample_size", "non_null_count", "null_count", "null_rate", "distinct_count", "top_values", "numeric"))], PROFILE)


FINDING = "kind string, severity string, column_name string, metric string, value double, threshold double"


def findings(spark, *rows):
    return spark.createDataFrame([(k, s, c, "null_rate", float(v), float(t)) for k, s, c, v, t in rows], FINDING)


@pytest.mark.parametrize("nulls,size,expected", [(6, 10, [0.6]), (3, 10, []), (0, 0, [])])
def test_missingness(spark, nulls, size, expected):
    got = detectors.missingness_findings(column(spark, null_count=nulls, sample_size=size)).collect()
    assert [r.value for r in got] == expected


def test_missingness_severities(spark):
    def severity(nulls, threshold):
        return detectors.missingness_findings(column(spark, null_count=nulls), threshold).first().severity

    assert [severity(9, 0.5), severity(5, 0.5), severity(4, 0.3)] == ["critical", "high", "medium"]


@pytest.mark.parametrize("distinct,size,expected", [(95, 100, ["high"]), (85, 100, ["medium"]), (3, 100, []), (50, 50, ["info"])])
def test_cardinality(spark, distinct, size, expected):
    got = detectors.cardinality_findings(column(spark, sample_size=size, distinct_count=distinct)).collect()
    assert [r.severity for r in got] == expected


@pytest.mark.parametrize("rows,distinct,expected", [(10, 3, [("high", 0.7)]), (10, 10, []), (10, 7, [("medium", 0.3)]), (0, 0, []), (100, 94, [("low", 0.06)])])
def test_duplicates(spark, rows, distinct, expected):
    counts = spark.createDataFrame([(rows, distinct)], "row_count bigint, distinct_rows bigint")
    got = detectors.duplicate_findings(counts).collect()
    assert [(r.severity, round(r.value, 6)) for r in got] == expected and all(r.column_name is None for r in got)


def test_placeholders(spark):
    got = detectors.placeholder_findings(column(spark, top_values=[("ok", 4, 0.66), ("N/A", 2, 0.33)])).first()
    assert (got.value, got.severity) == (1.0, "medium") and "N/A" in got.details["sentinels"]


def test_skew(spark):
    got = detectors.skew_findings(column(spark, numeric=(0.0, 500.0, 100.0, 20.0, 30.0, 1.0))).first()
    assert (got.value, got.severity) == (1.6, "high")
    for numeric in ((0.0, 1.0, 0.5, 0.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 0.0, 1.0), (None, 1.0, 5.0, 1.0, 1.0, 1.0)):
        assert detectors.skew_findings(column(spark, numeric=numeric)).count() == 0


def test_detection_confidence(spark):
    cases = [(0.5, 0.5, 0.0), (1.0, 0.5, 1.0), (5.0, 0.5, 1.0), (0.1, 0.5, 0.0), (0.5, 0.0, 1.0)]
    df = spark.createDataFrame(cases, "v double, t double, want double")
    assert all(r.got == r.want for r in df.select("want", X.detection_confidence(F.col("v"), F.col("t")).alias("got")).collect())


def score_of(spark, columns, *rows):
    tables = spark.createDataFrame([("t", columns)], "dataset_id string, column_count bigint")
    found = findings(spark, *rows).withColumn("dataset_id", F.lit("t"))
    return scoring.quality_scores(tables, scoring.scored_findings(found), ["dataset_id"]).first()


def test_scores(spark):
    clean = score_of(spark, 5)
    assert (clean.score, clean.grade, clean.finding_count) == (100.0, "A", 0)
    bad = score_of(spark, 1, ("missingness", "critical", "c", 0.99, 0.5))
    assert (bad.score, bad.grade) == (2.44, "F")
    floor = score_of(spark, 1, *[("missingness", "critical", f"c{i}", 1.0, 0.5) for i in range(5)])
    assert floor.score == 0.0


def test_breakdown_totals_agree(spark):
    rows = (("missingness", "high", "a", 0.8, 0.5), ("invalid_values", "medium", "b", 2, 0), ("outlier", "low", None, 0.2, 0.1))
    scored = scoring.scored_findings(findings(spark, *rows))
    buckets = scoring.score_breakdown(scored).collect()
    sums = {axis: sum(b.penalty_total for b in buckets if b.axis == axis) for axis in ("kind", "severity", "column", "all")}
    assert all(abs(v - sums["all"]) < 1e-9 for v in sums.values())
    assert round(sums["all"], 3) == 0.904 and score_of(spark, 10, *rows).score == 90.96
    assert [b.finding_count for b in buckets if b.bucket == "<dataset>"] == [1]


def drift_profile(spark, **numeric):
    parts = tuple(numeric.get(k) for k in ("min", "max", "mean", "median", "std", "sum"))
    return column(spark, numeric=parts)


def test_numeric_drift(spark):
    rows = comparison.numeric_drift(drift_profile(spark, mean=10.0), drift_profile(spark, mean=30.0, median=14.0)).collect()
    got = {r.metric: r for r in rows}
    assert set(got) == {"mean", "median"}
    assert (got["mean"].absolute_change, got["mean"].relative_change) == (20.0, 2.0)
    assert (got["median"].base_value, got["median"].relative_change) == (None, None)


@pytest.mark.parametrize(
    "base,target,psi",
    [
        ({"a": 5, "b": 5}, {"a": 5, "b": 5}, 0.0),
        ({"US": 80, "CA": 20}, {"US": 20, "CA": 80}, 1.6636),
        ({"a": 10, "b": 5, "c": 1}, {"a": 10, "b": 5}, 1.1260),
        ({}, {"a": 1}, 0.0),
    ],
)
def test_psi(spark, base, target, psi):
    def side(counts):
        return column(spark, logical_type="string", top_values=[(k, v, 0.0) for k, v in counts.items()])

    assert round(comparison.short_list_drift(side(base), side(target)).first().psi, 4) == psi


def test_score_drift(spark):
    schema = "dataset_id string, score double, grade string"
    base = spark.createDataFrame([("a", 80.0, "B"), ("b", None, None)], schema)
    target = spark.createDataFrame([("a", 70.0, "C"), ("b", 75.0, "B")], schema)
    got = {r.dataset_id: r for r in comparison.score_drift(base, target, ["dataset_id"]).collect()}
    assert (got["a"].delta, got["a"].absolute_delta, got["a"].grade_changed, got["a"].band) == (-10.0, 10.0, True, "medium")
    assert (got["b"].delta, got["b"].grade_changed) == (None, False)


def test_schema_diff(spark):
    schema = "name string, physical_type string, logical_type string"
    base = spark.createDataFrame([("a", "bigint", "integer"), ("b", "int", "integer"), ("gone", "int", "integer")], schema)
    target = spark.createDataFrame([("a", "double", "float"), ("b", "int", "decimal"), ("new", "int", "integer")], schema)
    got = {r.name: r.change for r in comparison.schema_diff(base, target).collect()}
    assert got == {"a": "type_changed", "b": "type_changed", "gone": "removed", "new": "added"}
    assert comparison.schema_diff(base, base).count() == 0


def test_identical_versions_do_not_drift(spark):
    sides = [profile(spark.range(100).select(F.col("id").alias("a"), F.lit("x").alias("b"))) for _ in range(2)]
    rows = comparison.distribution_drift(*sides).collect()
    assert {r.band for r in rows} == {"info"} and all((r.psi or 0.0) == 0.0 for r in rows)


@pytest.mark.parametrize(
    "row,operation,priority",
    [
        (("missingness", "high", "c", 1.0, 0.5), "drop_column", 75),
        (("missingness", "medium", "c", 0.6, 0.5), "impute_missing", None),
        (("missingness", "low", "c", 0.51, 0.5), "review", None),
        (("outlier", "high", "c", 9.0, 3.0), "cap_outliers", None),
        (("outlier", "medium", "c", 9.0, 3.0), "review", None),
        (("duplicates", "low", None, 0.1, 0.05), "drop_duplicates", None),
        (("cardinality", "info", "c", 0.9, 0.8), "group_rare_categorical", None),
        (("invalid_values", "medium", "c", 1.0, 0.0), "cast_type", None),
        (("type_changed", "high", "c", 1.0, 0.5), "review", None),
    ],
)
def test_rules(spark, row, operation, priority):
    got = rec.recommend(findings(spark, row)).first()
    assert got.operation.kind == operation and got.operation.preview_only
    if priority is not None:
        assert (got.priority, got.confidence) == (priority, 1.0)
    if operation == "cap_outliers":
        assert float(got.operation.params["threshold"]) == 3.0


def test_keep_best(spark):
    rows = [("missingness", "high", f"c{i}", 0.6 + i / 10, 0.5) for i in range(5)]
    kept = rec.keep_best(rec.recommend(findings(spark, *rows)), 2).collect()
    assert sorted(r.affected_columns[0] for r in kept) == ["c3", "c4"]


def test_previews(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 100.0, None), (3, 100.0, None)], "id int, amount double, name string")
    op = previews.Operation
    rows = previews.preview_operations(
        df,
        [
            op("cap", "cap_outliers", "amount", threshold=50.0), op("gone", "drop_column", "nope"), op("drop", "drop_column", "name"),
            op("fill", "impute_missing", "name"), op("dup", "drop_duplicates"), op("rare", "group_rare_categorical", "name", min_count=3),
            op("cast", "cast_type", "name", target_type="int"), op("none", None), op("odd", "explode"), op("look", "review", "id"),
        ],
    ).collect()
    got = {r.operation_id: r for r in rows}
    assert got["cap"].affected_rows == 2
    assert (got["gone"].status, got["gone"].side_effect) == ("invalid", "column_not_found")
    assert got["drop"].detail == "id, amount"
    assert (got["fill"].affected_rows, got["dup"].affected_rows, got["dup"].resulting_rows) == (2, 1, 3)
    assert got["rare"].affected_rows == 4
    assert (got["cast"].status, got["cast"].affected_rows) == ("warning", 2)
    assert (got["none"].side_effect, got["odd"].side_effect, got["look"].status) == ("missing_operation", "unknown_operation_kind", "valid")


def test_preview_of_empty_table(spark):
    df = spark.createDataFrame([], "a int")
    got = previews.preview_operations(df, [previews.Operation("f", "impute_missing", "a")]).first()
    assert (got.status, got.affected_rows) == ("warning", None)


def test_relative_change_floor(spark):
    got = spark.range(1).select(drift.relative_change(F.lit(0.0), F.lit(0.5)).alias("a"), drift.relative_change(F.lit(None).cast("double"), F.lit(1.0)).alias("b")).first()
    assert (got.a, got.b) == (0.5, None)
