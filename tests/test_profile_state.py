import math
import random
from datetime import datetime

from pyspark.sql import functions as F

from rowassay.operators import value_counts as VC
from rowassay.operators.profile import profile
from rowassay.operators.profile_state import estimated_profile, merge_states, profile_state
from rowassay.plans.incremental import add_rows, grown_profile
from rowassay.sources.store import ResultStore
from workload.queries import QUERIES

EXACT = ("sample_size", "non_null_count", "null_count", "null_rate", "temporal", "physical_type", "logical_type")


def by_name(df):
    return {r.name: r for r in df.collect()}


def close(a, b):
    return (a is None and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def table(spark):
    # a mean of 1e9 with a spread of 1 shows whether squares lose digits; key 3 owns a third of the rows
    return spark.range(6000).selectExpr(
        "id",
        "1e9D + id % 7 AS far",
        "CASE WHEN id % 3 = 0 THEN 3 WHEN id % 11 <> 0 THEN CAST(id % 40 AS INT) END AS k",
        "CASE WHEN id % 4 = 0 THEN concat(repeat('x', 200), id % 8) ELSE concat('t', id % 5) END AS s",
        "CAST(id % 9 AS DECIMAL(20, 3)) AS d",
        "timestamp_seconds(id) AS t",
        "array(id % 6) AS l",
        "map('a', id) AS m",
        "id % 2 = 0 AS b",
    )


def test_merged_parts_are_the_whole(spark):
    df = table(spark)
    parts = [profile_state(df.where(F.col("id") % 5 < 1)), profile_state(df.where(F.col("id") % 5 >= 1)), profile_state(df.where("false"))]
    merged = by_name(estimated_profile(merge_states(parts[0].unionAll(parts[1]).unionAll(parts[2]))))
    once, exact = by_name(estimated_profile(profile_state(df))), by_name(profile(df))
    assert set(merged) == set(df.columns)
    for name, want in exact.items():
        got = merged[name]
        assert all(got[c] == want[c] == once[name][c] for c in EXACT), name
        for p in ("min", "max", "mean", "std", "sum"):
            assert close(got.numeric[p], want.numeric[p]), (name, p)
        assert all(close(got.string_length[p], want.string_length[p]) for p in ("min", "max", "mean"))
        assert abs(got.distinct_count - want.distinct_count) <= 0.05 * want.distinct_count, name
        if name not in ("id", "t"):  # few values: nothing has to be estimated
            assert sorted((v.value, v["count"]) for v in got.top_values) == sorted((v.value[:128], v["count"]) for v in want.top_values), name
    assert abs(merged["id"].numeric.median - 2999.5) < 0.01 * 6000


def test_empty_null_and_special_values(spark):
    nan, inf = float("nan"), float("inf")
    rows = by_name(estimated_profile(merge_states(profile_state(spark.createDataFrame([], "a int, b string, c double, d timestamp")))))
    for r in rows.values():
        assert (r.sample_size, r.null_rate, r.distinct_count, r.distinct_rate, r.top_values) == (0, 0.0, 0, 0.0, [])
        assert r.numeric.mean is None and r.numeric.median is None and r.temporal.min is None
    df = spark.createDataFrame([(1.0, None, ""), (nan, None, "a"), (3.0, None, "a"), (inf, None, None)], "a double, b int, c string")
    got, want = by_name(estimated_profile(profile_state(df))), by_name(profile(df))
    assert (got["a"].numeric.mean, got["a"].numeric.std, got["a"].numeric.max) == (None, None, None) and got["a"].numeric.min == 1.0
    assert got["b"].null_rate == 1.0 and got["b"].top_values == [] and got["b"].numeric.std is None
    assert [(v.value, v["count"]) for v in got["c"].top_values] == [(v.value, v["count"]) for v in want["c"].top_values]
    single = by_name(estimated_profile(profile_state(spark.createDataFrame([(5.0,)], "x double"))))["x"]
    assert (single.numeric.std, single.numeric.median, single.distinct_count) == (0.0, 5.0, 1)


def test_sketches_on_many_values(spark):
    rng = random.Random(3)
    df = spark.range(200_000, numPartitions=8).selectExpr("xxhash64(id) AS wide", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('v', id) END AS skewed")
    halves = [profile_state(df.where("wide % 2 = 0")), profile_state(df.where("wide % 2 <> 0"))]
    rng.shuffle(halves)
    got = by_name(estimated_profile(merge_states(halves[0].unionAll(halves[1]))))
    assert abs(got["wide"].distinct_count - 200_000) < 0.06 * 200_000
    top = got["skewed"].top_values[0]
    assert top.value == "hot" and abs(top["count"] - 66_667) < 200_000 / 1000
    below = df.where(F.col("wide") < got["wide"].numeric.median).count()
    assert abs(below - 100_000) < 0.02 * 200_000


def test_stored_states_grow(spark, tmp_path):
    store, df = ResultStore(spark, str(tmp_path / "store")), table(spark)
    for day in range(3):
        add_rows(store, "007", df.where(F.col("id") % 3 == day))
    add_rows(store, "other", df)
    got, want = by_name(grown_profile(store, "007")), by_name(estimated_profile(profile_state(df)))
    assert {n: (r.sample_size, r.null_count) for n, r in got.items()} == {n: (r.sample_size, r.null_count) for n, r in want.items()}
    assert close(got["far"].numeric.std, want["far"].numeric.std) and got["k"].top_values == want["k"].top_values


def test_grown_profile_query_counts_values_once(spark, tmp_path, monkeypatch):
    rows = [(k // 3, k % 50, k % 5, k % 7, float(k % 11), k / 4, 0.5, 0.25, "AR"[k % 2], "O", datetime(2024, 1, 1)) for k in range(600)]
    names = "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"
    spark.createDataFrame(rows, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    counted, plain = [], VC.family_counts
    monkeypatch.setattr(VC, "family_counts", lambda df, name, members: counted.append(name) or plain(df, name, members))
    found = {r.name: r for r in QUERIES["a8_profile_grown"](spark, str(tmp_path)).collect()}
    assert sorted(counted) == ["floating", "integral", "temporal", "text"]
    assert len(found) == 11 and all(r.distinct_near and r.median_near in (None, True) for r in found.values())
    assert found["l_extendedprice"].median_near and found["l_returnflag"].few_distinct == 2
