"""Top lists from bucket bounds equal those from counting everything."""

import random

import pytest
from pyspark.sql import functions as F

from rowassay.operators.heavy_values import heavy_values
from rowassay.operators.value_counts import HEAD_CHARS, top_values

SHOWN = ["ordinal_position", "column", "rank", "value", "count", "frequency"]


def rows(df):
    return sorted(tuple(r) for r in df.select(*SHOWN).collect())


@pytest.fixture(scope="module")
def mixed(spark):
    """A hot value, a flat key, ties, NULLs, both zeros, NaN, decimals, dates, bytes, nested and an odd name."""
    base = spark.range(6000).withColumn("h", F.pmod(F.xxhash64("id"), F.lit(1000)))
    return base.selectExpr(
        "id AS flat",
        "CASE WHEN id % 3 = 0 THEN 7 WHEN h < 400 THEN h % 20 ELSE h END AS hot",
        "CASE WHEN id % 5 = 0 THEN 0D WHEN id % 5 = 1 THEN -0D WHEN id % 50 = 2 THEN double('nan') WHEN id % 50 = 3 THEN double('inf') ELSE id / 7 END AS real",
        "CAST(h % 30 AS DECIMAL(12, 2)) AS price",
        "date_add(DATE '2020-02-27', CAST(id % 11 AS INT)) AS day",
        "CASE WHEN id % 4 = 0 THEN concat('name ', h % 13) END AS `odd ``name`",
        "CAST(NULL AS STRING) AS nothing",
        "id % 2 = 0 AS flag",
        "array(id) AS nested",
        "map(1, id) AS pairs",
        "CAST(concat('x', h % 9) AS BINARY) AS bytes",
        "concat(repeat('long ', 40), h % 25) AS text",
    ).repartition(7)


@pytest.mark.parametrize(("buckets", "limit"), [(1, 10), (16, 1), (4096, 10)])
def test_equal_to_counting_everything(mixed, buckets, limit):
    assert rows(heavy_values(mixed, limit=limit, buckets=buckets)) == rows(top_values(mixed, limit=limit))


def test_skewed_column_is_proven_by_bounds(spark):
    df = spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN id % 20 ELSE id END AS skewed", "id AS flat")
    got = heavy_values(df, limit=5, buckets=512).collect()
    assert {(r["column"], r.proven_by) for r in got} == {("skewed", "bounds"), ("flat", "counts")}
    assert [r.value for r in sorted(got, key=lambda r: r["rank"]) if r["column"] == "flat"] == ["0", "1", "2", "3", "4"]


def test_value_just_outside_the_fullest_buckets(spark):
    """Many middling values fill the first buckets; the most frequent value sits alone in a thinner one."""
    bucket = F.pmod(F.xxhash64(F.col("id")), F.lit(8))
    pool = spark.range(4000).withColumn("b", bucket)
    crowd = pool.where("b < 4").selectExpr("id AS v", "explode(sequence(1, 2)) AS i")
    lone = pool.where("b = 7").orderBy("id").limit(1).selectExpr("id AS v", "explode(sequence(1, 500)) AS i")
    df = crowd.union(lone).select("v")
    assert rows(heavy_values(df, limit=1, buckets=8)) == rows(top_values(df, limit=1))
    assert heavy_values(df, limit=1, buckets=8).first()["count"] == 500


def test_long_texts_that_share_a_head(spark):
    head = "h" * HEAD_CHARS
    texts = [head + f"{i:03d}" for i in range(300)] + [head] + ["short"] * 2 + [head + "zz"] * 3 + ["", "", None]
    random.Random(3).shuffle(texts)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for buckets in (2, 64):
        got = heavy_values(df, limit=6, buckets=buckets).orderBy("rank").collect()
        assert [(r.value, r["count"]) for r in got] == [(head + "zz", 3), ("", 2), ("short", 2), (head, 1), (head + "000", 1), (head + "001", 1)]


def test_nothing_to_list(spark):
    assert heavy_values(spark.createDataFrame([], "a int, b string, c double")).collect() == []
    assert heavy_values(spark.createDataFrame([(None, [1])], "a int, b array<int>")).collect() == []
    assert heavy_values(spark.createDataFrame([([1],)], "b array<int>")).collect() == []
    with pytest.raises(ValueError):
        heavy_values(spark.range(3), limit=0)
