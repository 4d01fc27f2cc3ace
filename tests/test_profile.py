import math
import random
import statistics
import struct
from datetime import date, datetime
from decimal import Decimal, localcontext

import pytest
from pyspark.sql import functions as F, types as T

from rowassay.functions.logical_types import logical_type, physical_type
from rowassay.operators import medians as med
from rowassay.operators.profile import bounded_sample, column_medians, column_order_statistics, profile
from rowassay.operators.row_duplicates import row_duplicates
from rowassay.operators.value_counts import HEAD_CHARS, column_distinct, top_values, value_counts
from workload.queries import QUERIES


def by_name(df):
    return {r.name: r for r in df.collect()}


def test_people(spark):
    rows = by_name(profile(spark.createDataFrame([(1, "alice"), (2, "bob")], "id int, name string")))
    assert [rows["id"].sample_size, rows["id"].sampling, len(rows)] == [2, "full", 2]
    assert rows["name"].string_length.asDict() == {"min": 3, "max": 5, "mean": 4.0}
    assert rows["id"].numeric.median == 1.5


def test_empty_table(spark):
    rows = by_name(profile(spark.createDataFrame([], "a int, b string, c double, d timestamp")))
    for r in rows.values():
        assert (r.sample_size, r.null_rate, r.distinct_count, r.distinct_rate, r.top_values) == (0, 0.0, 0, 0.0, [])
        assert r.numeric.mean is None and r.temporal.min is None


def test_all_null_and_single_and_constant(spark):
    df = spark.createDataFrame([(None, 5.0, 7)], "a int, b double, c int")
    rows = by_name(profile(df))
    assert (rows["a"].null_rate, rows["a"].distinct_count, rows["a"].numeric.median) == (1.0, 0, None)
    assert (rows["b"].numeric.std, rows["b"].numeric.median) == (0.0, 5.0)
    constant = by_name(profile(spark.range(50).select(F.lit(3).alias("k"))))["k"]
    assert (constant.numeric.std, constant.distinct_count, constant.top_values[0].frequency) == (0.0, 1, 1.0)


def test_nan_and_infinity(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1.0, 1.0), (nan, 2.0), (3.0, inf)], "a double, b double")
    rows = by_name(profile(df))
    assert (rows["a"].numeric.min, rows["a"].numeric.max) == (1.0, 3.0)
    assert (rows["a"].numeric.mean, rows["a"].numeric.sum, rows["a"].numeric.std) == (None, None, None)
    assert rows["a"].distinct_count == 3 and [t.value for t in rows["a"].top_values] == ["1.0", "3.0"]
    assert rows["b"].numeric.max is None and rows["b"].numeric.median == 2.0


def test_types_and_text_forms(spark):
    df = spark.createDataFrame(
        [(True, Decimal("1.50"), date(2024, 1, 2), datetime(2024, 1, 2, 3), bytearray(b"\xffa"), [1, 2], {"k": 1}, 0.1)],
        "b boolean, d decimal(10,2), t date, s timestamp, y binary, l array<int>, m map<string,int>, f float",
    )
    rows = by_name(profile(df))
    shown = {n: [t.value for t in r.top_values] for n, r in rows.items()}
    assert shown["b"] == ["True"] and shown["d"] == ["1.50"] and shown["t"] == ["2024-01-02"] and shown["f"] == ["0.1"]
    assert shown["y"] == ["�a"] and shown["l"] == [] and rows["l"].distinct_count == 1
    assert rows["m"].logical_type == "unknown" and rows["m"].distinct_count == 0 and rows["m"].null_count == 0
    assert [logical_type(f.dataType) for f in df.schema] == ["boolean", "decimal", "date", "datetime", "binary", "list", "unknown", "float"]
    assert physical_type(df.schema["l"].dataType) == "list"
    assert rows["t"].temporal.min == datetime(2024, 1, 2) and rows["d"].numeric.mean == 1.5


def test_odd_column_names(spark):
    df = spark.createDataFrame([(1, "x")], ["it's `odd`", "a.b"])
    assert set(by_name(profile(df))) == {"it's `odd`", "a.b"}


def test_long_texts_that_share_head_and_count(spark):
    head = "h" * HEAD_CHARS
    texts = [head + f"{i:03d}" for i in range(40)] + [head] + ["short"] * 2 + [head + "zz"] * 3
    random.Random(1).shuffle(texts)
    rows = top_values(spark.createDataFrame([(t,) for t in texts], "t string"), limit=5).orderBy("rank").collect()
    assert [r.value for r in rows] == [head + "zz", "short", head, head + "000", head + "001"]
    assert [r["count"] for r in rows] == [3, 2, 1, 1, 1]


def test_value_counts_hot_value(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("v"))
    rows = {r.value: r["count"] for r in value_counts(df).collect()}
    assert rows["7"] == 1001 and len(rows) == 2000


SERIES = {
    "few": [3.0, 1.0],
    "ties": [1.0] * 10 + [2.0] * 10,
    "signs": [-5.0, -1.0, 0.0, 2.0, 1e300, -1e300, 1e-300],
    "close": [1.0 + i * 2.0**-50 for i in range(501)],
    "tiny": [5e-324, 1e-310, 0.0, -5e-324],
    "dense": [1_700_000_000_000_000.0 + i for i in range(2000)],
    "tail": [float(i) for i in range(99)] + [1e12] * 3,
}


@pytest.mark.parametrize("name", SERIES)
def test_medians_are_exact(spark, name):
    values = SERIES[name]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert column_medians(df).first().median == statistics.median(values)


def test_medians_random(spark):
    rng = random.Random(3)
    frame = [(rng.lognormvariate(0, 6), rng.randint(-(10**12), 10**12), rng.choice([1, 2, 2, 9])) for _ in range(3001)]
    got = {r.name: r.median for r in column_medians(spark.createDataFrame(frame, "a double, b bigint, c int")).collect()}
    for i, n in enumerate("abc"):
        assert got[n] == statistics.median([r[i] for r in frame])


def test_images_keep_the_order(spark):
    """The image of a double is its IEEE pattern, so it neither merges nor swaps values."""
    rng = random.Random(5)
    special = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf]
    special += [math.nextafter(2.0**k, up) for k in range(-1060, 1020, 13) for up in (0, math.inf)] + [2.0**k for k in range(-1074, 1024, 7)]
    values = special + [math.ldexp(rng.uniform(-1, 1), rng.randint(-1070, 1020)) for _ in range(5000)]
    rows = med.images("floating", spark.createDataFrame([(1, v, 1) for v in values], "position int, value double, n bigint")).select("number", "w0").collect()
    for r in rows:
        pattern = struct.unpack("<q", struct.pack("<d", abs(r.number)))[0]
        assert r.w0 == (-pattern if r.number < 0 else pattern)


def test_order_statistics_in_their_own_type(spark):
    rng = random.Random(6)
    micros = [1_700_000_000_000_000 + rng.randint(0, 10**9) for _ in range(701)]
    whole = [2**53 + 1, 2**53, -(2**63), 2**63 - 1, 0, None] + [rng.choice((2**53 + 1, -5, 7)) for _ in range(695)]
    cents = [Decimal(f"{rng.randint(-(10**36) + 1, 10**36 - 1)}.{rng.randint(0, 99):02}") for _ in range(695)]
    cents += [Decimal("0.01"), Decimal("-0.01"), Decimal("9" * 36 + ".99"), Decimal("-" + "9" * 36 + ".99"), Decimal(0), None]
    small = [Decimal(rng.randint(-999, 999)).scaleb(-2) for _ in range(701)]
    kinds = [T.StructField("m", T.LongType()), T.StructField("w", T.LongType()), T.StructField("c", T.DecimalType(38, 2)), T.StructField("s", T.DecimalType(5, 2)), T.StructField("t", T.StringType())]
    df = spark.createDataFrame(list(zip(micros, whole, cents, small, ["x"] * 701)), T.StructType(kinds))
    found = {(r.name, r.fraction): (r.lower, r.upper) for r in column_order_statistics(df, (0, 0.1, 0.5, 0.999, 1)).collect()}
    assert len(found) == 20
    for name, column in (("m", micros), ("w", whole), ("c", cents), ("s", small)):
        known = sorted(v for v in column if v is not None)
        for f in (0.0, 0.1, 0.5, 0.999, 1.0):
            at = f * (len(known) - 1)
            assert tuple(map(Decimal, found[name, f])) == tuple(Decimal(known[k]) for k in (math.floor(at), math.ceil(at))), (name, f)


def test_order_statistics_query_of_keys_beyond_64_bits(spark, tmp_path):
    rows = [(k * 7_919, k * 31, k * 1_003, k % 7 + 1) for k in range(-1, 40_000, 4_999)] + [(None, 1, 1, 1)]
    spark.createDataFrame(rows, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {(r.name, r.fraction): r.lower for r in QUERIES["a3_order_statistics"](spark, str(tmp_path)).collect()}
    spread = sorted(o * 4611686018427 - 9007199254740993 * s for o, _, s, n in rows if o is not None and n < 6)
    assert abs(spread[0]) > 2**63
    assert [int(found["spread_key", f]) for f in (0.0, 0.5, 1.0)] == [spread[math.floor(f * (len(spread) - 1))] for f in (0.0, 0.5, 1.0)]


def test_tables_without_numbers_or_rows(spark):
    texts = spark.createDataFrame([("a",), ("b",)], "t string")
    assert column_medians(texts).collect() == [] and column_order_statistics(texts).collect() == []
    assert column_medians(spark.createDataFrame([(None, 1)], "a bigint, b int").where("b > 1")).collect() == []


def test_nested_values_differ_by_a_microsecond(spark):
    rows = [(1, 2), (1, 3), (1, 2)]
    moment = "timestamp_micros(1700000000000000 + b)"
    df = spark.createDataFrame(rows, "x int, b int").selectExpr(f"array({moment}) AS a", f"named_struct('t', {moment}, 'u', array(named_struct('v', CAST(NULL AS STRING)))) AS s", f"map('k', {moment}) AS m")
    assert {r.column: r.distinct_count for r in column_distinct(df).collect()} == {"a": 2, "s": 2}
    found = row_duplicates(df).first()
    assert (found.row_count, found.distinct_rows, found.duplicate_members) == (3, 2, 2)
    parts = spark.sql("SELECT array('a', 'b') AS v UNION ALL SELECT array('a,b') UNION ALL SELECT array('a', NULL, 'b') UNION ALL SELECT array('a', '', 'b') UNION ALL SELECT NULL UNION ALL SELECT array()")
    assert column_distinct(parts).first().distinct_count == 5


def test_approximate_profile(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("a"), F.concat(F.lit("v"), F.col("id") % 3).alias("b"))
    rows = by_name(profile(df, approximate=True))
    assert rows["a"].distinct_count == 10 and rows["b"].distinct_count == 3
    assert [t["count"] for t in rows["b"].top_values] == [334, 333, 333]


def test_bounded_sample(spark):
    df = spark.range(500)
    assert [bounded_sample(df, 500)[1], bounded_sample(df, 499)[1]] == ["full", "sampled"]
    assert bounded_sample(df, 100)[0].count() == 100


def test_row_duplicates(spark):
    df = spark.createDataFrame([(1, None), (1, None), (None, 1), (2, "x"), (2, "x"), (2, "x")], "a int, b string")
    got = row_duplicates(df).first()
    assert (got.row_count, got.distinct_rows, got.duplicate_members, got.removable_rows) == (6, 3, 5, 3)
    narrow = row_duplicates(spark.createDataFrame([(0.0,), (-0.0,), (1.0,)], "a double")).first()
    assert narrow.removable_rows == 1
    shifted = spark.createDataFrame([("a", "bc"), ("ab", "c"), ("~", None), (None, "~")], "a string, b string")
    assert row_duplicates(shifted).first().distinct_rows == 4
    wide = spark.createDataFrame([(0.0, "x"), (-0.0, "x")], "a double, b string")
    assert row_duplicates(wide).first().removable_rows == 1
    empty = row_duplicates(df.limit(0)).first()
    assert (empty.row_count, empty.distinct_rows, empty.removable_rows) == (0, 0, 0)


def test_images_turn_back_into_values(spark):
    rng = random.Random(5)
    doubles = [0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.5, 0.1, math.inf, -math.inf, math.nan]
    doubles += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(2000)]
    rows = spark.createDataFrame([(1, v, 1) for v in doubles], "position int, value double, n bigint")
    back = med.values(med.images("floating", rows).withColumnRenamed("number", "given")).select("given", "number").collect()
    assert all(r.given == r.number or (math.isnan(r.given) and math.isnan(r.number)) for r in back) and len(back) == len(doubles)
    for scale in (0, 3, 20, 38):
        unscaled = [0, 1, -1, 10**13, -(10**26), 10**38 - 1, 1 - 10**38] + [rng.randrange(-(10**rng.randrange(1, 38)), 10**37) for _ in range(200)]
        with localcontext() as ctx:
            ctx.prec = 60
            decimals = [Decimal(u).scaleb(-scale) for u in unscaled]
        rows = spark.createDataFrame([(1, d, 1) for d in decimals], f"position int, value decimal(38,{scale}), n bigint")
        shown = sorted(r.text for r in med.values(med.images(f"decimal{scale}", rows)).select("text").collect())
        assert shown == sorted(r.s for r in rows.selectExpr("CAST(value AS STRING) AS s").collect()) and len(shown) == len(decimals)
