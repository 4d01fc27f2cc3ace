"""Every operator as a query over the given tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay import constants as C
from rowassay.functions import cleaning, drift, predicates, scoring as X
from rowassay.operators import comparison, context, detectors, events as ev, history, kpis, previews, recommendations as rec
from rowassay.operators import row_duplicates as dup, scoring
from rowassay.operators.column_stats import column_counts, length_stats, numeric_stats, one_pass_stats, temporal_stats
from rowassay.operators.heavy_values import heavy_values
from rowassay.operators.profile import bounded_sample, column_medians, column_order_statistics, profile, smallest_distinct
from rowassay.operators.value_counts import column_distinct, settled_families, top_values, value_counts
from rowassay.plans.analysis import assess, compare, run_steps
from rowassay.plans.incremental import add_rows, grown_profile
from rowassay.session import scratch_path, settle
from rowassay.sources import files, structure
from rowassay.sources.store import ResultStore, profile_from_json, profile_to_json
from rowassay.streaming.admission import admission_stream
from rowassay.streaming.summary import event_summary_stream
from workload import derived as D

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
KEY = ["dataset_id"]
DAY = 86_400.0


def query(name: str):
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def over(name: str, text: str):
    """Register a query over one derived input."""

    def register(function: Callable[[DataFrame], DataFrame]):
        @wraps(function)
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return function(D.derive(spark, folder, text))

        QUERIES[name] = run
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def clock(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- sources and sinks -------------------------------------------------------------------------


@query("s1_csv_scan")
def s1(spark, folder):
    path = scratch_path(spark, "csv")
    D.load(spark, folder, "orders").write.option("header", True).csv(path)
    rows = files.read_csv(spark, path)
    return rows.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", clock("o_orderdate").alias("o_orderdate"), "o_orderpriority")


@query("s2_parquet_scan")
def s2(spark, folder):
    rows = files.read_parquet(spark, f"{folder}/lineitem.parquet")
    return rows.where(F.col("l_quantity") >= 49).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("s3_bounded_sample")
def s3(spark, folder):
    out = None
    for table in ("lineitem", "nation"):
        sample, flag = bounded_sample(D.load(spark, folder, table), rows=1000)
        row = sample.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(table).alias("table_name"), "rows", F.lit(flag).alias("sampling"))
        out = row if out is None else out.unionByName(row)
    return out


@query("s4_table_structure")
def s4(spark, folder):
    frames = [structure.table_structure(D.load(spark, folder, t)).select(F.lit(t).alias("table_name"), "*") for t in ("orders", "lineitem", "embeddings")]
    return frames[0].unionByName(frames[1]).unionByName(frames[2]).drop("nullable")


@query("s5_logical_types")
def s5(spark, folder):
    frames = [structure.table_structure(D.load(spark, folder, t)).select(F.lit(t).alias("table_name"), "name", "logical_type", "row_count") for t in D.TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("s6_column_names")
def s6(spark, folder):
    path = scratch_path(spark, "header")
    rows = D.load(spark, folder, "orders")
    lines = rows.select(F.concat_ws(",", *[F.col(c).cast("string") for c in rows.columns[:4]]).alias("value"))
    header = rows.limit(1).select(F.lit(",".join(["o_orderkey", " ", "o_orderkey", "x" * 300])).alias("value"))
    header.union(lines).coalesce(1).write.text(path)
    return files.csv_header_violations(spark, path)


@query("s7_file_inventory")
def s7(spark, folder):
    rows = files.file_inventory(spark, folder, glob="*.parquet")
    return rows.select("file_name", "size_bytes", F.length("sha256").alias("hash_length"), F.coalesce("problem", F.lit("none")).alias("problem"))


@query("s8_register_version")
def s8(spark, folder):
    store = ResultStore(spark, scratch_path(spark, "store"))
    store.register(D.derive(spark, folder, D.BASE_ORDERS), "orders", "Orders", "by date", original_name="base.parquet")
    store.register(D.derive(spark, folder, D.TARGET_ORDERS), "orders", "Orders", original_name="target.parquet")
    intact = F.create_map(*[F.lit(x) for n in (1, 2) for x in (n, store.intact("orders", n))])
    number = F.col("version_number").cast("int")
    return store.read("dataset_versions", "orders").select(
        number.alias("version_number"), "row_count", "column_count", "original_name", F.length("sha256").alias("hash_chars"), (F.col("size_bytes") > 0).alias("measured"), intact[number].alias("intact")
    )


@query("s9_result_sink")
def s9(spark, folder):
    store = ResultStore(spark, scratch_path(spark, "store"))
    for flag in ("A", "N", "R"):
        rows = D.load(spark, folder, "lineitem").where(F.col("l_returnflag") == flag)
        store.append("profiles", column_counts(rows).withColumn("version_number", F.lit(1)), flag)
        store.append("profiles", column_counts(rows).withColumn("version_number", F.lit(2)), flag)
    return store.read("profiles").groupBy("dataset_id", "name").agg(F.count(F.lit(1)).alias("stored"), F.max("sample_size").alias("sample_size"))


@over("s10_stored_profile", D.DIRTY_EVENTS)
def s10(df):
    back = profile_from_json(profile_to_json(profile(df)))
    shown = back.select("name", "null_count", "distinct_count", F.col("numeric.mean").alias("mean"), F.size("top_values").alias("top_size"))
    return rounded(shown, "mean", digits=4)


# --- projections and predicates ----------------------------------------------------------------


@over("f1_select_by_key", D.FINDINGS)
def f1(df):
    return df.where(F.col("dataset_id") == 7).select("finding_id", "kind", "severity", F.round("value", 6).alias("value"))


@over("f2_text_search", D.FINDINGS)
def f2(df):
    hit = predicates.contains_text("15 COL_3", F.col("description"), F.col("column_name"))
    return df.where(hit).select("finding_id", "column_name", "description")


@over("f3_by_severity", D.FINDINGS)
def f3(df):
    return df.where(F.col("severity") == "critical").select("dataset_id", "finding_id", "kind")


@query("f4_finite_numbers")
def f4(spark, folder):
    rows = D.load(spark, folder, "lineitem")
    odd = F.when(F.col("l_quantity") == 1, F.lit(float("nan"))).when(F.col("l_quantity") == 2, F.lit(float("inf"))).when(
        F.col("l_quantity") == 3, F.lit(float("-inf"))
    ).otherwise(F.col("l_quantity"))
    clean = rows.select("l_linenumber", cleaning.finite(odd).alias("clean"))
    return clean.groupBy("l_linenumber").agg(F.count(F.lit(1)).alias("rows"), F.count("clean").alias("finite_rows"), F.round(F.sum("clean"), 4).alias("total"))


@query("f5_iso_time")
def f5(spark, folder):
    rows = D.load(spark, folder, "events")
    kind = rows.schema["ts"].dataType
    whole = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    return rows.select("event_id", cleaning.iso_utc(F.col("ts"), kind).alias("ts_iso"), cleaning.iso_utc(whole, kind).alias("second_iso"))


@query("f6_text_form")
def f6(spark, folder):
    rows = D.load(spark, folder, "documents").withColumn("raw", F.encode(F.col("text"), "UTF-8"))
    text = cleaning.text_form(F.col("raw"), rows.schema["raw"].dataType)
    return rows.select("doc_id", text.alias("text"), cleaning.text_form(F.col("n_chars"), rows.schema["n_chars"].dataType).alias("n_chars"))


@query("f7_identifier_names")
def f7(spark, folder):
    frames = [column_counts(D.load(spark, folder, t)).select(F.lit(t).alias("table_name"), "name", "non_null_count") for t in D.TABLES]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.where(predicates.is_identifier_name(F.col("name")))


@over("f8_column_display", D.LABELLED)
def f8(df):
    return kpis.column_display(profile(df.drop("text"), parts=("top",))).select("name", "min_shown", "max_shown", "examples", "is_identifier").where(
        ~F.col("name").isin("quality", "toxic", "n_chars")
    ).withColumns({c: F.regexp_replace(c, r"\.0$", "") for c in ("min_shown", "max_shown")})


# --- profiling ---------------------------------------------------------------------------------


@over("a1_null_counts", D.LABELLED)
def a1(df):
    return rounded(column_counts(df), "null_rate").select("ordinal_position", "name", "sample_size", "non_null_count", "null_count", "null_rate")


@over("a2_distinct_counts", D.LABELLED)
def a2(df):
    return rounded(column_distinct(df), "distinct_rate")


@query("a2_distinct_counts_lineitem")
def a2b(spark, folder):
    return rounded(column_distinct(D.load(spark, folder, "lineitem")), "distinct_rate")


@query("a3_numeric_stats")
def a3(spark, folder):
    df = D.load(spark, folder, "lineitem")
    stats = numeric_stats(df).join(column_medians(df), ["ordinal_position", "name"])
    return rounded(stats, "min", "max", "mean", "median", "std", "sum", digits=3)


@query("a3_order_statistics")
def a3b(spark, folder):
    """Exact values of whole numbers beyond a double's digits, and of 38-digit decimals."""
    rows = D.derive(spark, folder, D.WIDE_NUMBERS_ANY_SIZE)
    return column_order_statistics(rows, (0.0, 0.25, 0.5, 1.0)).select("name", "fraction", "lower", "upper")


@query("a4_temporal_range")
def a4(spark, folder):
    frames = [temporal_stats(D.load(spark, folder, t)).withColumn("table_name", F.lit(t)) for t in ("lineitem", "orders", "events")]
    rows = frames[0].unionByName(frames[1]).unionByName(frames[2])
    return rows.select("table_name", "name", clock("min").alias("first"), clock("max").alias("last"))


@query("a5_text_lengths")
def a5(spark, folder):
    return rounded(length_stats(D.load(spark, folder, "documents")), "mean")


@over("a6_value_counts", D.DIRTY_EVENTS)
def a6(df):
    return value_counts(df, ["user_id", "event_type", "note"])


@query("a7_top_values")
def a7(spark, folder):
    df = D.load(spark, folder, "lineitem")
    return rounded(top_values(df, ["l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"]), "frequency")


@query("a7_top_long_texts")
def a7b(spark, folder):
    return rounded(top_values(D.load(spark, folder, "documents"), ["text", "lang", "source"]), "frequency")


@query("a7_top_heavy")
def a7c(spark, folder):
    """All columns of lineitem; prices and rates as whole cents, as engines word doubles differently."""
    lines = D.derive(spark, folder, D.CENTS)
    return rounded(heavy_values(lines).drop("proven_by"), "frequency")


@query("a7_top_heavy_texts")
def a7d(spark, folder):
    return rounded(heavy_values(D.load(spark, folder, "documents")).drop("proven_by"), "frequency")


def flat_profile(rows: DataFrame) -> DataFrame:
    top = F.array_join(F.transform("top_values", lambda e: F.concat(e["value"], F.lit("="), e["count"].cast("string"))), "; ")
    return rows.select(
        "ordinal_position", "name", "physical_type", "logical_type", "sampling", "sample_size", "non_null_count", "null_count",
        F.round("null_rate", 6).alias("null_rate"), "distinct_count", F.round("distinct_rate", 6).alias("distinct_rate"),
        F.when(F.col("logical_type") != "float", top).alias("top_values"),
        *[F.round(f"numeric.{p}", 3).alias(f"numeric_{p}") for p in ("min", "max", "mean", "median", "std", "sum")],
        clock("temporal.min").alias("temporal_min"), clock("temporal.max").alias("temporal_max"),
        F.col("string_length.min").alias("length_min"), F.col("string_length.max").alias("length_max"),
        F.round("string_length.mean", 6).alias("length_mean"),
    )


@over("a8_profile", D.LABELLED)
def a8(df):
    return flat_profile(profile(df))


@query("a8_profile_lineitem")
def a8b(spark, folder):
    return flat_profile(profile(D.load(spark, folder, "lineitem")))


@query("a8_profile_nested")
def a8c(spark, folder):
    return flat_profile(profile(D.load(spark, folder, "embeddings")))


@query("a8_profile_approximate")
def a8d(spark, folder):
    return profile(D.load(spark, folder, "lineitem"), approximate=True).select("name", "sample_size", "null_count", F.round("numeric.mean", 4).alias("mean"))


@query("a8_profile_grown")
def a8e(spark, folder):
    """A table added in two parts: what its stored states merge to, with the estimates held against exact values."""
    df, store = D.load(spark, folder, "lineitem"), ResultStore(spark, scratch_path(spark, "grown"))
    for odd in (0, 1):
        add_rows(store, "lineitem", df.where(F.col("l_orderkey") % 2 == odd))
    counted = settled_families(df)
    around = column_order_statistics(df, (0.48, 0.52), counted=counted).groupBy("name").agg(F.min(F.col("lower").cast("double")).alias("low"), F.max(F.col("upper").cast("double")).alias("high"))
    exact = column_distinct(df, counted=counted).select(F.col("column").alias("name"), F.col("distinct_count").alias("known")).join(around, "name", "left")
    rows = grown_profile(store, "lineitem").join(F.broadcast(exact), "name")
    top = F.array_join(F.transform("top_values", lambda e: F.concat(e["value"], F.lit("="), e["count"].cast("string"))), "; ")
    few = F.col("known") <= 100
    return rows.select(
        "name", "sample_size", "null_count", *[F.round(f"numeric.{p}", 3).alias(f"numeric_{p}") for p in ("min", "max", "mean", "std")],
        clock("temporal.min").alias("temporal_min"), clock("temporal.max").alias("temporal_max"),
        F.when(few, F.col("distinct_count")).alias("few_distinct"),
        F.when(few & (F.col("logical_type") != "float"), top).alias("top_values"),
        (F.abs(F.col("distinct_count") - F.col("known")) <= 0.06 * F.col("known")).alias("distinct_near"),
        F.col("numeric.median").between(F.col("low"), F.col("high")).alias("median_near"),
    )


@query("a9_distinct_rows")
def a9(spark, folder):
    frames = []
    for label, text in (("flags", D.FLAGS), ("texts", D.TEXTS)):
        df = D.derive(spark, folder, text)
        exact = dup.row_duplicates(df).select(F.lit(label).alias("source"), F.lit("exact").alias("mode"), "row_count", "distinct_rows")
        guess = smallest_distinct(profile(df, parts=("distinct",))).select(F.lit(label).alias("source"), F.lit("column_min").alias("mode"), "row_count", "distinct_rows")
        frames += [exact, guess]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query("a10_duplicate_rows")
def a10(spark, folder):
    frames = [dup.row_duplicates(D.derive(spark, folder, t)).withColumn("source", F.lit(n)) for n, t in (("flags", D.FLAGS), ("texts", D.TEXTS), ("labelled", D.LABELLED))]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def sized(df: DataFrame) -> DataFrame:
    return df.groupBy("dataset_id").agg((F.count_distinct("column_name") + 3).alias("column_count"))


@over("a11_score_breakdown", D.FINDINGS)
def a11(df):
    return rounded(scoring.score_breakdown(scoring.scored_findings(df), sized(df), KEY), "penalty_total", "normalized_penalty")


@query("a12_quality_score")
def a12(spark, folder):
    findings = D.derive(spark, folder, D.FINDINGS)
    every = D.load(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"))
    sizes = every.join(sized(findings), "dataset_id", "left").select("dataset_id", F.coalesce("column_count", F.lit(5).cast("bigint")).alias("column_count"))
    return rounded(scoring.quality_scores(sizes, scoring.scored_findings(findings), KEY), "total_penalty", "normalized_penalty")


@over("a13_findings_per_kind", D.FINDINGS)
def a13(df):
    return scoring.findings_per_kind(df, KEY)


@over("a14_recommendation_counts", D.FINDINGS)
def a14(df):
    return rec.recommendation_counts(rec.recommend(df, KEY), KEY)


def indicator(name: str, measure, prepare):
    """A headline indicator over three inputs, each prepared only as far as the indicator needs."""

    def run(spark, folder):
        frames = [
            prepare(D.derive(spark, folder, text)).groupBy(F.lit(label).alias("source")).agg(measure().alias(name))
            for label, text in (("labelled", D.LABELLED), ("orders", D.BASE_ORDERS), ("flags", D.FLAGS))
        ]
        return rounded(frames[0].unionByName(frames[1]).unionByName(frames[2]), name)

    return run


QUERIES["a15_completeness"] = indicator("completeness", kpis.completeness, column_counts)
QUERIES["a16_uniqueness"] = indicator("uniqueness", kpis.uniqueness, column_distinct)
QUERIES["a17_validity"] = indicator("validity", kpis.validity, one_pass_stats)
QUERIES["a18_timeliness"] = indicator("timeliness", kpis.timeliness, one_pass_stats)


@query("a15_all_indicators")
def a15_all(spark, folder):
    rows = kpis.indicators(profile(D.load(spark, folder, "orders"), keys={"source": "orders"}), ["source"])
    return rounded(rows, "completeness", "uniqueness", "validity", "timeliness")


@over("a19_run_status", D.SCORES)
def a19(df):
    return history.run_status(df)


@over("a19_active_tables", D.CATALOGUE)
def a19b(df):
    return history.active_tables(df)


@over("a20_event_summary", D.USAGE)
def a20(df):
    totals = ev.event_totals(df, "value").select(F.lit("all").alias("axis"), F.lit("all").alias("bucket"), F.col("total").alias("event_count"), "average", "least", "greatest")
    return totals.unionByName(ev.event_counts(df, "event_type", "user_id"), allowMissingColumns=True)


# --- windows -----------------------------------------------------------------------------------


@over("w1_top_per_column", D.DIRTY_EVENTS)
def w1(df):
    return top_values(df, ["user_id", "event_type", "note"], limit=3).select("column", "rank", "value", "count")


@over("w2_latest_per_key", D.SCORES)
def w2(df):
    return history.latest_per_key(df, KEY, ["created_at", "run_number"]).select("dataset_id", "run_number", F.round("score", 6).alias("score"), "grade")


@over("w3_version_lineage", D.SCORES)
def w3(df):
    return history.lineage(df, "dataset_id", "run_number", ["grade"])


@over("w4_score_change", D.SCORES)
def w4(df):
    rows = history.score_changes(df, KEY, ["run_number"])
    return rows.select("dataset_id", "run_number", F.round("score_delta", 6).alias("score_delta"))


@over("w5_score_trend", D.SCORES)
def w5(df):
    return rounded(history.score_trend(df, KEY, ["created_at", "run_number"]), "trend")


@over("w6_newest_scores", D.SCORES)
def w6(df):
    return rounded(history.newest_scores(df, KEY, ["created_at", "run_number"], 7), "score").select("dataset_id", "point", "run_number", "score")


def with_micros(df: DataFrame) -> DataFrame:
    return df.withColumn("micros", F.unix_micros(F.col("ts").cast("timestamp")))


@over("w7_sliding_usage", D.USAGE)
def w7(df):
    used = ev.sliding_usage(with_micros(df), ["user_id", "event_type"], "micros", DAY)
    return used.select("event_id", "user_id", "event_type", "used")


# --- sorts and limits --------------------------------------------------------------------------


@over("t1_paged_listing", D.FINDINGS)
def t1(df):
    page = history.page_of(df, [F.desc("value"), F.desc("finding_id")], 3, 20)
    return page.select("finding_id", F.round("value", 6).alias("value"), "total_items", "total_pages")


@over("t2_top_findings", D.FINDINGS)
def t2(df):
    return history.top_findings(df).select("finding_id", "severity", "severity_rank", F.round("value", 6).alias("value"))


@over("t3_heaviest_columns", D.FINDINGS)
def t3(df):
    return rounded(history.heaviest_columns(scoring.score_breakdown(scoring.scored_findings(df))), "penalty_total").select("bucket", "penalty_total")


@over("t4_sorted_tables", D.CATALOGUE)
def t4(df):
    rows = history.sorted_tables(df, "rows", descending=False, search="build")
    return rows.select("dataset_id", "name", "row_count")


@over("t5_worst_scores", D.SCORES)
def t5(df):
    return rounded(history.worst_scores(df, KEY, ["created_at", "run_number"]), "score").select("dataset_id", "score", "grade")


@over("t6_best_recommendations", D.FINDINGS)
def t6(df):
    return rec.keep_best(rec.recommend(df, KEY), 5, KEY).select("dataset_id", "rank", "title", "priority")


# --- set operations ----------------------------------------------------------------------------


def found(df: DataFrame, keys=()) -> DataFrame:
    return rounded(df, "value").select(*keys, "kind", "severity", "column_name", "metric", "value", "threshold")


@over("u1_all_findings", D.LABELLED)
def u1(df):
    return found(detectors.run_detectors(profile(df), dup.row_duplicates(df)))


@over("u1_all_findings_dirty", D.DIRTY_EVENTS)
def u1b(df):
    return found(detectors.run_detectors(settle(profile(df), "profile"), threshold=0.3))


@query("u2_column_name_sets")
def u2(spark, folder):
    return comparison.column_names_diff(*stored_columns(spark, folder))


@query("u3_category_union")
def u3(spark, folder):
    rows = comparison.category_union(*[comparison.category_counts(categories(df)) for df in both_orders(spark, folder)])
    return rows.select(F.col("name").alias("column"), F.col("head").alias("value"), "base_count", "target_count")


@over("u4_aligned_series", D.SCORES)
def u4(df):
    day = F.date_format("created_at", "yyyy-MM-dd")
    points = df.groupBy(day.alias("x"), F.col("status").alias("series")).agg(F.max("score").alias("y"))
    return rounded(history.aligned_series(points, ["failed", "running", "succeeded"]), "failed", "running", "succeeded")


# --- joins and comparison ----------------------------------------------------------------------


def both_orders(spark, folder):
    return D.derive(spark, folder, D.BASE_ORDERS), D.derive(spark, folder, D.TARGET_ORDERS)


def categories(df: DataFrame) -> DataFrame:
    """Texts with few, many and very many values."""
    return df.select("o_orderpriority", F.col("o_custkey").cast("string").alias("o_custkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


def stored_columns(spark, folder):
    """The column rows of two registered versions of the orders."""
    store = ResultStore(spark, scratch_path(spark, "store"))
    for df in both_orders(spark, folder):
        store.register(df, "orders", "Orders")
    return store.columns("orders", 1), store.columns("orders", 2)


@query("j1_schema_diff")
def j1(spark, folder):
    return comparison.schema_diff(*stored_columns(spark, folder)).select(
        "name", "change", "base_logical_type", "target_logical_type"
    )


DRIFT_VALUES = ("base_value", "target_value", "absolute_change", "relative_change")


@query("j2_numeric_drift")
def j2(spark, folder):
    sides = [profile(df.select("o_orderkey", "o_totalprice"), parts=("median",)) for df in both_orders(spark, folder)]
    return rounded(comparison.numeric_drift(*sides), *DRIFT_VALUES, digits=4)


@query("j3_categorical_drift")
def j3(spark, folder):
    counts = [comparison.category_counts(categories(df)) for df in both_orders(spark, folder)]
    return rounded(comparison.population_stability(*counts), "psi").select(F.col("name").alias("column"), "psi")


@query("j4_distribution_drift")
def j4(spark, folder):
    frames = [df.withColumns({"o_custkey": F.col("o_custkey").cast("string"), "day": F.date_format("o_orderdate", "yyyy-MM-dd")}).select("o_totalprice", "o_orderpriority", "o_custkey", "day", "o_orderdate") for df in both_orders(spark, folder)]
    psi = comparison.population_stability(*map(comparison.category_counts, frames))
    rows = comparison.distribution_drift(*[profile(df, parts=("median",)) for df in frames], psi=psi)
    return rounded(rows, "relative_change", digits=4).withColumn("psi", F.round("psi", 6)).select("column", "metric", "relative_change", "psi", "band")


def two_scores(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first and the newest score of every table; the base side lacks some tables."""
    first = df.groupBy("dataset_id").agg(F.min_by(F.struct("score", "grade"), F.struct("created_at", "run_number")).alias("s"))
    base = first.where(F.col("s.grade") != "A").select("dataset_id", "s.*")
    return base, history.latest_per_key(df, KEY, ["created_at", "run_number"])


@over("j5_score_drift", D.SCORES)
def j5(df):
    rows = comparison.score_drift(*two_scores(df), KEY)
    return rounded(rows, "base_score", "target_score").select("dataset_id", "base_score", "target_score", "delta", "grade_changed", "band")


@query("j6_compare_versions")
def j6(spark, folder):
    parts = compare(*both_orders(spark, folder), "orders")
    flags = parts["flags"].select(F.lit("flag").alias("part"), F.lit("has_drift").alias("item"), F.col("has_drift").cast("string").alias("result"))
    schema = parts["schema"].select(F.lit("schema").alias("part"), F.col("name").alias("item"), F.col("change").alias("result"))
    drifts = parts["distribution"].select(F.lit("drift").alias("part"), F.concat("column", F.lit("."), "metric").alias("item"), F.col("band").alias("result"))
    return flags.unionByName(schema).unionByName(drifts)


@query("j7_drift_flags")
def j7(spark, folder):
    base, target = both_orders(spark, folder)
    schema = comparison.schema_diff(structure.table_columns(base), structure.table_columns(target))
    sides = [settle(profile(df.select("o_totalprice", "o_orderpriority"), parts=("top", "median")), "profile") for df in (base, target)]
    scores = comparison.score_drift(*two_scores(D.derive(spark, folder, D.SCORES)), KEY)
    psi = comparison.population_stability(*[comparison.category_counts(df, ["o_orderpriority"]) for df in (base, target)])
    drifts = comparison.distribution_drift(*sides, psi=psi)
    same = comparison.drift_flags(schema.where(F.lit(False)), drifts.where(F.lit(False)), scores.where(F.lit(False)))
    flags = comparison.drift_flags(schema, drifts, scores).withColumn("pair", F.lit("different"))
    return flags.unionByName(same.withColumn("pair", F.lit("same")))


@query("j8_latest_context")
def j8(spark, folder):
    scores = D.derive(spark, folder, D.SCORES)
    notes = scores.where(F.col("status") == "succeeded").withColumn("interpretation_id", F.concat(F.lit("n"), F.col("run_number").cast("string")))
    recs = rec.recommend(D.derive(spark, folder, D.FINDINGS), KEY).select("dataset_id", "title", "priority", F.col("supporting_findings")[0].alias("finding_id"))
    rows = history.with_latest_context(recs, scores, notes, KEY, ["created_at", "run_number"])
    return rounded(rows, "latest_score").select("finding_id", "dataset_id", "latest_score", "latest_grade", "latest_interpretation_id")


@query("j9_parent_children")
def j9(spark, folder):
    orders = D.load(spark, folder, "conversations").where(F.col("turn") == 0).select("conv_id", "role")
    turns = D.load(spark, folder, "conversations").select("conv_id", "turn", F.col("role").alias("turn_role"))
    rows = history.with_children(orders, turns, "conv_id", "turn")
    listed = F.array_join(F.transform("children", lambda e: F.concat(e["turn"].cast("string"), F.lit(":"), e["turn_role"])), ",")
    return rows.select("conv_id", "role", listed.alias("children"))


@query("j10_existing_keys")
def j10(spark, folder):
    wanted = D.load(spark, folder, "documents").select("doc_id")
    labels = D.load(spark, folder, "labels")
    known = history.known_keys(wanted, labels, "doc_id").withColumn("known", F.lit(True))
    return known.unionByName(history.missing_keys(wanted, labels, "doc_id").withColumn("known", F.lit(False)))


# --- detectors ---------------------------------------------------------------------------------


@over("d1_missingness", D.LABELLED)
def d1(df):
    return found(detectors.missingness_findings(column_counts(df)))


@over("d1_missingness_low_threshold", D.DIRTY_EVENTS)
def d1b(df):
    return found(detectors.missingness_findings(column_counts(df), threshold=0.15))


@query("d2_cardinality")
def d2(spark, folder):
    frames = [
        detectors.cardinality_findings(profile(D.load(spark, folder, t), keys={"table_name": t}, parts=("distinct",)), ["table_name"]) for t in ("orders", "events", "nation")
    ]
    return found(frames[0].unionByName(frames[1]).unionByName(frames[2]), ["table_name"])


@query("d3_duplicates")
def d3(spark, folder):
    frames = []
    for label, text in (("flags", D.FLAGS), ("texts", D.TEXTS), ("labelled", D.LABELLED)):
        counts = dup.row_duplicates(D.derive(spark, folder, text)).withColumn("source", F.lit(label))
        frames.append(detectors.duplicate_findings(counts, ["source"]))
    return found(frames[0].unionByName(frames[1]).unionByName(frames[2]), ["source"])


@over("d3_duplicates_column_min", D.DIRTY_EVENTS)
def d3b(df):
    return found(detectors.duplicate_findings(smallest_distinct(profile(df, parts=("distinct",)))))


@over("d4_placeholders", D.DIRTY_EVENTS)
def d4(df):
    return found(detectors.placeholder_findings(profile(df, parts=("top",))))


@over("d4_placeholder_rows", D.DIRTY_EVENTS)
def d4b(df):
    return detectors.placeholder_rows(df)


@query("d5_skew")
def d5(spark, folder):
    frames = [
        detectors.skew_findings(profile(df, keys={"source": n}, parts=("median",)), ["source"])
        for n, df in (
            ("events", D.derive(spark, folder, D.DIRTY_EVENTS)),
            ("documents", D.load(spark, folder, "documents").select("doc_id", "n_chars")),
            ("conversations", D.load(spark, folder, "conversations").select("conv_id", "turn")),
            ("labels", D.load(spark, folder, "labels")),
        )
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return found(out, ["source"])


@over("d6_descriptions", D.DIRTY_EVENTS)
def d6(df):
    return detectors.run_detectors(settle(profile(df), "profile"), threshold=0.3).select("kind", "column_name", "description")


# --- scalar functions --------------------------------------------------------------------------


def scalar(name: str, **columns):
    """An expression over every finding."""

    def run(spark, folder):
        df = D.derive(spark, folder, D.FINDINGS)
        return df.select("finding_id", *[c().alias(n) for n, c in columns.items()])

    QUERIES[name] = run


VALUE, LIMIT, KIND, SEVERITY = (lambda c=c: F.col(c) for c in ("value", "threshold", "kind", "severity"))
scalar("x1_clamp", clamped=lambda: F.round(X.clamp01(VALUE() * 2 - 1), 6))
scalar("x2_detection_confidence", confidence=lambda: F.round(X.detection_confidence(VALUE(), LIMIT()), 6))
scalar("x3_error_confidence", confidence=lambda: F.round(X.data_error_confidence(KIND(), VALUE() * 3), 6))
scalar("x4_penalty", penalty=lambda: F.round(X.penalty(KIND(), SEVERITY(), VALUE(), LIMIT()), 6))
scalar("x5_grade", grade=lambda: X.grade(F.bround(VALUE() * 50, 2)))
scalar("x6_health_word", word=lambda: X.health_word(F.bround(VALUE() * 50, 2)))
scalar(
    "x7_change",
    absolute_change=lambda: F.round(drift.absolute_change(LIMIT(), VALUE()), 6),
    relative_change=lambda: F.round(drift.relative_change(F.when(SEVERITY() != "info", LIMIT() * 10), VALUE()), 6),
)
scalar("x10_severity_rank", severity_rank=lambda: X.severity_rank(F.when(KIND() != "outlier", F.upper(SEVERITY()))))
scalar("x12_impact_label", label=lambda: X.impact_label(F.when(KIND() != "outlier", SEVERITY())))
scalar("x13_confidence_label", label=lambda: X.confidence_label(F.when(KIND() != "outlier", F.bround(VALUE() / 2, 4))))


@query("x8_psi_terms")
def x8(spark, folder):
    rows = D.load(spark, folder, "orders").groupBy("o_custkey").agg(
        F.count_if(F.col("o_orderdate") < "1998-01-01").alias("b"), F.count_if(F.col("o_orderdate") >= "1998-01-01").alias("t")
    )
    sums = rows.agg(F.sum("b").alias("base"), F.sum("t").alias("target"))
    base, target = sums.select("base").scalar(), sums.select("target").scalar()
    return rows.select("o_custkey", F.round(drift.psi_term(F.col("b"), base, F.col("t"), target), 8).alias("term"))


@over("x9_drift_bands", D.FINDINGS)
def x9(df):
    value = F.bround("value", 4)
    return df.select(
        "finding_id",
        drift.numeric_drift_band(value).alias("numeric_band"),
        drift.psi_drift_band(value / 4).alias("psi_band"),
        drift.score_drift_band(20 - value * 25).alias("score_band"),
    )


@query("x11_age_label")
def x11(spark, folder):
    now = F.to_timestamp_ntz(F.lit("2024-02-15 12:00:00"))
    fresh = F.to_timestamp_ntz(F.lit("2024-01-01 03:00:00"))
    return D.load(spark, folder, "events").select("event_id", X.age_label(F.col("ts"), now).alias("age"), X.age_label(F.col("ts"), fresh).alias("early_age"))


# --- recommendations ---------------------------------------------------------------------------


def rule(name: str, kind: str | None):
    def run(spark, folder):
        df = D.derive(spark, folder, D.FINDINGS)
        rows = rec.recommend(df if kind is None else df.where(F.col("kind") == kind))
        params = F.col("operation.params")
        return rows.select(
            F.col("supporting_findings")[0].alias("finding_id"), "kind", "title", F.col("operation.kind").alias("operation"),
            params["column"].alias("column_name"), F.coalesce(params["reason"], params["strategy"], params["scope"], params["min_count"]).alias("parameter"),
        )

    QUERIES[name] = run


rule("r1_missingness_actions", C.MISSINGNESS)
rule("r3_duplicate_actions", C.DUPLICATES)
rule("r4_placeholder_actions", C.INVALID_VALUES)
rule("r5_outlier_actions", C.OUTLIER)
rule("r6_cardinality_actions", C.CARDINALITY)


@over("r2_impute_strategy", D.FINDINGS)
def r2(df):
    return df.select("finding_id", rec.impute_strategy(F.col("metric")).alias("strategy"))


@over("r7_confidence_priority", D.FINDINGS)
def r7(df):
    return rec.confidence_and_priority(df).select("finding_id", "confidence", "priority")


@over("r8_recommendation_run", D.LABELLED)
def r8(df):
    rows = assess(df, "labelled")["recommendations"]
    return rows.select("rank", "kind", "severity", "title", "confidence", "priority", F.col("operation.kind").alias("operation"))


# --- previews ----------------------------------------------------------------------------------


def impact(name: str, text: str, *operations: previews.Operation):
    def run(spark, folder):
        return previews.preview_operations(D.derive(spark, folder, text), list(operations)).select(
            "operation_id", "operation_kind", "column", "status", "affected_rows", "resulting_rows", "side_effect", "detail"
        )

    QUERIES[name] = run


OP = previews.Operation
DROPS = (OP("v1a", "drop_column", "lang"), OP("v1b", "drop_column", "nothing"))
IMPUTES = (OP("v2a", "impute_missing", "quality"), OP("v2b", "impute_missing", "lang"))
DEDUPE = (OP("v3", "drop_duplicates"),)
CAPS = (OP("v4a", "cap_outliers", "n_chars", threshold=2000.0), OP("v4b", "cap_outliers", "quality", threshold=0.5))
CASTS = (OP("v5a", "cast_type", "source", target_type="bigint"), OP("v5b", "cast_type", "n_chars"))
RARE = (OP("v6a", "group_rare_categorical", "text"), OP("v6b", "group_rare_categorical", "n_chars", min_count=3), OP("v6c", "group_rare_categorical", "quality"))
OTHERS = (OP("v7a", "review", "text"), OP("v7b", None), OP("v7c", "rename_column", "text"))
impact("v1_drop_column", D.LABELLED, *DROPS)
impact("v2_impute_missing", D.LABELLED, *IMPUTES)
impact("v3_drop_duplicates", D.FLAGS, *DEDUPE)
impact("v4_cap_outliers", D.LABELLED, *CAPS)
impact("v5_cast_type", D.LABELLED, *CASTS)
impact("v6_group_rare", D.LABELLED, *RARE)
impact("v7_other_operations", D.LABELLED, *OTHERS)
impact("v8_batch_preview", D.LABELLED, *DROPS, *IMPUTES, *DEDUPE, *CAPS, *CASTS, *RARE, *OTHERS)


# --- context and steps -------------------------------------------------------------------------


@over("c1_finding_context", D.FINDINGS)
def c1(df):
    rows = context.finding_context(df, KEY)
    ids = F.array_join(F.transform("findings", lambda e: e["finding_id"]), ",")
    return rows.select("dataset_id", F.size("findings").alias("items"), ids.alias("finding_ids"))


@query("c2_context_text")
def c2(spark, folder):
    findings = D.derive(spark, folder, D.FINDINGS).withColumn("value", F.bround("value", 2).cast("decimal(9,2)"))
    scores = history.latest_per_key(D.derive(spark, folder, D.SCORES), KEY, ["created_at", "run_number"])
    named = D.load(spark, folder, "customer").select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("name"))
    scores = named.join(scores.select("dataset_id", F.bround("score", 1).cast("decimal(9,1)").alias("score"), "grade"), "dataset_id", "left")
    return context.context_text(findings, scores, KEY, "Findings of one table:")


@over("c3_hypotheses", D.FINDINGS)
def c3(df):
    return context.hypotheses(df, KEY)


@query("c4_analysis_steps")
def c4(spark, folder):
    store = ResultStore(spark, scratch_path(spark, "steps"))
    store.register(D.derive(spark, folder, D.BASE_ORDERS), "orders", "Orders")
    store.register(D.derive(spark, folder, D.TARGET_ORDERS), "orders", "Orders")
    for version in (1, 2):
        run_steps(store, "orders", ("profile", "detect", "score"), version)
    last = ("recommendations", "validations", "history", "unheard_of")
    run_steps(store, "orders", last, 2, {"base_version": 1, "target_version": 2})
    return store.read("runs", "orders").select("kind", "status", F.coalesce("error_code", F.lit("none")).alias("error_code"), F.col("result")["has_drift"].alias("has_drift"))


# --- streams -----------------------------------------------------------------------------------


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """All events as a stream that ends: one more event, days later, lets the watermark pass the last ones."""
    events = D.load(spark, folder, "events")
    end = scratch_path(spark, "end")
    later = (F.max("ts") + F.expr("INTERVAL 7 DAYS")).alias("ts")
    events.agg(later).select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in events.schema.fields]).write.parquet(end)
    rows = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1000).parquet(f"{folder}/events.parquet*")
    return rows.unionByName(spark.readStream.schema(events.schema).parquet(end)).withColumn("moment", F.col("ts").cast("timestamp"))


def finished(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Run a stream over all its input into a Parquet sink and read the sink."""
    base = scratch_path(spark, "stream")
    job = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state")
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


@query("e1_event_summary_stream")
def e1(spark, folder):
    rows = finished(event_summary_stream(event_stream(spark, folder), "moment", ["event_type"], "value"), spark)
    return rows.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "event_type", "total", "average", "least", "greatest")


ADMISSION = {"capacity": 2, "window_seconds": DAY}


@over("e2_admission_batch", D.USAGE)
def e2(df):
    rows = ev.admission(with_micros(df), ["user_id", "event_type"], "micros", "event_id", **ADMISSION)
    return rows.select("event_id", "user_id", "event_type", "allowed", "retry_after_seconds", "used")


@query("e2_admission_stream")
def e2b(spark, folder):
    rows = with_micros(event_stream(spark, folder)).select("event_id", "user_id", "event_type", "moment", "micros")
    return finished(admission_stream(rows, ["user_id", "event_type"], "moment", "micros", "event_id", **ADMISSION), spark).select(
        "event_id", "allowed", "retry_after_seconds", "used"
    )


# --- flagship ----------------------------------------------------------------------------------


@over("flagship_quality_score", D.LABELLED)
def flagship(df):
    return rounded(assess(df, "labelled")["scores"], "total_penalty", "normalized_penalty")
