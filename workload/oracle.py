"""DuckDB SQL that answers the same questions, written independently of the Spark operators."""

from __future__ import annotations

from workload import derived as D

SQL: dict[str, str] = {}


def src(text: str) -> str:
    return "(" + D.duck(text).strip() + ")"


FINDINGS, SCORES, LABELLED, DIRTY, FLAGS, TEXTS, BASE, TARGET, CATALOGUE = (
    src(t) for t in (D.FINDINGS, D.SCORES, D.LABELLED, D.DIRTY_EVENTS, D.FLAGS, D.TEXTS, D.BASE_ORDERS, D.TARGET_ORDERS, D.CATALOGUE)
)

# Column lists of the profiled inputs: name and kind (i integer, I bigint, f float, s text, t timestamp, l list).
COLUMNS = {
    "labelled": "doc_id:I text:s lang:s source:s n_chars:I quality:i toxic:i",
    "dirty": "event_id:I user_id:I event_type:s rare_value:f heavy_value:f note:s",
    "lineitem": "l_orderkey:I l_partkey:I l_suppkey:I l_linenumber:i l_quantity:f l_extendedprice:f l_discount:f l_tax:f l_returnflag:s l_linestatus:s l_shipdate:t",
    "orders": "o_orderkey:I o_custkey:I o_orderstatus:s o_totalprice:f o_orderdate:t o_orderpriority:s",
    "target": "o_orderkey:I o_custkey:s o_totalprice:f o_orderdate:t o_orderpriority:s o_year:i",
    "events": "event_id:I ts:t user_id:I event_type:s value:f props:s",
    "embeddings": "vec_id:I embedding:l label:i",
    "flags": "l_returnflag:s l_linestatus:s",
    "texts": "text:s",
    "documents": "doc_id:I text:s lang:s source:s n_chars:I",
    "conversations": "conv_id:I turn:I role:s text:s",
    "nation": "n_nationkey:i n_name:s n_regionkey:i",
    "labels": "doc_id:I quality:i toxic:i",
    "customer": "c_custkey:I c_name:s c_nationkey:i c_acctbal:f c_mktsegment:s",
    "part": "p_partkey:I p_name:s p_brand:s p_type:s p_size:i p_retailprice:f",
    "supplier": "s_suppkey:I s_name:s s_nationkey:i s_acctbal:f",
    "region": "r_regionkey:i r_name:s",
    "pages": "page_id:I url:s html:s",
    "benchmark": "item_id:I text:s",
}
PHYSICAL = {"i": "int", "I": "bigint", "f": "double", "s": "string", "t": "timestamp_ntz", "l": "list"}
LOGICAL = {"i": "integer", "I": "integer", "f": "float", "s": "string", "t": "datetime", "l": "list"}


def columns(key: str, only=None) -> list[tuple[int, str, str]]:
    listed = [tuple(c.split(":")) for c in COLUMNS[key].split()]
    return [(i, n, k) for i, (n, k) in enumerate([x for x in listed if only is None or x[0] in only], start=1)]


def text_of(column: str, kind: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')" if kind == "t" else f"CAST({column} AS VARCHAR)"


def profile(source: str, key: str, only=None) -> str:
    """One SELECT per column, glued together: the profile in flat form, unrounded."""
    parts = []
    for i, c, k in columns(key, only):
        num, tim, txt = k in "iIf", k == "t", k == "s"
        none = "CAST(NULL AS DOUBLE)"
        stats = {
            "min": f"CAST(min({c}) AS DOUBLE)", "max": f"CAST(max({c}) AS DOUBLE)", "mean": f"avg({c})", "median": f"median({c})",
            "std": f"CASE WHEN count({c}) = 1 THEN 0.0 ELSE stddev_samp({c}) END", "sum": f"CAST(sum({c}) AS DOUBLE)",
        }
        shown = text_of("v", k)
        top = (
            "NULL" if k in "lf"
            else f"(SELECT string_agg(concat({shown}, '=', n), '; ' ORDER BY n DESC, v) FROM "
            f"(SELECT {c} AS v, count(*) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY n DESC, v LIMIT 10))"
        )
        if k == "l":
            top = "NULL" if only is not None else "''"
        hits = (
            f"(SELECT count(*) FROM (SELECT {c} AS v FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) "
            f"WHERE lower(v) IN ('', 'n/a', 'na', 'null', 'none', 'undefined', '-'))" if txt else "0"
        )
        parts.append(
            f"SELECT CAST({i} AS INTEGER) AS ordinal_position, '{c}' AS name, '{PHYSICAL[k]}' AS physical_type, '{LOGICAL[k]}' AS logical_type, "
            f"count(*) AS sample_size, count({c}) AS non_null_count, count(*) - count({c}) AS null_count, "
            f"CASE WHEN count(*) > 0 THEN (count(*) - count({c})) / count(*) ELSE 0.0 END AS null_rate, "
            f"count(DISTINCT {c}) AS distinct_count, CASE WHEN count({c}) > 0 THEN count(DISTINCT {c}) / count({c}) ELSE 0.0 END AS distinct_rate, "
            f"{top} AS top_values, {hits} AS placeholder_hits, "
            + ", ".join(f"{e if num else none} AS numeric_{n}" for n, e in stats.items())
            + f", {f'min({c})' if tim else 'CAST(NULL AS TIMESTAMP)'} AS temporal_min, {f'max({c})' if tim else 'CAST(NULL AS TIMESTAMP)'} AS temporal_max, "
            + f"{f'CAST(min(length({c})) AS INTEGER)' if txt else 'CAST(NULL AS INTEGER)'} AS length_min, "
            + f"{f'CAST(max(length({c})) AS INTEGER)' if txt else 'CAST(NULL AS INTEGER)'} AS length_max, {f'avg(length({c}))' if txt else none} AS length_mean "
            + f"FROM {source}"
        )
    return "(" + " UNION ALL ".join(parts) + ")"


def clock(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f')"


def flat_profile(source: str, key: str) -> str:
    rounded = ", ".join(f"round(numeric_{p}, 3) AS numeric_{p}" for p in ("min", "max", "mean", "median", "std", "sum"))
    return (
        "SELECT ordinal_position, name, physical_type, logical_type, 'full' AS sampling, sample_size, non_null_count, null_count, "
        "round(null_rate, 6) AS null_rate, distinct_count, round(distinct_rate, 6) AS distinct_rate, top_values, "
        f"{rounded}, {clock('temporal_min')} AS temporal_min, {clock('temporal_max')} AS temporal_max, length_min, length_max, "
        f"round(length_mean, 6) AS length_mean FROM {profile(source, key)}"
    )


def distinct_rows(source: str) -> str:
    return f"(SELECT count(*) AS row_count, (SELECT count(*) FROM (SELECT DISTINCT * FROM {source})) AS distinct_rows FROM {source})"


def smallest_distinct(source: str, key: str) -> str:
    return f"(SELECT max(sample_size) AS row_count, min(distinct_count) AS distinct_rows FROM {profile(source, key)})"


# --- findings ---

PERCENT = "printf('%.1f%%', round_even({} * 100, 1))"


def missingness(prof: str, threshold: float) -> str:
    return (
        f"SELECT 'missingness' AS kind, CASE WHEN null_rate >= 0.9 THEN 'critical' WHEN null_rate >= {max(threshold, 0.5)} THEN 'high' ELSE 'medium' END AS severity, "
        f"name AS column_name, 'null_rate' AS metric, null_rate AS value, CAST({threshold} AS DOUBLE) AS threshold, "
        f"printf('Column ''%s'' has %d null values (%s) which is above the threshold (%s).', name, null_count, {PERCENT.format('null_rate')}, {PERCENT.format(f'CAST({threshold} AS DOUBLE)')}) AS description "
        f"FROM {prof} WHERE sample_size > 0 AND null_rate >= {threshold}"
    )


def cardinality(prof: str) -> str:
    share = "distinct_count / non_null_count"
    return (
        f"SELECT 'cardinality' AS kind, CASE WHEN sample_size < 100 THEN 'info' WHEN {share} >= 0.95 THEN 'high' ELSE 'medium' END AS severity, "
        f"name AS column_name, 'distinct_rate' AS metric, {share} AS value, CAST(0.8 AS DOUBLE) AS threshold, "
        f"printf('Column ''%s'' has %d distinct values across %d non-null rows (%s); it may be a primary key or free-form text.', name, distinct_count, non_null_count, {PERCENT.format(share)}) AS description "
        f"FROM {prof} WHERE non_null_count > 0 AND {share} >= 0.8"
    )


def placeholders(prof: str) -> str:
    return (
        "SELECT 'invalid_values' AS kind, 'medium' AS severity, name AS column_name, 'placeholder_top_value_count' AS metric, "
        "CAST(placeholder_hits AS DOUBLE) AS value, CAST(0 AS DOUBLE) AS threshold, "
        "printf('Column ''%s'' contains placeholder values (e.g. ''N/A'', ''null'') in its top entries.', name) AS description "
        f"FROM {prof} WHERE placeholder_hits > 0"
    )


def skew(prof: str) -> str:
    value = "abs(numeric_mean - numeric_median) / (abs(numeric_median) + abs(numeric_std))"
    return (
        f"SELECT 'outlier' AS kind, CASE WHEN {value} >= 0.5 THEN 'high' ELSE 'medium' END AS severity, name AS column_name, "
        f"'mean_median_skew' AS metric, {value} AS value, CAST(0.1 AS DOUBLE) AS threshold, "
        f"printf('Numeric column ''%s'' shows a large mean-vs-median skew (%.2f), which often indicates outliers.', name, round_even({value}, 2)) AS description "
        f"FROM {prof} WHERE numeric_std <> 0 AND abs(numeric_median) >= 1e-9 AND {value} >= 0.1"
    )


def duplicates(counts: str) -> str:
    share = "(row_count - distinct_rows) / row_count"
    return (
        f"SELECT 'duplicates' AS kind, CASE WHEN {share} >= 0.5 THEN 'high' WHEN {share} >= 0.2 THEN 'medium' ELSE 'low' END AS severity, "
        f"CAST(NULL AS VARCHAR) AS column_name, 'duplicate_rate' AS metric, {share} AS value, CAST(0.05 AS DOUBLE) AS threshold, "
        f"printf('Approximately %d of %d rows (%s) are exact duplicates in the sampled frame.', row_count - distinct_rows, row_count, {PERCENT.format(share)}) AS description "
        f"FROM {counts} WHERE row_count > 0 AND distinct_rows > 0 AND {share} >= 0.05"
    )


def all_findings(source: str, key: str, threshold: float, counts: str) -> str:
    prof = profile(source, key)
    parts = (missingness("p", threshold), cardinality("p"), placeholders("p"), skew("p"), duplicates(counts))
    return f"(WITH p AS {prof} " + " UNION ALL ".join(parts) + ")"


FOUND = "kind, severity, column_name, metric, round(value, 6) AS value, threshold"


def listed(finding_sql: str, extra: str = "") -> str:
    return f"SELECT {extra}{FOUND} FROM ({finding_sql})"


# --- scoring ---


def clamp(x: str) -> str:
    return f"least(1.0e0, greatest(0.0e0, {x}))"


def detection(value="value", threshold="threshold") -> str:
    limit = f"greatest({threshold}, 1e-9)"
    return clamp(f"({value} - {limit}) / {limit}")


def error(kind="kind", value="value") -> str:
    return (
        f"CASE {kind} WHEN 'missingness' THEN {clamp(f'0.55e0 + 0.45e0 * ({value})')} "
        f"WHEN 'invalid_values' THEN 0.75e0 + 0.25e0 * {clamp(f'({value}) / 5')} WHEN 'outlier' THEN 0.5e0 + 0.3e0 * {clamp(value)} "
        f"WHEN 'duplicates' THEN 0.5e0 + 0.25e0 * {clamp(value)} WHEN 'cardinality' THEN 0.4e0 + 0.2e0 * {clamp(value)} ELSE 0.5e0 END"
    )


WEIGHT = "CASE severity WHEN 'critical' THEN 1.0e0 WHEN 'high' THEN 0.75e0 WHEN 'medium' THEN 0.45e0 WHEN 'low' THEN 0.2e0 WHEN 'info' THEN 0.05e0 ELSE 0.0e0 END"
PENALTY = f"{WEIGHT} * {detection()} * {error()}"


def grade(x: str) -> str:
    return f"CASE WHEN {x} >= 90 THEN 'A' WHEN {x} >= 75 THEN 'B' WHEN {x} >= 60 THEN 'C' WHEN {x} >= 40 THEN 'D' ELSE 'F' END"


SCORED = f"(SELECT *, {PENALTY} AS penalty FROM {FINDINGS})"
SIZED = f"(SELECT dataset_id, count(DISTINCT column_name) + 3 AS column_count FROM {FINDINGS} GROUP BY dataset_id)"
RANK = "CASE lower(severity) WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 WHEN 'info' THEN 1 ELSE 0 END"

# --- sources and sinks ---

SQL["s1_csv_scan"] = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, {clock('o_orderdate')} AS o_orderdate, o_orderpriority FROM orders"
SQL["s2_parquet_scan"] = "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem WHERE l_quantity >= 49"
SQL["s3_bounded_sample"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, least(count(*), 1000) AS rows, CASE WHEN count(*) > 1000 THEN 'sampled' ELSE 'full' END AS sampling FROM {t}" for t in ("lineitem", "nation")
)
SQL["s4_table_structure"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({i} AS INTEGER) AS ordinal_position, '{c}' AS name, '{PHYSICAL[k]}' AS physical_type, '{LOGICAL[k]}' AS logical_type, (SELECT count(*) FROM {t}) AS row_count"
    for t in ("orders", "lineitem", "embeddings") for i, c, k in columns(t)
)
SQL["s5_logical_types"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, '{LOGICAL[k]}' AS logical_type, (SELECT count(*) FROM {t}) AS row_count" for t in D.TABLES for _, c, k in columns(t)
)
SQL["s6_column_names"] = (
    "SELECT * FROM (VALUES ('blank_column_name', CAST(1 AS INTEGER), ' '), ('column_name_too_long', 3, repeat('x', 300)), "
    "('duplicate_column_names', 0, 'o_orderkey'), ('duplicate_column_names', 2, 'o_orderkey')) v(rule, position, name) WHERE (SELECT count(*) FROM orders) > 0"
)
SQL["s8_register_version"] = (
    "SELECT *, CAST(64 AS INTEGER) AS hash_chars, true AS measured, true AS intact FROM ("
    f"SELECT CAST(1 AS INTEGER) AS version_number, count(*) AS row_count, CAST(6 AS INTEGER) AS column_count, 'base.parquet' AS original_name FROM {BASE} "
    f"UNION ALL SELECT CAST(2 AS INTEGER), count(*), CAST(6 AS INTEGER), 'target.parquet' FROM {TARGET})"
)
SQL["s9_result_sink"] = " UNION ALL ".join(
    f"SELECT '{f}' AS dataset_id, '{c}' AS name, CAST(2 AS BIGINT) AS stored, (SELECT count(*) FROM lineitem WHERE l_returnflag = '{f}') AS sample_size"
    for f in ("A", "N", "R") for _, c, _k in columns("lineitem")
)
SQL["s10_stored_profile"] = (
    f"SELECT name, null_count, distinct_count, round(numeric_mean, 4) AS mean, CAST(least(distinct_count, 10) AS INTEGER) AS top_size FROM {profile(DIRTY, 'dirty')}"
)

# --- projections and predicates ---

SQL["f1_select_by_key"] = f"SELECT finding_id, kind, severity, round(value, 6) AS value FROM {FINDINGS} WHERE dataset_id = 7"
SQL["f2_text_search"] = (
    f"SELECT finding_id, column_name, description FROM {FINDINGS} WHERE contains(lower(concat(description, ' ', coalesce(column_name, ''))), lower('15 COL_3'))"
)
SQL["f3_by_severity"] = f"SELECT dataset_id, finding_id, kind FROM {FINDINGS} WHERE severity = 'critical'"
SQL["f4_finite_numbers"] = (
    "SELECT l_linenumber, count(*) AS rows, count(*) FILTER (l_quantity NOT IN (1, 2, 3)) AS finite_rows, "
    "round(sum(l_quantity) FILTER (l_quantity NOT IN (1, 2, 3)), 4) AS total FROM lineitem GROUP BY l_linenumber"
)
SQL["f5_iso_time"] = (
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END || '+00:00' AS ts_iso, "
    "strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS second_iso FROM events"
)
SQL["f6_text_form"] = "SELECT doc_id, text, CAST(n_chars AS VARCHAR) AS n_chars FROM documents"
SQL["f7_identifier_names"] = (
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS name, count({c}) AS non_null_count FROM {t}" for t in D.TABLES for _, c, _k in columns(t))
    + ") WHERE lower(name) = 'id' OR lower(name) LIKE '%\\_id' ESCAPE '\\'"
)
SQL["f8_column_display"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, {f'(SELECT CAST(min({c}) AS VARCHAR) FROM documents)' if k == 'I' else 'CAST(NULL AS VARCHAR)'} AS min_shown, "
    f"{f'(SELECT CAST(max({c}) AS VARCHAR) FROM documents)' if k == 'I' else 'CAST(NULL AS VARCHAR)'} AS max_shown, "
    f"(SELECT string_agg(CAST(v AS VARCHAR), ', ' ORDER BY n DESC, v) FROM (SELECT {c} AS v, count(*) AS n FROM documents GROUP BY {c} ORDER BY n DESC, v LIMIT 3)) AS examples, "
    f"{'true' if c == 'doc_id' else 'false'} AS is_identifier"
    for _, c, k in columns("documents", ("doc_id", "lang", "source"))
)

# --- profiling ---

SQL["a1_null_counts"] = f"SELECT ordinal_position, name, sample_size, non_null_count, null_count, round(null_rate, 6) AS null_rate FROM {profile(LABELLED, 'labelled')}"
for _name, _source, _key in (("a2_distinct_counts", LABELLED, "labelled"), ("a2_distinct_counts_lineitem", "lineitem", "lineitem")):
    SQL[_name] = (
        f'SELECT ordinal_position, name AS "column", distinct_count, round(distinct_rate, 6) AS distinct_rate FROM {profile(_source, _key)}'
    )
SQL["a3_numeric_stats"] = (
    "SELECT ordinal_position, name, " + ", ".join(f'round(numeric_{p}, 3) AS "{p}"' for p in ("min", "max", "mean", "median", "std", "sum"))
    + f" FROM {profile('lineitem', 'lineitem')} WHERE logical_type IN ('integer', 'float')"
)
SQL["a3_order_statistics"] = " UNION ALL ".join(
    f"SELECT '{c}' AS name, CAST({f} AS DOUBLE) AS fraction, CAST(v[CAST(floor({f} * (len(v) - 1)) AS BIGINT) + 1] AS VARCHAR) AS lower, "
    f"CAST(v[CAST(ceil({f} * (len(v) - 1)) AS BIGINT) + 1] AS VARCHAR) AS upper FROM (SELECT list({c} ORDER BY {c}) FILTER ({c} IS NOT NULL) AS v FROM {src(D.WIDE_NUMBERS)})"
    for c in ("odd_key", "line", "spread_key", "amount") for f in (0, 0.25, 0.5, 1)
)
SQL["a4_temporal_range"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS name, {clock(f'min({c})')} AS first, {clock(f'max({c})')} AS last FROM {t}"
    for t, c in (("lineitem", "l_shipdate"), ("orders", "o_orderdate"), ("events", "ts"))
)
SQL["a5_text_lengths"] = (
    f'SELECT ordinal_position, name, length_min AS "min", length_max AS "max", round(length_mean, 6) AS mean FROM {profile("documents", "documents")} WHERE logical_type = \'string\''
)
SQL["a6_value_counts"] = " UNION ALL ".join(
    f'SELECT CAST({i} AS INTEGER) AS ordinal_position, \'{c}\' AS "column", CAST({c} AS VARCHAR) AS value, count(*) AS count FROM {DIRTY} WHERE {c} IS NOT NULL GROUP BY {c}'
    for i, c, _k in columns("dirty") if c in ("user_id", "event_type", "note")
)


def top(source: str, key: str, wanted, limit: int = 10, positions: bool = True) -> str:
    frequency = f", round(n / total, 6) AS frequency" if positions else ""
    return " UNION ALL ".join(
        f"SELECT {f'CAST({i} AS INTEGER) AS ordinal_position, ' if positions else ''}'{c}' AS \"column\", CAST(row_number() OVER (ORDER BY n DESC, v) AS INTEGER) AS rank, "
        f"{text_of('v', k)} AS value, n AS count{frequency} FROM "
        f"(SELECT v, n, total FROM (SELECT {c} AS v, count(*) AS n, sum(count(*)) OVER () AS total FROM {source} WHERE {c} IS NOT NULL GROUP BY {c}) ORDER BY n DESC, v LIMIT {limit})"
        for i, c, k in columns(key) if c in wanted
    )


SQL["a7_top_values"] = top("lineitem", "lineitem", ("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate"))
SQL["a7_top_long_texts"] = top("documents", "documents", ("text", "lang", "source"))
SQL["a7_top_heavy"] = top(src(D.CENTS), "lineitem", [c for _, c, _ in columns("lineitem")])
SQL["a7_top_heavy_texts"] = top("documents", "documents", [c for _, c, _ in columns("documents")])
SQL["a8_profile"] = flat_profile(LABELLED, "labelled")
SQL["a8_profile_lineitem"] = flat_profile("lineitem", "lineitem")
SQL["a8_profile_nested"] = flat_profile("embeddings", "embeddings")
SQL["a8_profile_approximate"] = (
    f"SELECT name, sample_size, null_count, round(numeric_mean, 4) AS mean FROM {profile('lineitem', 'lineitem')}"
)
SQL["a8_profile_grown"] = (
    "SELECT name, sample_size, null_count, " + ", ".join(f"round(numeric_{p}, 3) AS numeric_{p}" for p in ("min", "max", "mean", "std"))
    + f", {clock('temporal_min')} AS temporal_min, {clock('temporal_max')} AS temporal_max, CASE WHEN distinct_count <= 100 THEN distinct_count END AS few_distinct, "
    "CASE WHEN distinct_count <= 100 THEN top_values END AS top_values, distinct_count >= 0 AS distinct_near, "
    f"CASE WHEN numeric_median IS NOT NULL THEN true END AS median_near FROM {profile('lineitem', 'lineitem')}"
)
SQL["a9_distinct_rows"] = " UNION ALL ".join(
    f"SELECT '{n}' AS source, '{m}' AS mode, row_count, distinct_rows FROM {f}"
    for n, s in (("flags", FLAGS), ("texts", TEXTS)) for m, f in (("exact", distinct_rows(s)), ("column_min", smallest_distinct(s, n)))
)
SQL["a10_duplicate_rows"] = " UNION ALL ".join(
    f"SELECT '{n}' AS source, CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_rows, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS duplicate_members, "
    f"CAST(sum(n - 1) AS BIGINT) AS removable_rows FROM (SELECT count(*) AS n FROM {s} GROUP BY {g})"
    for n, s, g in (("flags", FLAGS, "l_returnflag, l_linestatus"), ("texts", TEXTS, "text"), ("labelled", LABELLED, "doc_id, text, lang, source, n_chars, quality, toxic"))
)
_axes = (("kind", "kind"), ("severity", "severity"), ("column", "coalesce(column_name, '<dataset>')"), ("all", "'all'"))
SQL["a11_score_breakdown"] = " UNION ALL ".join(
    f"SELECT s.dataset_id, '{a}' AS axis, {e} AS bucket, count(*) AS finding_count, round(sum(penalty), 6) AS penalty_total, "
    f"round(least(1.0e0, sum(penalty) / any_value(column_count)), 6) AS normalized_penalty FROM {SCORED} s JOIN {SIZED} z ON s.dataset_id = z.dataset_id GROUP BY s.dataset_id, bucket"
    for a, e in _axes
)
SQL["a12_quality_score"] = (
    f"SELECT *, {grade('score')} AS grade FROM (SELECT dataset_id, column_count, finding_count, round(total, 6) AS total_penalty, round(least(1.0e0, total / column_count), 6) AS normalized_penalty, "
    "round_even(100.0e0 * (1.0e0 - least(1.0e0, total / column_count)), 2) AS score FROM ("
    f"SELECT c_custkey AS dataset_id, coalesce(column_count, 5) AS column_count, coalesce(n, 0) AS finding_count, coalesce(total, 0.0e0) AS total FROM customer "
    f"LEFT JOIN {SIZED} z ON c_custkey = z.dataset_id LEFT JOIN (SELECT dataset_id, count(*) AS n, sum(penalty) AS total FROM {SCORED} GROUP BY dataset_id) p ON c_custkey = p.dataset_id))"
)
SQL["a13_findings_per_kind"] = f"SELECT dataset_id, kind, count(*) AS finding_count FROM {FINDINGS} GROUP BY dataset_id, kind"
REC_KIND = (
    "CASE kind WHEN 'missingness' THEN 'missingness_treatment' WHEN 'duplicates' THEN 'duplicate_removal' WHEN 'invalid_values' THEN 'data_quality_fix' "
    "WHEN 'outlier' THEN 'outlier_treatment' WHEN 'cardinality' THEN 'cardinality_reduction' ELSE 'pipeline_review' END"
)
SQL["a14_recommendation_counts"] = (
    f"SELECT dataset_id, 'kind' AS axis, {REC_KIND} AS bucket, count(*) AS recommendation_count FROM {FINDINGS} GROUP BY dataset_id, {REC_KIND} "
    f"UNION ALL SELECT dataset_id, 'severity', severity, count(*) FROM {FINDINGS} GROUP BY dataset_id, severity"
)
_KPI = {
    "a15_completeness": ("completeness", "sum(non_null_count) / sum(sample_size)"),
    "a16_uniqueness": ("uniqueness", "avg(distinct_rate)"),
    "a17_validity": (
        "validity",
        "coalesce(1 - 0.01e0 * avg(CASE WHEN numeric_std = 0 THEN 0 ELSE least(abs(numeric_mean / numeric_std), 1) END) FILTER (logical_type IN ('integer', 'float')), 0.99)",
    ),
    "a18_timeliness": (
        "timeliness",
        "coalesce(avg(greatest(least((epoch(temporal_max) - epoch(temporal_min)) / 86400 / 1800, 1), 0)) FILTER (temporal_min IS NOT NULL), 0.986)",
    ),
}
for _name, (_alias, _expr) in _KPI.items():
    SQL[_name] = " UNION ALL ".join(
        f"SELECT '{n}' AS source, round({_expr}, 6) AS {_alias} FROM {profile(s, n)}" for n, s in (("labelled", LABELLED), ("orders", BASE), ("flags", FLAGS))
    )
SQL["a15_all_indicators"] = "SELECT 'orders' AS source, " + ", ".join(f"round({e}, 6) AS {a}" for a, e in _KPI.values()) + f" FROM {profile('orders', 'orders')}"
SQL["a19_run_status"] = f"SELECT status, count(*) AS run_count FROM {SCORES} GROUP BY status"
SQL["a19_active_tables"] = f"SELECT count(*) AS table_count, count(current_version) AS active_count FROM {CATALOGUE}"
SQL["a20_event_summary"] = (
    "SELECT 'all' AS axis, 'all' AS bucket, count(*) AS event_count, round_even(avg(value), 3) AS average, round_even(min(value), 3) AS least, round_even(max(value), 3) AS greatest FROM events "
    "UNION ALL SELECT 'event_type', event_type, count(*), NULL, NULL, NULL FROM events GROUP BY event_type "
    "UNION ALL SELECT 'user_id', CAST(user_id AS VARCHAR), count(*), NULL, NULL, NULL FROM events GROUP BY user_id"
)

# --- windows ---

SQL["w1_top_per_column"] = top(DIRTY, "dirty", ("user_id", "event_type", "note"), 3, positions=False)
NEWEST = f"(SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY created_at DESC, run_number DESC) AS back FROM {SCORES})"
SQL["w2_latest_per_key"] = f"SELECT dataset_id, run_number, round(score, 6) AS score, grade FROM {NEWEST} WHERE back = 1"
SQL["w3_version_lineage"] = (
    "SELECT * FROM (SELECT dataset_id, run_number AS from_run_number, grade AS from_grade, lead(run_number) OVER w AS to_run_number, lead(grade) OVER w AS to_grade "
    f"FROM {SCORES} WINDOW w AS (PARTITION BY dataset_id ORDER BY run_number)) WHERE to_run_number IS NOT NULL"
)
SQL["w4_score_change"] = (
    f"SELECT dataset_id, run_number, round(coalesce(score - lag(score) OVER (PARTITION BY dataset_id ORDER BY run_number), 0), 6) AS score_delta FROM {SCORES}"
)
SQL["w5_score_trend"] = (
    f"SELECT dataset_id, round(arg_min(score, back) - arg_max(score, back), 6) AS trend, count(*) AS runs FROM {NEWEST} WHERE back <= 24 GROUP BY dataset_id"
)
SQL["w6_newest_scores"] = (
    f"SELECT dataset_id, CAST(count(*) OVER (PARTITION BY dataset_id) - back + 1 AS INTEGER) AS point, run_number, round(score, 6) AS score FROM {NEWEST} WHERE back <= 7"
)
SQL["w7_sliding_usage"] = (
    "SELECT event_id, user_id, event_type, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS used FROM events"
)

# --- sorts and limits ---

SQL["t1_paged_listing"] = (
    f"SELECT finding_id, round(value, 6) AS value, (SELECT count(*) FROM orders) AS total_items, CAST(ceil((SELECT count(*) FROM orders) / 20) AS BIGINT) AS total_pages "
    f"FROM {FINDINGS} o ORDER BY o.value DESC, finding_id DESC LIMIT 20 OFFSET 40"
)
SQL["t2_top_findings"] = (
    f"SELECT finding_id, severity, severity_rank, round(v, 6) AS value FROM (SELECT finding_id, severity, {RANK} AS severity_rank, value AS v, column_name, kind FROM {FINDINGS}) "
    "ORDER BY severity_rank DESC, v DESC, column_name, kind LIMIT 5"
)
SQL["t3_heaviest_columns"] = (
    f"SELECT bucket, round(total, 6) AS penalty_total FROM (SELECT coalesce(column_name, '<dataset>') AS bucket, sum(penalty) AS total FROM {SCORED} GROUP BY 1) ORDER BY total DESC, bucket LIMIT 8"
)
SQL["t4_sorted_tables"] = (
    f"SELECT dataset_id, name, row_count FROM {CATALOGUE} WHERE contains(lower(concat(name, coalesce(description, ''))), 'build') ORDER BY coalesce(row_count, -1), dataset_id"
)
SQL["t5_worst_scores"] = f"SELECT dataset_id, round(score, 6) AS score, grade FROM {NEWEST} WHERE back = 1"
RAW_CONFIDENCE = f"{detection()} * {error()}"
PRIORITY_WEIGHT = "CASE severity WHEN 'critical' THEN 100 WHEN 'high' THEN 75 WHEN 'medium' THEN 45 WHEN 'low' THEN 20 ELSE 5 END"
PRIORITY = f"CAST(round_even({PRIORITY_WEIGHT} * {clamp(RAW_CONFIDENCE)}, 0) AS INTEGER)"
DROP = "kind = 'missingness' AND (severity IN ('critical', 'high') OR value >= 0.8)"
SHOWN = "coalesce(column_name, '<dataset>')"
TITLE = (
    f"CASE WHEN {DROP} THEN printf('Drop sparse column ''%s''', {SHOWN}) WHEN kind = 'missingness' AND severity = 'medium' THEN printf('Impute missing values in ''%s''', {SHOWN}) "
    f"WHEN kind = 'missingness' THEN printf('Review null rate for ''%s''', {SHOWN}) WHEN kind = 'duplicates' THEN 'Drop exact duplicate rows' "
    f"WHEN kind = 'invalid_values' THEN printf('Cast or normalize column ''%s''', {SHOWN}) WHEN kind = 'outlier' AND severity IN ('critical', 'high') THEN printf('Cap outliers in ''%s''', {SHOWN}) "
    f"WHEN kind = 'outlier' THEN printf('Review outliers in ''%s''', {SHOWN}) WHEN kind = 'cardinality' THEN printf('Group rare categories in ''%s''', {SHOWN}) ELSE 'Review unsupported finding' END"
)
OPERATION = (
    f"CASE WHEN {DROP} THEN 'drop_column' WHEN kind = 'missingness' AND severity = 'medium' THEN 'impute_missing' WHEN kind = 'duplicates' THEN 'drop_duplicates' "
    "WHEN kind = 'invalid_values' THEN 'cast_type' WHEN kind = 'outlier' AND severity IN ('critical', 'high') THEN 'cap_outliers' WHEN kind = 'cardinality' THEN 'group_rare_categorical' ELSE 'review' END"
)
STRATEGY = "CASE WHEN metric IN ('mean', 'median', 'std', 'min', 'max', 'sum') THEN 'mean' ELSE 'mode' END"
SQL["t6_best_recommendations"] = (
    f"SELECT dataset_id, rank, title, priority FROM (SELECT *, CAST(row_number() OVER (PARTITION BY dataset_id ORDER BY priority DESC, title, shown) AS INTEGER) AS rank FROM "
    f"(SELECT dataset_id, {TITLE} AS title, {PRIORITY} AS priority, {SHOWN} AS shown FROM {FINDINGS})) WHERE rank <= 5"
)

# --- set operations ---

SQL["u1_all_findings"] = listed(all_findings(LABELLED, "labelled", 0.5, distinct_rows(LABELLED)))
SQL["u1_all_findings_dirty"] = listed(all_findings(DIRTY, "dirty", 0.3, smallest_distinct(DIRTY, "dirty")))
_names = {n: "(" + " UNION ALL ".join(f"SELECT '{c}' AS name, '{LOGICAL[k]}' AS logical_type" for _, c, k in columns(n)) + ")" for n in ("orders", "target")}
SQL["u2_column_name_sets"] = (
    f"SELECT coalesce(b.name, t.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN t.name IS NULL THEN 'removed' ELSE 'common' END AS membership "
    f"FROM {_names['orders']} b FULL JOIN {_names['target']} t ON b.name = t.name"
)
CATEGORIES = {"o_orderpriority": "o_orderpriority", "o_custkey": "CAST(o_custkey AS VARCHAR)", "day": "strftime(o_orderdate, '%Y-%m-%d')"}
SQL["u3_category_union"] = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", v AS value, CAST(sum(b) AS BIGINT) AS base_count, CAST(sum(t) AS BIGINT) AS target_count FROM "
    f"(SELECT {c} AS v, 1 AS b, 0 AS t FROM {BASE} UNION ALL SELECT {c}, 0, 1 FROM {TARGET}) GROUP BY v"
    for n, c in CATEGORIES.items()
)
SQL["u4_aligned_series"] = (
    "SELECT strftime(created_at, '%Y-%m-%d') AS x, " + ", ".join(f"round(max(score) FILTER (status = '{s}'), 6) AS {s}" for s in ("failed", "running", "succeeded"))
    + f" FROM {SCORES} GROUP BY 1"
)

# --- joins and comparison ---

SQL["j1_schema_diff"] = (
    "SELECT coalesce(b.name, t.name) AS name, CASE WHEN b.name IS NULL THEN 'added' WHEN t.name IS NULL THEN 'removed' ELSE 'type_changed' END AS change, "
    "b.logical_type AS base_logical_type, t.logical_type AS target_logical_type "
    f"FROM {_names['orders']} b FULL JOIN {_names['target']} t ON b.name = t.name WHERE b.name IS NULL OR t.name IS NULL OR b.logical_type <> t.logical_type"
)


def numeric_drift(base: str, base_key: str, target: str, target_key: str, only) -> str:
    rows = " UNION ALL ".join(
        f"SELECT b.name AS \"column\", '{m}' AS metric, b.numeric_{m} AS base_value, t.numeric_{m} AS target_value FROM b JOIN t ON b.name = t.name" for m in ("mean", "median", "std", "min", "max")
    )
    return (
        f"(WITH b AS {profile(base, base_key, only)}, t AS {profile(target, target_key, only)} SELECT *, target_value - base_value AS absolute_change, "
        f"abs(target_value - base_value) / greatest(abs(base_value), 1) AS relative_change FROM ({rows}) WHERE base_value IS NOT NULL OR target_value IS NOT NULL)"
    )


def psi(base: str, target: str, column: str) -> str:
    def counts(s: str) -> str:
        return f"(SELECT v, n, sum(n) OVER () AS total FROM (SELECT {column} AS v, count(*) AS n FROM {s} WHERE {column} IS NOT NULL GROUP BY 1))"

    return (
        "(SELECT sum((tp - bp) * ln(tp / bp)) AS psi FROM (SELECT greatest(coalesce(b.n, 0) / (SELECT max(total) FROM "
        f"{counts(base)}), 1e-9) AS bp, greatest(coalesce(t.n, 0) / (SELECT max(total) FROM {counts(target)}), 1e-9) AS tp "
        f"FROM {counts(base)} b FULL JOIN {counts(target)} t ON b.v = t.v))"
    )


def band(x: str, bands) -> str:
    return "CASE " + " ".join(f"WHEN {x} >= {b} THEN '{l}'" for b, l in bands) + f" WHEN {x} IS NOT NULL THEN 'info' END"


NUMERIC_BANDS, PSI_BANDS, SCORE_BANDS = ((0.5, "high"), (0.2, "medium")), ((0.2, "medium"), (0.1, "low")), ((20, "high"), (10, "medium"), (5, "low"))
SQL["j2_numeric_drift"] = 'SELECT "column", metric, ' + ", ".join(
    f"round({c}, 4) AS {c}" for c in ("base_value", "target_value", "absolute_change", "relative_change")
) + f" FROM {numeric_drift(BASE, 'orders', TARGET, 'target', ('o_orderkey', 'o_totalprice'))}"
PSI = {n: psi(BASE, TARGET, c) for n, c in CATEGORIES.items()}
SQL["j3_categorical_drift"] = " UNION ALL ".join(f"SELECT '{n}' AS \"column\", round(psi, 6) AS psi FROM {p}" for n, p in PSI.items())


def drifts(numbers: str, names) -> str:
    return (
        f"SELECT \"column\", metric, round(relative_change, 4) AS relative_change, CAST(NULL AS DOUBLE) AS psi, {band('relative_change', NUMERIC_BANDS)} AS band FROM {numbers}"
        + "".join(f" UNION ALL SELECT '{n}', 'psi', NULL, round(psi, 6), {band('psi', PSI_BANDS)} FROM {PSI[n]}" for n in names)
    )


SQL["j4_distribution_drift"] = drifts(numeric_drift(BASE, "orders", TARGET, "target", ("o_totalprice",)), CATEGORIES)
_first = f"(SELECT dataset_id, arg_min(score, (created_at, run_number)) AS score, arg_min(grade, (created_at, run_number)) AS grade FROM {SCORES} GROUP BY dataset_id)"
SCORE_DRIFT = (
    "(SELECT coalesce(b.dataset_id, t.dataset_id) AS dataset_id, b.score AS base_score, t.score AS target_score, round_even(t.score - b.score, 4) AS delta, "
    f"coalesce(b.grade <> t.grade, false) AS grade_changed FROM (SELECT * FROM {_first} WHERE grade <> 'A') b FULL JOIN (SELECT * FROM {NEWEST} WHERE back = 1) t ON b.dataset_id = t.dataset_id)"
)
SQL["j5_score_drift"] = (
    f"SELECT dataset_id, round(base_score, 6) AS base_score, round(target_score, 6) AS target_score, delta, grade_changed, {band('abs(delta)', SCORE_BANDS)} AS band FROM {SCORE_DRIFT}"
)
SQL["j6_compare_versions"] = (
    "SELECT 'flag' AS part, 'has_drift' AS item, 'true' AS result UNION ALL SELECT 'schema', name, change FROM (" + SQL["j1_schema_diff"]
    + ") UNION ALL SELECT 'drift', concat(\"column\", '.', metric), band FROM ("
    + drifts(numeric_drift(BASE, "orders", TARGET, "target", ("o_orderkey", "o_totalprice", "o_custkey")), ["o_orderpriority"])
    + ")"
)
SQL["j7_drift_flags"] = "SELECT 'different' AS pair, true AS has_drift, true AS banded_drift UNION ALL SELECT 'same', false, false FROM (SELECT count(*) FROM orders)"
SQL["j8_latest_context"] = (
    f"SELECT f.finding_id, f.dataset_id, round(s.score, 6) AS latest_score, s.grade AS latest_grade, 'n' || n.run AS latest_interpretation_id FROM {FINDINGS} f "
    f"LEFT JOIN (SELECT * FROM {NEWEST} WHERE back = 1) s ON f.dataset_id = s.dataset_id "
    f"LEFT JOIN (SELECT dataset_id, arg_max(run_number, (created_at, run_number)) AS run FROM {SCORES} WHERE status = 'succeeded' GROUP BY dataset_id) n ON f.dataset_id = n.dataset_id"
)
SQL["j9_parent_children"] = (
    "SELECT p.conv_id, p.role, c.children FROM (SELECT conv_id, role FROM conversations WHERE turn = 0) p LEFT JOIN "
    "(SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn) AS children FROM conversations GROUP BY conv_id) c ON p.conv_id = c.conv_id"
)
SQL["j10_existing_keys"] = "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents"

# --- detectors ---

SQL["d1_missingness"] = listed(missingness(profile(LABELLED, "labelled"), 0.5))
SQL["d1_missingness_low_threshold"] = listed(missingness(profile(DIRTY, "dirty"), 0.15))
SQL["d2_cardinality"] = " UNION ALL ".join(listed(cardinality(profile(t, t)), f"'{t}' AS table_name, ") for t in ("orders", "events", "nation"))
SQL["d3_duplicates"] = " UNION ALL ".join(
    listed(duplicates(distinct_rows(s)), f"'{n}' AS source, ") for n, s in (("flags", FLAGS), ("texts", TEXTS), ("labelled", LABELLED))
)
SQL["d3_duplicates_column_min"] = listed(duplicates(smallest_distinct(DIRTY, "dirty")))
SQL["d4_placeholders"] = listed(placeholders(profile(DIRTY, "dirty")))
SQL["d4_placeholder_rows"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS INTEGER) AS ordinal_position, '{c}' AS name, count(DISTINCT {c}) AS spellings, count(*) AS rows FROM {DIRTY} "
    f"WHERE lower({c}) IN ('', 'n/a', 'na', 'null', 'none', 'undefined', '-') HAVING count(*) > 0"
    for i, c, k in columns("dirty") if k == "s"
)
SQL["d5_skew"] = " UNION ALL ".join(
    listed(skew(profile(s, k, only)), f"'{n}' AS source, ")
    for n, s, k, only in (
        ("events", DIRTY, "dirty", None), ("documents", "documents", "documents", ("doc_id", "n_chars")),
        ("conversations", "conversations", "conversations", ("conv_id", "turn")), ("labels", "labels", "labels", None),
    )
)
SQL["d6_descriptions"] = f"SELECT kind, column_name, description FROM {all_findings(DIRTY, 'dirty', 0.3, smallest_distinct(DIRTY, 'dirty'))}"

# --- scalar functions ---


def scalar(name: str, **expressions: str) -> None:
    SQL[name] = "SELECT finding_id, " + ", ".join(f"{e} AS {a}" for a, e in expressions.items()) + f" FROM {FINDINGS} f"


scalar("x1_clamp", clamped=f"round({clamp('f.value * 2 - 1')}, 6)")
scalar("x2_detection_confidence", confidence=f"round({detection()}, 6)")
scalar("x3_error_confidence", confidence=f"round({error('kind', 'f.value * 3')}, 6)")
scalar("x4_penalty", penalty=f"round({PENALTY}, 6)")
scalar("x5_grade", grade=grade("round_even(f.value * 50, 2)"))
_health = "round_even(f.value * 50, 2)"
scalar(
    "x6_health_word",
    word=f"CASE WHEN {_health} >= 90 THEN 'Excellent' WHEN {_health} >= 80 THEN 'Good' WHEN {_health} >= 70 THEN 'Fair' WHEN {_health} >= 60 THEN 'Needs work' ELSE 'Poor' END",
)
scalar(
    "x7_change",
    absolute_change="round(f.value - f.threshold, 6)",
    relative_change="CASE WHEN severity <> 'info' THEN round(abs(f.value - f.threshold * 10) / greatest(abs(f.threshold * 10), 1), 6) END",
)
SQL["x8_psi_terms"] = (
    "SELECT o_custkey, round((tp - bp) * ln(tp / bp), 8) AS term FROM (SELECT o_custkey, greatest(count(*) FILTER (o_orderdate < DATE '1998-01-01') / (SELECT count(*) FROM orders WHERE o_orderdate < DATE '1998-01-01'), 1e-9) AS bp, "
    "greatest(count(*) FILTER (o_orderdate >= DATE '1998-01-01') / (SELECT count(*) FROM orders WHERE o_orderdate >= DATE '1998-01-01'), 1e-9) AS tp FROM orders GROUP BY o_custkey)"
)
_v4 = "round_even(f.value, 4)"
scalar("x9_drift_bands", numeric_band=band(_v4, NUMERIC_BANDS), psi_band=band(f"({_v4} / 4)", PSI_BANDS), score_band=band(f"abs(20 - {_v4} * 25)", SCORE_BANDS))
scalar("x10_severity_rank", severity_rank=f"CASE WHEN kind = 'outlier' THEN 0 ELSE {RANK} END")


def age(now: str) -> str:
    seconds = f"date_sub('second', ts, TIMESTAMP '{now}')"
    m = f"CAST(floor({seconds} / 60) AS BIGINT)"
    return (
        f"CASE WHEN {m} < 1 THEN 'just now' WHEN {m} < 60 THEN {m} || 'm ago' WHEN {m} < 1440 THEN ({m} // 60) || 'h ago' "
        f"WHEN {m} < 43200 THEN ({m} // 1440) || 'd ago' ELSE ({m} // 1440 // 30) || 'mo ago' END"
    )


SQL["x11_age_label"] = f"SELECT event_id, {age('2024-02-15 12:00:00')} AS age, {age('2024-01-01 03:00:00')} AS early_age FROM events"
scalar(
    "x12_impact_label",
    label="CASE WHEN kind = 'outlier' THEN 'unknown' WHEN severity IN ('critical', 'high') THEN 'High' WHEN severity = 'medium' THEN 'Medium' ELSE 'Low' END",
)
scalar(
    "x13_confidence_label",
    label="CASE WHEN kind = 'outlier' THEN 'unknown' WHEN round_even(f.value / 2, 4) >= 0.8 THEN 'High' WHEN round_even(f.value / 2, 4) >= 0.5 THEN 'Medium' ELSE 'Low' END",
)

# --- recommendations ---

PARAMETER = (
    f"CASE {OPERATION} WHEN 'drop_column' THEN 'drop' WHEN 'impute_missing' THEN {STRATEGY} WHEN 'drop_duplicates' THEN 'exact_rows' WHEN 'cast_type' THEN 'invalid_values' "
    "WHEN 'group_rare_categorical' THEN '5' WHEN 'review' THEN CASE kind WHEN 'missingness' THEN 'low_severity_missingness' WHEN 'outlier' THEN 'moderate_outliers' ELSE 'unsupported_finding_kind' END END"
)
for _name, _kind in (
    ("r1_missingness_actions", "missingness"), ("r3_duplicate_actions", "duplicates"), ("r4_placeholder_actions", "invalid_values"),
    ("r5_outlier_actions", "outlier"), ("r6_cardinality_actions", "cardinality"),
):
    SQL[_name] = (
        f"SELECT finding_id, {REC_KIND} AS kind, {TITLE} AS title, {OPERATION} AS operation, CASE WHEN kind <> 'duplicates' THEN {SHOWN} END AS column_name, {PARAMETER} AS parameter "
        f"FROM {FINDINGS} WHERE kind = '{_kind}'"
    )
SQL["r2_impute_strategy"] = f"SELECT finding_id, {STRATEGY} AS strategy FROM {FINDINGS}"
SQL["r7_confidence_priority"] = f"SELECT finding_id, round_even({RAW_CONFIDENCE}, 4) AS confidence, {PRIORITY} AS priority FROM {FINDINGS}"
SQL["r8_recommendation_run"] = (
    "SELECT CAST(row_number() OVER (ORDER BY priority DESC, title) AS INTEGER) AS rank, kind, severity, title, confidence, priority, operation FROM ("
    f"SELECT {REC_KIND} AS kind, severity, {TITLE} AS title, round_even({RAW_CONFIDENCE}, 4) AS confidence, {PRIORITY} AS priority, {OPERATION} AS operation "
    f"FROM {all_findings(LABELLED, 'labelled', 0.5, distinct_rows(LABELLED))})"
)

# --- previews ---

NONE = "CAST(NULL AS BIGINT)"


def preview(op_id, kind, column, status, affected, resulting, effect, detail, source=LABELLED) -> str:
    quote = lambda x: "CAST(NULL AS VARCHAR)" if x is None else f"'{x}'"
    return (
        f"SELECT '{op_id}' AS operation_id, '{kind}' AS operation_kind, {quote(column)} AS \"column\", '{status}' AS status, {affected} AS affected_rows, "
        f"{resulting} AS resulting_rows, {quote(effect)} AS side_effect, {detail} AS detail FROM {source} s"
    )


def rare(column: str, limit: int) -> str:
    return f"(SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {LABELLED} GROUP BY {column}) WHERE n < {limit})"


TOTAL, NO_TEXT = "count(*)", "CAST(NULL AS VARCHAR)"
P_DROP = [
    preview("v1a", "drop_column", "lang", "valid", NONE, NONE, None, "'doc_id, text, source, n_chars, quality, toxic'", "(SELECT 1)"),
    preview("v1b", "drop_column", "nothing", "invalid", NONE, NONE, "column_not_found", NO_TEXT, "(SELECT 1)"),
]
P_IMPUTE = [
    preview("v2a", "impute_missing", "quality", "valid", "count(*) - count(quality)", TOTAL, None, NO_TEXT),
    preview("v2b", "impute_missing", "lang", "valid", "count(*) - count(lang)", TOTAL, None, NO_TEXT),
]


def p_dedupe(source: str) -> str:
    return (
        "SELECT 'v3' AS operation_id, 'drop_duplicates' AS operation_kind, CAST(NULL AS VARCHAR) AS \"column\", 'valid' AS status, CAST(sum(n - 1) AS BIGINT) AS affected_rows, "
        "count(*) AS resulting_rows, CAST(NULL AS VARCHAR) AS side_effect, printf('%d member(s) of duplicate groups', CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT)) AS detail "
        f"FROM (SELECT count(*) AS n FROM {source} q GROUP BY q)"
    )


P_CAP = [
    preview("v4a", "cap_outliers", "n_chars", "valid", "count(*) FILTER (n_chars > 2000)", TOTAL, None, NO_TEXT),
    preview("v4b", "cap_outliers", "quality", "valid", "count(*) FILTER (quality > 0.5)", TOTAL, None, NO_TEXT),
]
P_CAST = [
    preview("v5a", "cast_type", "source", "warning", "count(*) FILTER (source IS NOT NULL AND TRY_CAST(source AS BIGINT) IS NULL)", NONE, "apply_required", "'string'"),
    preview("v5b", "cast_type", "n_chars", "warning", NONE, NONE, "apply_required", "'bigint'", "(SELECT 1)"),
]
P_RARE = [
    preview("v6a", "group_rare_categorical", "text", "valid", rare("text", 5), TOTAL, None, NO_TEXT),
    preview("v6b", "group_rare_categorical", "n_chars", "valid", rare("n_chars", 3), TOTAL, None, NO_TEXT),
    preview("v6c", "group_rare_categorical", "quality", "valid", rare("quality", 5), TOTAL, None, NO_TEXT),
]
P_OTHER = [
    preview("v7a", "review", "text", "valid", NONE, NONE, None, NO_TEXT, "(SELECT 1)"),
    preview("v7b", "none", None, "invalid", NONE, NONE, "missing_operation", NO_TEXT, "(SELECT 1)"),
    preview("v7c", "rename_column", "text", "invalid", NONE, NONE, "unknown_operation_kind", NO_TEXT, "(SELECT 1)"),
]
for _name, _parts in (
    ("v1_drop_column", P_DROP), ("v2_impute_missing", P_IMPUTE), ("v3_drop_duplicates", [p_dedupe(FLAGS)]), ("v4_cap_outliers", P_CAP), ("v5_cast_type", P_CAST),
    ("v6_group_rare", P_RARE), ("v7_other_operations", P_OTHER),
    ("v8_batch_preview", [*P_DROP, *P_IMPUTE, p_dedupe(LABELLED), *P_CAP, *P_CAST, *P_RARE, *P_OTHER]),
):
    SQL[_name] = " UNION ALL ".join(_parts)

# --- context and steps ---

CONTEXT = f"(SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {RANK} DESC, value DESC, column_name NULLS FIRST, kind, finding_id) AS rank FROM {FINDINGS})"
SQL["c1_finding_context"] = (
    f"SELECT dataset_id, CAST(count(*) AS INTEGER) AS items, string_agg(finding_id, ',' ORDER BY rank) AS finding_ids FROM {CONTEXT} WHERE rank <= 20 GROUP BY dataset_id"
)
_shown_findings = f"(SELECT * REPLACE (CAST(round_even(value, 2) AS DECIMAL(9,2)) AS value) FROM {FINDINGS})"
SQL["c2_context_text"] = (
    "SELECT c_custkey AS dataset_id, concat('Findings of one table:', chr(10), 'dataset_name: ', c_name, chr(10), 'profile_id: ', c_custkey, chr(10), 'current_score: ', "
    "coalesce(CAST(CAST(round_even(score, 1) AS DECIMAL(9,1)) AS VARCHAR), 'unknown'), chr(10), 'current_grade: ', coalesce(grade, 'unknown'), chr(10), 'finding_count: ', coalesce(n, 0), "
    "CASE WHEN lines IS NULL THEN '' ELSE chr(10) || 'findings:' || chr(10) || lines END) AS context FROM customer "
    f"LEFT JOIN (SELECT * FROM {NEWEST} WHERE back = 1) s ON c_custkey = s.dataset_id LEFT JOIN (SELECT dataset_id, count(*) AS n, string_agg(concat('  - id=', finding_id, ' kind=', kind, "
    "' severity=', severity, ' column=', coalesce(column_name, '<dataset>'), ' value=', value, ' threshold=', threshold, ' summary=', description), chr(10) ORDER BY rank) AS lines FROM "
    f"(SELECT *, row_number() OVER (PARTITION BY dataset_id ORDER BY {RANK} DESC, value DESC, column_name NULLS FIRST, kind, finding_id) AS rank FROM {_shown_findings}) WHERE rank <= 20 GROUP BY dataset_id) l ON c_custkey = l.dataset_id"
)
SQL["c3_hypotheses"] = (
    "SELECT dataset_id, CAST(rank AS INTEGER) AS rank, CASE WHEN kind IN ('missingness', 'outlier') THEN 'data_quality' WHEN kind IN ('type_changed', 'cardinality') THEN 'schema_drift' ELSE 'other' END AS category, "
    f"coalesce(column_name, '<dataset>') AS column_name, finding_id, 0.1e0 AS confidence FROM {CONTEXT} WHERE rank <= 3"
)
SQL["c4_analysis_steps"] = (
    "SELECT * FROM (VALUES ('profile', 'succeeded', 'none', NULL), ('detect', 'succeeded', 'none', NULL), ('score', 'succeeded', 'none', NULL), ('profile', 'succeeded', 'none', NULL), "
    "('detect', 'succeeded', 'none', NULL), ('score', 'succeeded', 'none', NULL), ('recommendations', 'succeeded', 'none', NULL), ('validations', 'succeeded', 'none', NULL), "
    "('history', 'succeeded', 'none', 'True'), ('unheard_of', 'failed', 'unsupported_step', NULL)) v(kind, status, error_code, has_drift)"
)

# --- streams: every event counts once, as the stream ends ---

SQL["e1_event_summary_stream"] = (
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS total, round_even(avg(value), 3) AS average, round_even(min(value), 3) AS least, round_even(max(value), 3) AS greatest "
    "FROM events GROUP BY date_trunc('day', ts), event_type"
)

# Admission step by step: the n-th event of every key meets the admitted moments before it.
_decided = (
    "WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS i FROM events), "
    "r AS (SELECT DISTINCT user_id, event_type, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS seen, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS BOOLEAN) AS allowed, "
    "CAST(NULL AS BIGINT) AS retry_after_seconds, CAST(NULL AS BIGINT) AS used FROM events UNION ALL "
    "SELECT user_id, event_type, i, CASE WHEN len(kept) < 2 THEN list_append(kept, t) ELSE kept END, event_id, len(kept) < 2, "
    "CASE WHEN len(kept) < 2 THEN 0 ELSE greatest(1, (kept[1] + 86400000000 - t + 999999) // 1000000) END, CAST(least(len(kept) + 1, 2) AS BIGINT) FROM "
    "(SELECT e.user_id, e.event_type, e.i, e.event_id, e.t, list_filter(r.seen, lambda x: x > e.t - 86400000000) AS kept FROM r JOIN e ON r.user_id = e.user_id AND r.event_type = e.event_type AND e.i = r.i + 1)) "
)
SQL["e2_admission_batch"] = _decided + "SELECT event_id, user_id, event_type, allowed, retry_after_seconds, used FROM r WHERE i > 0"
SQL["e2_admission_stream"] = _decided + "SELECT event_id, allowed, retry_after_seconds, used FROM r WHERE i > 0"

# --- flagship ---

SQL["flagship_quality_score"] = (
    f"SELECT 'labelled' AS dataset_id, CAST(7 AS BIGINT) AS column_count, n AS finding_count, round(total, 6) AS total_penalty, round(least(1.0e0, total / 7), 6) AS normalized_penalty, score, {grade('score')} AS grade FROM "
    f"(SELECT *, round_even(100.0e0 * (1.0e0 - least(1.0e0, total / 7)), 2) AS score FROM (SELECT count(*) AS n, sum({PENALTY}) AS total FROM {all_findings(LABELLED, 'labelled', 0.5, distinct_rows(LABELLED))}))"
)
