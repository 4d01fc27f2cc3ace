"""Inputs derived from the given tables, as SQL both engines read.

The given tables hold no NULLs, duplicates or placeholders and no version or finding history, so the
queries derive them. Spark gets ``{table}`` bound to a DataFrame, DuckDB to the view of that name.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# 60 % of the documents have no label, so quality and toxic are mostly NULL.
LABELLED = """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id"""

# Placeholders, medium and critical missingness, a heavy tail.
DIRTY_EVENTS = """
SELECT event_id, user_id,
  CASE WHEN event_type = 'error' THEN 'N/A' WHEN event_type = 'click' THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 20 = 0 THEN value END AS rare_value,
  CASE WHEN event_id % 10 = 0 THEN value * 1000 ELSE value END AS heavy_value,
  CASE WHEN event_type = 'view' THEN 'none' WHEN event_type = 'signup' THEN '-' ELSE 'ok' END AS note
FROM {events}"""

FLAGS = "SELECT l_returnflag, l_linestatus FROM {lineitem}"

TEXTS = "SELECT text FROM {documents}"

BASE_ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
FROM {orders} WHERE o_orderdate < DATE '1998-01-01'"""

# One column dropped, one added, one recast, and the price level raised.
TARGET_ORDERS = """
SELECT o_orderkey, CAST(o_custkey AS STRING) AS o_custkey, o_totalprice * 1.5 AS o_totalprice, o_orderdate,
  CASE WHEN o_orderpriority = '1-URGENT' THEN '5-LOW' ELSE o_orderpriority END AS o_orderpriority,
  CAST(year(o_orderdate) AS INT) AS o_year
FROM {orders} WHERE o_orderdate >= DATE '1998-01-01'"""

# A history of findings: one per order, tables are customers. The large prime divisor keeps values off decimal
# ties, where the engines round differently.
FINDINGS = """
SELECT o_custkey AS dataset_id, CAST(o_orderkey AS STRING) AS finding_id, kind, severity,
  CASE WHEN kind <> 'duplicates' THEN concat('col_', CAST(o_orderkey % 12 AS STRING)) END AS column_name,
  CASE WHEN kind = 'outlier' THEN 'mean' ELSE 'null_rate' END AS metric,
  o_totalprice / 250007.0e0 AS value,
  CASE kind WHEN 'missingness' THEN 0.5e0 WHEN 'cardinality' THEN 0.8e0 WHEN 'duplicates' THEN 0.05e0
    WHEN 'invalid_values' THEN 0.0e0 ELSE 0.1e0 END AS threshold,
  concat(kind, ' seen in order ', CAST(o_orderkey AS STRING)) AS description
FROM (SELECT o_orderkey, o_custkey, o_totalprice,
  CASE o_orderkey % 6 WHEN 0 THEN 'missingness' WHEN 1 THEN 'cardinality' WHEN 2 THEN 'duplicates'
    WHEN 3 THEN 'invalid_values' WHEN 4 THEN 'outlier' ELSE 'type_changed' END AS kind,
  CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity
  FROM {orders}) f"""

# A history of scores: one per order, tables are customers.
SCORES = """
SELECT o_custkey AS dataset_id, o_orderkey AS run_number, o_orderdate AS created_at, floor(o_totalprice / 50) / 100.0e0 AS score,
  CASE WHEN o_totalprice >= 450000 THEN 'A' WHEN o_totalprice >= 375000 THEN 'B' WHEN o_totalprice >= 300000 THEN 'C'
    WHEN o_totalprice >= 200000 THEN 'D' ELSE 'F' END AS grade,
  CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'O' THEN 'running' ELSE 'failed' END AS status
FROM {orders}"""

# A catalogue of tables: every customer, with the size of its orders; some have none.
CATALOGUE = """
SELECT c.c_custkey AS dataset_id, c.c_name AS name,
  CASE WHEN c.c_custkey % 3 = 0 THEN NULL ELSE c.c_mktsegment END AS description,
  v.row_count, v.size_bytes, v.updated_at, v.row_count AS current_version
FROM {customer} c LEFT JOIN (
  SELECT o_custkey, count(*) AS row_count, CAST(sum(length(o_orderpriority)) AS BIGINT) AS size_bytes, max(o_orderdate) AS updated_at
  FROM {orders} WHERE o_orderstatus <> 'P' GROUP BY o_custkey) v ON c.c_custkey = v.o_custkey"""

USAGE = """SELECT event_id, user_id, event_type, ts, value FROM {events}"""


# Whole numbers beyond the digits of a double, and amounts with all 38 digits of a decimal.
WIDE_NUMBERS = """
SELECT CAST(9007199254740993 AS BIGINT) + CAST(l_orderkey AS BIGINT) * 2 - CAST(l_partkey AS BIGINT) AS odd_key, l_linenumber AS line,
  CASE WHEN l_linenumber < 6 THEN CAST(l_orderkey AS BIGINT) * 4611686018427 - 9007199254740993 * CAST(l_suppkey AS BIGINT) END AS spread_key,
  CAST(l_orderkey AS DECIMAL(38, 0)) * CAST(99999999999999937 AS DECIMAL(38, 0)) - CAST(l_partkey AS DECIMAL(38, 0)) * CAST(999999999999999989 AS DECIMAL(38, 0)) AS amount
FROM {lineitem}"""

# The same numbers for Spark, whose BIGINT products stop the query once the keys of a larger table leave 64 bits.
WIDE_NUMBERS_ANY_SIZE = """
SELECT CAST(9007199254740993 AS BIGINT) + CAST(l_orderkey AS BIGINT) * 2 - CAST(l_partkey AS BIGINT) AS odd_key, l_linenumber AS line,
  CASE WHEN l_linenumber < 6 THEN CAST(l_orderkey AS DECIMAL(19, 0)) * CAST(4611686018427 AS DECIMAL(13, 0))
    - CAST(9007199254740993 AS DECIMAL(16, 0)) * CAST(l_suppkey AS DECIMAL(19, 0)) END AS spread_key,
  CAST(l_orderkey AS DECIMAL(38, 0)) * CAST(99999999999999937 AS DECIMAL(38, 0)) - CAST(l_partkey AS DECIMAL(38, 0)) * CAST(999999999999999989 AS DECIMAL(38, 0)) AS amount
FROM {lineitem}"""

# Doubles as whole hundredths, which all engines word alike.
CENTS = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity * 100) AS BIGINT) AS l_quantity,
  CAST(round(l_extendedprice * 100) AS BIGINT) AS l_extendedprice, CAST(round(l_discount * 100) AS BIGINT) AS l_discount,
  CAST(round(l_tax * 100) AS BIGINT) AS l_tax, l_returnflag, l_linestatus, l_shipdate
FROM {lineitem}"""


def names_in(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def derive(spark: SparkSession, folder: str, text: str) -> DataFrame:
    return spark.sql(text, **{n: load(spark, folder, n) for n in names_in(text)})


def duck(text: str) -> str:
    """The same text for DuckDB."""
    return re.sub(r"\{(\w+)\}", r"\1", text)
