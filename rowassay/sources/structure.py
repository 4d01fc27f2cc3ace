"""Structure of a table: columns, types, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowassay import constants as C
from rowassay.functions.logical_types import logical_type, physical_type


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def table_structure(df: DataFrame, nullable_known: bool = True) -> DataFrame:
    """Ordered, typed columns with the row count (S4, S5). Counting reads no column.

    CSV carries no nullability; pass ``nullable_known=False`` to leave it NULL.
    """
    entries = [
        f"struct({i} AS ordinal_position, {_text(f.name)} AS name, {_text(physical_type(f.dataType))} AS physical_type, "
        f"{_text(logical_type(f.dataType))} AS logical_type, "
        f"{str(f.nullable).lower() if nullable_known else 'CAST(NULL AS BOOLEAN)'} AS nullable, row_count)"
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(F.expr(f"inline(array({', '.join(entries)}))"))


def table_columns(df: DataFrame) -> DataFrame:
    """Ordered, typed columns alone: no scan, only the schema."""
    entries = [
        f"struct({i} AS ordinal_position, {_text(f.name)} AS name, {_text(physical_type(f.dataType))} AS physical_type, "
        f"{_text(logical_type(f.dataType))} AS logical_type, {str(f.nullable).lower()} AS nullable)"
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.range(1).select(F.expr(f"inline(array({', '.join(entries)}))"))


def name_violations(names) -> DataFrame:
    """Broken column-name rules (S6): rule, position (0-based), name. Empty when the names are fine.

    ``names`` is a frame of (position, name); there is one row per offending name, and a single
    ``missing_columns`` row when there are no names at all.
    """
    blank = F.coalesce(F.trim("name") == "", F.lit(True))
    # A header: as many rows as the table has columns.
    repeated = names.groupBy("name").agg(F.count(F.lit(1)).alias("uses")).where("uses > 1").select("name")
    rules = [
        names.where(blank).select(F.lit("blank_column_name").alias("rule"), "position", "name"),
        names.where(F.length("name") > C.MAX_COLUMN_NAME).select(F.lit("column_name_too_long").alias("rule"), "position", "name"),
        names.join(F.broadcast(repeated), "name", "left_semi").select(F.lit("duplicate_column_names").alias("rule"), "position", "name"),
    ]
    none = names.agg(F.count(F.lit(1)).alias("n")).where("n = 0")
    missing = none.select(F.lit("missing_columns").alias("rule"), F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("name"))
    return rules[0].union(rules[1]).union(rules[2]).union(missing)


def column_names(spark: SparkSession, names: list[str]) -> DataFrame:
    """Names as (position, name) rows, for tables whose schema is already known."""
    return spark.createDataFrame(list(enumerate(names)), "position int, name string")
