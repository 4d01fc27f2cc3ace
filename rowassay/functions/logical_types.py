"""Logical type of a Spark column."""

from __future__ import annotations

from pyspark.sql import types as T

_BY_SPARK_TYPE = (
    (T.BooleanType, "boolean"),
    ((T.ByteType, T.ShortType, T.IntegerType, T.LongType), "integer"),
    ((T.FloatType, T.DoubleType), "float"),
    (T.DecimalType, "decimal"),
    ((T.StringType, T.CharType, T.VarcharType), "string"),
    (T.DateType, "date"),
    ((T.TimestampType, T.TimestampNTZType), "datetime"),
    (T.TimeType, "time"),
    (T.DayTimeIntervalType, "duration"),
    (T.BinaryType, "binary"),
    (T.ArrayType, "list"),
    (T.StructType, "struct"),
)

NUMERIC = ("integer", "float", "decimal")
TEMPORAL = ("date", "datetime")
CATEGORICAL = ("string", "boolean")
NESTED = ("list", "struct")


def logical_type(data_type: T.DataType) -> str:
    for spark_type, name in _BY_SPARK_TYPE:
        if isinstance(data_type, spark_type):
            return name
    return "unknown"


def physical_type(data_type: T.DataType) -> str:
    """Spark's own short name; nested types collapse to ``list`` and ``struct``."""
    name = logical_type(data_type)
    return name if name in NESTED else data_type.simpleString()
