"""Value sanitising and text forms."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T


def finite(value: Column) -> Column:
    """NaN and both infinities become NULL."""
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), F.lit(None)).otherwise(value)


def utc_ntz(value: Column, data_type: T.DataType) -> Column:
    """Date or timestamp as a zone-free UTC timestamp; values without a zone are taken as UTC."""
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), value)
    return value.cast("timestamp_ntz")


def utc_ntz_sql(value: str, data_type: T.DataType) -> str:
    """The same as SQL text, for expressions generated from a schema."""
    if isinstance(data_type, T.TimestampType):
        return f"convert_timezone('UTC', {value})"
    return value if isinstance(data_type, T.TimestampNTZType) else f"CAST({value} AS TIMESTAMP_NTZ)"


def iso_utc(value: Column, data_type: T.DataType) -> Column:
    """UTC ISO-8601 text; the fraction appears only when there is one."""
    ntz = utc_ntz(value, data_type)
    whole = F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ntz, "SSSSSS")
    return F.when(micros == "000000", F.concat(whole, F.lit("+00:00"))).otherwise(
        F.concat(whole, F.lit("."), micros, F.lit("+00:00"))
    )


def text_form(value: Column, data_type: T.DataType) -> Column:
    """Readable text of a value: NULL for NULL and non-finite numbers, repaired UTF-8 for bytes."""
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return finite(value).cast("string")
    if isinstance(data_type, T.BinaryType):
        return F.make_valid_utf8(value.cast("string"))
    if isinstance(data_type, T.BooleanType):
        return F.initcap(value.cast("string"))
    if isinstance(data_type, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(value)
    return value.cast("string")
