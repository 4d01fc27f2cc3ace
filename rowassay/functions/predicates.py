"""Row predicates used by listings and searches."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def contains_text(query: str, *parts: Column, separator: str = " ") -> Column:
    """Case-insensitive literal substring search over several text columns; NULL parts count as empty.

    Matching each part on its own would miss hits across the separator, so the parts are joined first.
    """
    joined = F.concat_ws(separator, *[F.coalesce(p, F.lit("")) for p in parts])
    return F.contains(F.lower(joined), F.lit(query.lower()))


def is_identifier_name(name: Column) -> Column:
    """Column names that are ``id`` or end in ``_id``."""
    lowered = F.lower(name)
    return (lowered == "id") | F.endswith(lowered, F.lit("_id"))
