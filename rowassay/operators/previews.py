"""Projected impact of repair operations on a table, without changing it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowassay import constants as C
from rowassay.functions.logical_types import physical_type
from rowassay.operators.row_duplicates import row_duplicates
from rowassay.operators.value_counts import by_family, family_counts

COLUMN_KINDS = ("impute_missing", "drop_column", "cap_outliers", "cast_type", "group_rare_categorical")
NO_COUNT = "CAST(NULL AS BIGINT)"


@dataclass(frozen=True)
class Operation:
    """One constrained operation; ``kind`` None means the recommendation carries none."""

    id: str
    kind: str | None
    column: str | None = None
    threshold: float = 0.0
    min_count: int = C.RARE_CATEGORY_MIN_COUNT
    target_type: str | None = None


def operations_of(recommendations: DataFrame, limit: int | None = None) -> list[Operation]:
    """Operations of the recommendations of one table, a few per column, best first; ``limit`` takes only the first."""
    op = F.col("operation")
    rows = recommendations.select(
        F.coalesce(F.array_join("supporting_findings", ","), F.lit("")).alias("id"), op["kind"].alias("kind"), op["params"].alias("params"),
        "priority",
    ).orderBy(F.desc("priority"), "id")
    rows = rows if limit is None else rows.limit(limit)
    return [
        Operation(
            r.id,
            r.kind,
            (r.params or {}).get("column"),
            float((r.params or {}).get("threshold") or 0.0),
            int((r.params or {}).get("min_count") or C.RARE_CATEGORY_MIN_COUNT),
        )
        for r in rows.collect()
    ]


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _entry(op: Operation, status: str, affected: str, resulting: str, effect: str | None, detail: str, summary: str) -> str:
    """One result row as SQL over the single row of counters."""
    column = _quoted(op.column) if op.column else "CAST(NULL AS STRING)"
    return (
        f"struct({_quoted(op.id)} AS operation_id, {_quoted(op.kind or 'none')} AS operation_kind, {column} AS column, "
        f"{status} AS status, {affected} AS affected_rows, {resulting} AS resulting_rows, "
        f"{_quoted(effect) if effect else 'CAST(NULL AS STRING)'} AS side_effect, {detail} AS detail, {summary} AS summary)"
    )


def preview_operations(df: DataFrame, operations: list[Operation]) -> DataFrame:
    """Status and projected impact of each operation (V1-V8), all from shared passes over the table.

    Row, NULL, cap and cast counters of every operation share one unshuffled aggregation; rare
    categories share one value count per type family; duplicates take one shuffle of row digests.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    counters = {"total": F.count(F.lit(1))}
    rare = [op for op in operations if op.kind == "group_rare_categorical" and op.column in types]
    for i, op in enumerate(operations):
        if op.column not in types:
            continue
        name = "`" + op.column.replace("`", "``") + "`"
        if op.kind in ("impute_missing", "group_rare_categorical"):
            counters[f"n{i}"] = F.expr(f"count_if({name} IS NULL)")
        elif op.kind == "cap_outliers":
            counters[f"n{i}"] = F.expr(f"count_if({name} > {float(op.threshold)!r}D)")
        elif op.kind == "cast_type" and op.target_type:
            counters[f"n{i}"] = F.expr(f"count_if({name} IS NOT NULL AND try_cast({name} AS {op.target_type}) IS NULL)")
    row = df.agg(*[c.alias(n) for n, c in counters.items()])
    if any(op.kind == "drop_duplicates" for op in operations):
        row = _beside(row, row_duplicates(df).select("duplicate_members", "removable_rows"))
    if rare:
        row = _beside(row, _rare_rows(df, rare))
    entries = [_result(i, op, types) for i, op in enumerate(operations)]
    return row.select(F.expr(f"inline(array({', '.join(entries)}))"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row frames as one row, without a join."""
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def _rare_name(op: Operation) -> str:
    return f"rare_{op.min_count}"


def _rare_rows(df: DataFrame, operations: list[Operation]) -> DataFrame:
    """Rows in non-NULL categories below each wanted count, as one row of maps keyed by column position."""
    limits = sorted({op.min_count for op in operations})
    frames = [
        family_counts(df, name, members)
        .groupBy("position")
        .agg(*[F.sum(F.when(F.col("n") < m, F.col("n"))).alias(f"rare_{m}") for m in limits])
        for name, members in by_family(df, {op.column for op in operations}).items()
    ]
    rows = reduce(DataFrame.unionByName, frames)
    # One entry per previewed column.
    return rows.agg(*[F.map_from_entries(F.collect_list(F.struct("position", f"rare_{m}"))).alias(f"rare_{m}") for m in limits])


def _result(i: int, op: Operation, types: dict) -> str:
    names = list(types)
    none = "CAST(NULL AS STRING)"
    fixed = lambda status, summary, effect=None, detail=none: _entry(op, f"'{status}'", NO_COUNT, NO_COUNT, effect, detail, _quoted(summary))
    if op.kind is None:
        return fixed("invalid", "There is no operation to preview.", "missing_operation")
    if op.kind == "review":
        return fixed("valid", "Review only; nothing would change.")
    if op.kind == "drop_duplicates":
        text = "format_string('%d of %d row(s) would be removed, leaving %d.', removable_rows, total, total - removable_rows)"
        detail = "format_string('%d member(s) of duplicate groups', duplicate_members)"
        return _entry(op, "'valid'", "removable_rows", "total - removable_rows", None, detail, text)
    if op.kind not in COLUMN_KINDS:
        return fixed("invalid", f"Operation '{op.kind}' has no preview.", "unknown_operation_kind")
    if not names:
        return fixed("invalid", "The source has no readable column.", "source_unreadable")
    if op.column not in types:
        return fixed("invalid", f"Column '{op.column}' is not in this version.", "column_not_found")
    if op.kind == "drop_column":
        left = [n for n in names if n != op.column]
        return fixed("valid", f"{len(left)} column(s) would remain.", None, _quoted(", ".join(left) or "<none>"))
    if op.kind == "cast_type":
        detail = _quoted(physical_type(types[op.column]))
        affected = f"n{i}" if op.target_type else NO_COUNT
        return _entry(op, "'warning'", affected, NO_COUNT, "apply_required", detail, _quoted("The cast takes effect only when applied."))
    if op.kind == "impute_missing":
        text = f"CASE WHEN total = 0 THEN 'The table is empty; nothing to impute.' ELSE format_string('%d of %d row(s) would be filled.', n{i}, total) END"
        affected = f"CASE WHEN total > 0 THEN n{i} END"
        return _entry(op, "CASE WHEN total = 0 THEN 'warning' ELSE 'valid' END", affected, "total", None, none, text)
    if op.kind == "cap_outliers":
        text = f"format_string('%d of %d row(s) lie above the cap.', n{i}, total)"
        return _entry(op, "'valid'", f"n{i}", "total", None, none, text)
    position = names.index(op.column) + 1
    # NULL is a category of its own: rare when present fewer than min_count times.
    count = f"coalesce({_rare_name(op)}[{position}], 0) + CASE WHEN n{i} < {op.min_count} THEN n{i} ELSE 0 END"
    text = f"format_string('%d row(s) would move to the bucket for rare values.', {count})"
    return _entry(op, "'valid'", count, "total", None, none, text)
