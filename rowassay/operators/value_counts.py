"""Value counts per column, and what follows from them: distinct counts and top values.

Columns are counted together by type family, so a table of any width needs one scan and one
shuffle per family, values keep their native type (and order), and the map side combines before
anything is shuffled. Long texts travel as a 128-character head plus a SHA-256 digest; the few
whole texts a top list needs are fetched by a second, filtered scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowassay import constants as C
from rowassay.functions.cleaning import utc_ntz_sql
from rowassay.session import settle

HEAD_CHARS = 128


@dataclass(frozen=True)
class Slot:
    """One column of the profiled table."""

    position: int
    field: T.StructField

    @property
    def sql(self) -> str:
        """The quoted column name. Schema-driven expressions are SQL text: one call per column, not dozens."""
        return "`" + self.field.name.replace("`", "``") + "`"

    @property
    def value(self) -> Column:
        return F.col(self.sql)

    @property
    def type(self) -> T.DataType:
        return self.field.dataType


def slots(df: DataFrame, columns=None) -> list[Slot]:
    """Columns with their 1-based position, optionally only some of them."""
    wanted = None if columns is None else set(columns)
    return [Slot(i, f) for i, f in enumerate(df.schema.fields, start=1) if wanted is None or f.name in wanted]


def family(data_type: T.DataType) -> str | None:
    """Which shared key type a column is counted under; None for types without equality."""
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integral"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "floating"
    if isinstance(data_type, T.DecimalType):
        return f"decimal{data_type.scale}"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    if isinstance(data_type, (T.ArrayType, T.StructType)):
        return "nested"
    if isinstance(data_type, (T.MapType, T.VariantType, T.NullType)):
        return None
    return "text"


def by_family(df: DataFrame, columns=None) -> dict[str, list[Slot]]:
    groups: dict[str, list[Slot]] = {}
    for slot in slots(df, columns):
        name = family(slot.type)
        if name is not None:
            groups.setdefault(name, []).append(slot)
    return groups


def _key(slot: Slot, name: str) -> str:
    """The column's value in its family's key type, as SQL."""
    value = slot.sql
    if name == "integral":
        return f"CAST({value} AS BIGINT)"
    if name == "floating":
        return f"CAST({value} AS DOUBLE)"
    if name.startswith("decimal"):
        return f"CAST({value} AS DECIMAL(38, {slot.type.scale}))"
    if name == "temporal":
        return utc_ntz_sql(value, slot.type)
    if name == "nested":
        return f"CASE WHEN {value} IS NOT NULL THEN {cell_text(value, slot.type)} END"
    if isinstance(slot.type, T.BooleanType):
        return f"initcap(CAST({value} AS STRING))"
    return value if isinstance(slot.type, T.StringType) else f"CAST({value} AS STRING)"


def cell_text(value: str, kind: T.DataType, depth: int = 0) -> str:
    """A cell as self-delimiting text, as SQL: equal texts mean equal values, to the last microsecond and however deeply nested."""
    item = f"e{depth}"
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        text = f"CAST(CASE WHEN {value} = 0 THEN abs({value}) ELSE {value} END AS STRING)"
    elif isinstance(kind, T.BinaryType):
        text = f"hex({value})"
    elif isinstance(kind, T.TimestampType):
        text = f"CAST(unix_micros({value}) AS STRING)"
    elif isinstance(kind, T.ArrayType):
        text = f"array_join(transform({value}, {item} -> {cell_text(item, kind.elementType, depth + 1)}), '')"
    elif isinstance(kind, T.StructType):
        parts = ", ".join(cell_text(f"{value}.`{f.name.replace('`', '``')}`", f.dataType, depth) for f in kind.fields)
        text = f"CASE WHEN {value} IS NOT NULL THEN concat('', {parts}) END" if parts else f"CASE WHEN {value} IS NOT NULL THEN '' END"
    elif isinstance(kind, T.MapType):
        pair = f"concat({cell_text(f'{item}.key', kind.keyType, depth + 1)}, {cell_text(f'{item}.value', kind.valueType, depth + 1)})"
        text = f"array_join(array_sort(transform(map_entries({value}), {item} -> {pair})), '')"
    elif isinstance(kind, T.VariantType):
        text = f"to_json({value})"
    else:
        text = f"CAST({value} AS STRING)"
    return f"coalesce(concat(length({text}), ':', {text}), '~')"


def _pairs(df: DataFrame, name: str, members: list[Slot]) -> DataFrame:
    """One (position, value) row per non-NULL cell of the family's columns."""
    cells = ", ".join(f"struct({s.position} AS position, {_key(s, name)} AS value)" for s in members)
    return df.selectExpr(f"inline(array({cells}))").where("value IS NOT NULL")


def family_counts(df: DataFrame, name: str, members: list[Slot]) -> DataFrame:
    """Counts per (position, key). Keys: ``value``; for texts ``head`` and, when longer, ``digest``."""
    pairs = _pairs(df, name, members)
    if name == "text":
        pairs = pairs.selectExpr(
            "position",
            f"left(value, {HEAD_CHARS}) AS head",
            f"CASE WHEN length(value) > {HEAD_CHARS} THEN unhex(sha2(value, 256)) END AS digest",
        )
        return pairs.groupBy("position", "head", "digest").agg(F.count(F.lit(1)).alias("n"))
    if name == "nested":
        pairs = pairs.selectExpr("position", "unhex(sha2(value, 256)) AS value")
    return pairs.groupBy("position", "value").agg(F.expr("count(1) AS n"))


Counted = dict[str, tuple[list[Slot], DataFrame]]


def counted_families(df: DataFrame, columns=None) -> Counted:
    """The counts of every family, with the columns they cover."""
    return {name: (members, family_counts(df, name, members)) for name, members in by_family(df, columns).items()}


def settled_families(df: DataFrame, columns=None) -> Counted:
    """The same counts, made once for all operators that are given them."""
    return {name: (members, settle(counts, "value-counts")) for name, (members, counts) in counted_families(df, columns).items()}


def _shown(name: str, members: list[Slot], value: str = "value") -> str:
    """Text of a counted value, in the form of its own column's type, as SQL."""
    special = {
        "floating": (T.FloatType, f"CAST(CAST({value} AS FLOAT) AS STRING)", f"CAST({value} AS STRING)"),
        "temporal": (T.DateType, f"CAST(CAST({value} AS DATE) AS STRING)", f"CAST({value} AS STRING)"),
        "text": (T.BinaryType, f"make_valid_utf8({value})", value),
    }
    if name not in special:
        return f"CAST({value} AS STRING)"
    kind, narrow, text = special[name]
    positions = [str(s.position) for s in members if isinstance(s.type, kind)]
    if positions:
        text = f"CASE WHEN position IN ({', '.join(positions)}) THEN {narrow} ELSE {text} END"
    if name == "floating":
        text = f"CASE WHEN NOT isnan({value}) AND abs({value}) < double('infinity') THEN {text} END"
    return text


def _key_type(name: str) -> str:
    if name.startswith("decimal"):
        return f"DECIMAL(38, {name.removeprefix('decimal')})"
    return {"integral": "BIGINT", "floating": "DOUBLE", "temporal": "TIMESTAMP_NTZ", "text": "STRING"}[name]


def _ranked(rows: DataFrame, limit: int, order: str) -> DataFrame:
    rank = f"row_number() OVER (PARTITION BY position ORDER BY n DESC, {order}) AS rank"
    return rows.selectExpr("*", rank).where(f"rank <= {limit}")


def _whole_texts(df: DataFrame, members: list[Slot], front: DataFrame) -> DataFrame:
    """Every long text whose head and count stand in the front rows, whole: position, text, n.

    The wanted heads, at most the list limit per column, are broadcast into a second scan that drops
    short texts before it compares anything.
    """
    wanted = front.where("digest IS NOT NULL").groupBy("position", "text").agg(F.expr("collect_set(n) AS wanted"))
    return (
        _pairs(df, "text", members)
        .where(f"length(value) > {HEAD_CHARS}")
        .selectExpr("position", "value", f"left(value, {HEAD_CHARS}) AS text", "sha2(value, 256) AS digest")
        .join(F.broadcast(wanted), ["position", "text"])
        .groupBy("position", "digest")
        .agg(F.expr("min(value) AS text"), F.expr("count(1) AS n"), F.expr("first(wanted) AS wanted"))
        .where("array_contains(wanted, n)")
        .select("position", "text", "n")
    )


def leading_values(df: DataFrame, counted: Counted, limit: int) -> DataFrame:
    """The ``limit`` most frequent values per column: count descending, then value ascending.

    All families are ranked together, each in a key column of its own type. Texts are first ranked by
    (count, head, digest): that puts the same (count, head) groups in front as the whole texts would,
    and only inside such a group can the order differ. Bringing those groups' whole texts and ranking
    once more therefore gives the exact list.
    """
    families = [n for n in counted if n != "nested"]
    if not families:
        return df.sparkSession.range(0).selectExpr("CAST(id AS INT) AS position", "1 AS rank", "'' AS value", "id AS count")
    frames = []
    for name in families:
        own = "head" if name == "text" else "value"
        keys = [f"{own if n == name else f'CAST(NULL AS {_key_type(n)})'} AS {n}" for n in families]
        digest = "digest" if name == "text" else "CAST(NULL AS BINARY)"
        frames.append(counted[name][1].selectExpr("position", "n", *keys, f"{digest} AS digest"))
    members = {n: counted[n][0] for n in families}
    return ranked_cells(members, _union(frames), limit, lambda front: _whole_texts(df, members["text"], front))


def ranked_cells(families: dict[str, list[Slot]], cells: DataFrame, limit: int, whole_texts) -> DataFrame:
    """The top lists from counts of all families in one frame: position, n, a key column per family, digest."""
    order = ", ".join(families)
    ranked = _ranked(cells, limit, f"{order}, digest NULLS FIRST")
    if "text" in families:
        whole = whole_texts(ranked)
        ready = ranked.where("digest IS NULL").select("position", "n", *families).unionByName(whole, allowMissingColumns=True)
        ranked = _ranked(ready, limit, order)
    cases = " ".join(
        f"WHEN position IN ({', '.join(str(s.position) for s in members)}) THEN {_shown(n, members, n)}" for n, members in families.items()
    )
    return ranked.selectExpr("position", "rank", f"CASE {cases} END AS value", "n AS count")


def distinct_counts(counted: Counted) -> DataFrame:
    """Distinct and non-NULL cells per column, from the counts.

    Reading n keeps these branches on the same shuffles as the other uses of the counts.
    """
    rows = _union([counts.select("position", "n") for _, counts in counted.values()])
    return rows.groupBy("position").agg(F.expr("count_if(n > 0) AS distinct_count"), F.expr("sum(n) AS counted"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def name_of(members: list[Slot]) -> Column:
    """Column name for a position, from the schema."""
    labels = F.create_map(*[F.lit(x) for s in members for x in (s.position, s.field.name)])
    return F.element_at(labels, F.col("position"))


def value_counts(df: DataFrame, columns=None) -> DataFrame:
    """Every non-NULL value of every column with its count (A6): position, column, value, count."""
    frames = []
    for name, members in by_family(df, columns).items():
        if name == "nested":
            continue
        counts = _pairs(df, name, members).groupBy("position", "value").agg(F.count(F.lit(1)).alias("count"))
        frames.append(counts.select(F.col("position").alias("ordinal_position"), name_of(members).alias("column"), F.expr(_shown(name, members)).alias("value"), "count"))
    return _union(frames)


def top_values(df: DataFrame, columns=None, limit: int = C.TOP_VALUES) -> DataFrame:
    """Top values per column (A7), one row each with its share of the non-NULL cells."""
    counted = counted_families(df, columns)
    totals = distinct_counts(counted).select("position", "counted")  # one row per column
    leading = leading_values(df, counted, limit).where("value IS NOT NULL")
    return leading.join(F.broadcast(totals), "position").select(
        F.col("position").alias("ordinal_position"),
        name_of(slots(df)).alias("column"),
        "rank",
        "value",
        "count",
        F.expr("count / counted AS frequency"),
    )


def column_distinct(df: DataFrame, columns=None, counted: Counted | None = None) -> DataFrame:
    """Exact distinct non-NULL count and rate per column (A2); ``counted`` may be counts made before."""
    return distinct_counts(counted_families(df, columns) if counted is None else counted).select(
        F.col("position").alias("ordinal_position"),
        name_of(slots(df)).alias("column"),
        "distinct_count",
        F.expr("distinct_count / counted AS distinct_rate"),
    )
