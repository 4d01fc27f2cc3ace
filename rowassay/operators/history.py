"""Result tables over time: latest rows, lineage, score trends, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowassay.functions.joins import join_null_safe
from rowassay.functions.predicates import contains_text
from rowassay.functions.scoring import severity_rank


SAMPLED = 32  # order values drawn for each stretch


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Newest row per key (W2) by ``order``, as an aggregation.

    Unlike a ranking window, ``max_by`` keeps one candidate per key and task, so a key that owns most
    rows is no heavier than any other.
    """
    newest = F.max_by(F.struct("*"), F.struct(*order))
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(newest.alias("row")).select("row.*")


def _neighbour(rows: DataFrame, keys: list[str], order: list[str], wanted: list[str], ahead: bool, pieces: int) -> DataFrame:
    """Add ``other``: the wanted columns of the next (or previous) row of the key, NULL at the end.

    Boundaries drawn from the rows' own order values (those with the smallest hashes, ``SAMPLED`` for each piece) cut the order into about
    ``pieces`` like stretches; each (key, stretch) is ordered on its own and only its first (or last) row meets the neighbouring
    stretch. So even one key that owns a third of the table spreads over many tasks. Order columns of any type serve, NULL keys and
    NULL order values (first in order) are rows like any other, and any boundaries give the same result. Rows with equal
    order values stay in one stretch.
    """
    other, at = F.struct(*wanted), F.struct(*order)
    step = F.lead if ahead else F.lag
    drawn = rows.select(at.alias("at")).orderBy(F.xxhash64("at")).limit(pieces * SAMPLED)
    chosen = F.sort_array(F.collect_set("at"))
    places = F.transform(F.sequence(F.lit(1), F.lit(pieces - 1)), lambda i: F.get(chosen, (F.size(chosen) * i / pieces).cast("int")))
    bounded = rows.withColumn("_bounds", drawn.agg(places).scalar())
    cut = bounded.withColumn("_stretch", F.size(F.filter("_bounds", lambda b: b <= at))).drop("_bounds")
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    at_edge = (F.lag if ahead else F.lead)(F.lit(1)).over(inside).isNull()
    placed = cut.withColumns({"other": step(other).over(inside), "_edge": at_edge})
    across = placed.where("_edge").select(*keys, "_stretch", other.alias("_own"))
    across = across.withColumn("_beyond", step("_own").over(Window.partitionBy(*keys).orderBy("_stretch"))).drop("_own")
    joined = join_null_safe(placed, across, [*keys, "_stretch"])
    return joined.withColumn("other", F.coalesce("other", "_beyond")).drop("_beyond", "_stretch", "_edge")


def lineage(versions: DataFrame, key: str = "dataset_id", number: str = "version_number", extra=(), pieces: int = 16) -> DataFrame:
    """Edges between consecutive versions of each table (W3); a single version has none."""
    carried = [number, *extra]
    rows = _neighbour(versions, [key], [number], carried, True, pieces).where(F.col("other").isNotNull())
    return rows.select(
        key,
        *[F.col(c).alias(f"from_{c}") for c in carried],
        *[F.col(f"other.{c}").alias(f"to_{c}") for c in carried],
    )


def score_changes(scores: DataFrame, keys: list[str], order: list[str], pieces: int = 16) -> DataFrame:
    """Change of each score against the previous run of its table, 0 for the first."""
    rows = _neighbour(scores, keys, order, ["score"], False, pieces)
    return rows.withColumn("score_delta", F.coalesce(F.col("score") - F.col("other.score"), F.lit(0.0))).drop("other")


def newest_scores(scores: DataFrame, keys: list[str], order: list[str], limit: int) -> DataFrame:
    """The newest ``limit`` scores per table, numbered in time order."""
    back = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    kept = scores.withColumn("age_rank", F.row_number().over(back)).where(F.col("age_rank") <= limit)
    size = F.count(F.lit(1)).over(Window.partitionBy(*keys))  # at most `limit` rows per key by now
    return kept.withColumn("point", (size - F.col("age_rank") + 1).cast("int")).drop("age_rank")


def score_trend(scores: DataFrame, keys: list[str], order: list[str], limit: int = 24) -> DataFrame:
    """Newest minus oldest score over the newest ``limit`` runs; 0 with fewer than two."""
    at = F.struct(*order)
    return newest_scores(scores, keys, order, limit).groupBy(*keys).agg(
        (F.max_by("score", at) - F.min_by("score", at)).alias("trend"), F.count(F.lit(1)).alias("runs")
    )


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of an ordered listing with the total rows and pages.

    Every task keeps only its first ``page * size`` rows; the total is a separate count.
    """
    total = rows.agg(F.count(F.lit(1))).scalar()
    listed = rows.orderBy(*order).offset((page - 1) * size).limit(size)
    return listed.withColumn("total_items", total).withColumn("total_pages", F.ceil(F.col("total_items") / size))


def top_findings(findings: DataFrame, limit: int = 5) -> DataFrame:
    """Findings with the highest impact: severity, then value, then column, kind and id."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy(F.desc("severity_rank"), F.desc("value"), F.asc("column_name"), F.asc("kind"), F.asc("finding_id")).limit(limit)


def heaviest_columns(breakdown: DataFrame, limit: int = 8) -> DataFrame:
    """Columns with the largest penalty (T3), from a score breakdown."""
    return breakdown.where(F.col("axis") == "column").orderBy(F.desc("penalty_total"), F.asc("bucket")).limit(limit)


SORT_FIELDS = {"name": "name", "rows": "row_count", "size": "size_bytes", "updated": "updated_at"}


def sorted_tables(tables: DataFrame, field: str = "updated", descending: bool = True, search: str = "") -> DataFrame:
    """Tables ordered by name, rows, bytes or update time; missing sizes count as -1 (T4)."""
    column = F.col(SORT_FIELDS[field])
    key = F.lower(column) if field == "name" else F.coalesce(column, F.lit(-1)) if field in ("rows", "size") else column
    rows = tables.where(contains_text(search, F.col("name"), F.col("description"), separator="")) if search else tables
    return rows.orderBy(key.desc() if descending else key.asc(), F.asc("dataset_id"))


def worst_scores(scores: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Latest score of every table, worst first (T5)."""
    return latest_per_key(scores, keys, order).orderBy(F.asc("score"), *keys)


def with_latest_context(recommendations: DataFrame, scores: DataFrame, interpretations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Recommendations with the latest score, grade and interpretation id of their table."""
    score = latest_per_key(scores, keys, order).select(*keys, F.col("score").alias("latest_score"), F.col("grade").alias("latest_grade"))
    note = latest_per_key(interpretations, keys, order).select(*keys, F.col("interpretation_id").alias("latest_interpretation_id"))
    return recommendations.join(score, keys, "left").join(note, keys, "left")


def with_children(parents: DataFrame, children: DataFrame, on: str, order: str, name: str = "children") -> DataFrame:
    """Each parent with the ordered list of its children.

    Meant for children bounded by nature, such as the columns of a table: the list is one cell.
    """
    fields = [order, *[c for c in children.columns if c not in (on, order)]]
    lists = children.groupBy(on).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, on, "left")


def known_keys(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requested keys that exist."""
    return wanted.join(table, key, "left_semi")


def missing_keys(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Requested keys that do not exist."""
    return wanted.join(table, key, "left_anti")


def run_status(runs: DataFrame) -> DataFrame:
    """Runs per status, with one total row."""
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("run_count"))


def active_tables(tables: DataFrame) -> DataFrame:
    """Tables in all and tables that have a current version."""
    return tables.agg(F.count(F.lit(1)).alias("table_count"), F.count_if(F.col("current_version").isNotNull()).alias("active_count"))


def aligned_series(points: DataFrame, names: list[str]) -> DataFrame:
    """Named series (x, series, y) side by side on the union of their x values (U4)."""
    return points.groupBy("x").pivot("series", names).agg(F.first("y", ignorenulls=True)).orderBy("x")
