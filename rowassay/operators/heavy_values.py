"""Top values per column without shuffling the column: exact, by bucket counts that bound every value.

Three scans at most, each reading all columns at once:

1. Every cell adds one to its hash bucket. Tasks send at most ``buckets`` counts per column, whatever
   the data. A value occurs at most as often as its bucket is full.
2. The values of each column's fullest buckets are counted exactly. The ``limit``-th of their counts is
   a floor: the whole column has at least ``limit`` values that occur so often.
3. A bucket that holds fewer cells than the floor cannot hold a value of the list, ties included. Where
   every other bucket is so, the list is proven and no third scan runs; the values of buckets where the
   proof fails are counted too. On a column without frequent values these are all of its buckets, and
   that column costs what counting all its values costs.

So what is shuffled is bounded by the values that could be in a list, not by the values there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from rowassay import constants as C
from rowassay.operators.value_counts import HEAD_CHARS, Slot, _key, _key_type, _pairs, by_family, name_of, ranked_cells, slots
from rowassay.session import settle

#: Hash buckets per column: bounds a task's counts, and what is broadcast (16 bytes a bucket).
BUCKETS = 4096
#: The second scan counts the values of this many buckets for every value asked for.
FIRST = 4


def _cells(families: dict[str, list[Slot]], buckets: int, typed: bool) -> str:
    """The non-NULL cells of all columns as one inlined array of (position, bucket and, if asked for, typed keys), as SQL."""
    structs = []
    for name, members in families.items():
        for slot in members:
            key = _key(slot, name)
            if name == "floating":  # equal keys must meet in one bucket, whatever the sign of their zero
                key = f"(CASE WHEN {key} = 0 THEN 0D ELSE {key} END)"
            fields = [f"{slot.position} AS position", f"CASE WHEN {key} IS NOT NULL THEN CAST(pmod(xxhash64({key}), {buckets}) AS INT) END AS bucket"]
            if typed:
                fields += [f"{key if n == name else f'CAST(NULL AS {_key_type(n)})'} AS {n}" for n in families]
            structs.append(f"struct({', '.join(fields)})")
    return f"inline(array({', '.join(structs)}))"


def bucket_counts(df: DataFrame, families: dict[str, list[Slot]], buckets: int) -> DataFrame:
    """Non-NULL cells per (position, bucket)."""
    cells = df.selectExpr(_cells(families, buckets, typed=False)).where("bucket IS NOT NULL")
    return cells.groupBy("position", "bucket").agg(F.expr("count(1) AS filled"))


def counts_within(df: DataFrame, families: dict[str, list[Slot]], buckets: int, wanted: DataFrame) -> DataFrame:
    """Exact counts of the values of some buckets: position, a key column per family, digest, n.

    ``wanted`` holds (position, bucket) and is broadcast: at most ``buckets`` rows a column.
    """
    cells = df.selectExpr(_cells(families, buckets, typed=True)).where("bucket IS NOT NULL")
    cells = cells.join(F.broadcast(wanted), ["position", "bucket"], "left_semi")
    keys, digest = list(families), "CAST(NULL AS BINARY) AS digest"
    if "text" in families:
        keys = [n if n != "text" else f"left(text, {HEAD_CHARS}) AS text" for n in families]
        digest = f"CASE WHEN length(text) > {HEAD_CHARS} THEN unhex(sha2(text, 256)) END AS digest"
    return cells.selectExpr("position", *keys, digest).groupBy("position", *families, "digest").agg(F.expr("count(1) AS n"))


def _tied_texts(df: DataFrame, members: list[Slot], counts: DataFrame, front: DataFrame) -> DataFrame:
    """The long texts that tie with a front row on count and head, whole: position, text, n.

    Only texts whose digest ties are fetched, not all that share a head. The digests are few unless many
    rare texts share one head; they are read from a file, so Spark sees their size and picks the join.
    """
    groups = front.where("digest IS NOT NULL").select("position", "text", "n").distinct()
    tied = settle(counts.where("digest IS NOT NULL").join(F.broadcast(groups), ["position", "text", "n"], "left_semi").select("position", "digest", "n"), "tied-texts")
    heads = groups.select("position", F.col("text").alias("head")).distinct()
    return (
        _pairs(df, "text", members)
        .where(f"length(value) > {HEAD_CHARS}")
        .withColumn("head", F.left("value", F.lit(HEAD_CHARS)))
        .join(F.broadcast(heads), ["position", "head"], "left_semi")
        .selectExpr("position", "value", "unhex(sha2(value, 256)) AS digest")
        .join(tied, ["position", "digest"])
        .groupBy("position", "digest", "n")
        .agg(F.expr("min(value) AS text"))
        .select("position", "text", "n")
    )


def heavy_values(df: DataFrame, columns=None, limit: int = C.TOP_VALUES, buckets: int = BUCKETS) -> DataFrame:
    """Top values per column, as ``top_values`` lists them, with how they were proven.

    ``ordinal_position, column, rank, value, count, frequency`` and ``proven_by``: ``bounds`` where bucket
    counts ruled out every value that was not counted, ``counts`` where further buckets had to be counted.
    ``buckets`` changes the cost only. NULL cells, nested columns and maps have no list; NaN and infinite
    values take ranks but are not shown; an empty table gives no rows.
    """
    if limit < 1 or buckets < 1:
        raise ValueError("limit and buckets must be at least 1")
    families = {n: m for n, m in by_family(df, columns).items() if n != "nested"}
    if not families:
        kinds = "ordinal_position int, column string, rank int, value string, count bigint, frequency double, proven_by string"
        return df.sparkSession.createDataFrame([], T.StructType.fromDDL(kinds))
    filled = settle(bucket_counts(df, families, buckets), "buckets")
    order = f"row_number() OVER (PARTITION BY position ORDER BY filled DESC, bucket) <= {FIRST * limit} AS first"
    sorted_ = settle(filled.selectExpr("*", order), "bucket-order")
    counts = settle(counts_within(df, families, buckets, sorted_.where("first").select("position", "bucket")), "first-counts")
    place = counts.selectExpr("position", "n", "row_number() OVER (PARTITION BY position ORDER BY n DESC) AS place")
    floors = place.where(f"place = {limit}").select("position", F.col("n").alias("floor"))  # one row a column
    # without a floor fewer than limit values are known, and any bucket may hold the next one
    open_ = settle(sorted_.where("NOT first").join(F.broadcast(floors), "position", "left").where("filled >= coalesce(floor, 0)").select("position", "bucket"), "open-buckets")
    if not open_.isEmpty():
        counts = counts.unionByName(settle(counts_within(df, families, buckets, open_), "open-counts"))
    cells = counts.select("position", "n", *families, "digest")
    leading = ranked_cells(families, cells, limit, lambda front: _tied_texts(df, families["text"], counts, front)).where("value IS NOT NULL")
    totals = filled.groupBy("position").agg(F.expr("sum(filled) AS counted"))
    further = open_.select("position").distinct().withColumn("further", F.lit(True))
    return (
        leading.join(F.broadcast(totals), "position")
        .join(F.broadcast(further), "position", "left")
        .select(
            F.col("position").alias("ordinal_position"),
            name_of(slots(df)).alias("column"),
            "rank",
            "value",
            "count",
            F.expr("count / counted AS frequency"),
            F.expr("CASE WHEN further THEN 'counts' ELSE 'bounds' END AS proven_by"),
        )
    )
