"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rowassay.session import settle

#: Words are runs of anything but ASCII white space; only A-Z are lowered.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def words_of(text: bytes | None) -> list[bytes]:
    """The lower-cased words of one UTF-8 text; ``bytes`` methods only touch ASCII."""
    return text.lower().split() if text else []


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, int(batch.num_rows * limit / max(1, batch.column(text).nbytes)))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def give_back() -> None:
    """Returns to the machine what Arrow and numpy have freed; the pool of the system allocator trims the C heap."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def lean(run: Callable) -> Callable:
    """``run`` for ``mapInArrow``, whose Python worker gives back freed memory as its task ends: workers idle on beside the stages that follow."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def word_count(text: Column) -> Column:
    """Number of words, 0 for NULL; ``size`` of a split without building the words again."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(rows: DataFrame, group: list[str], order: list[Column], spread: Column, name: str, buckets: int = 4096) -> DataFrame:
    """``rows`` plus ``name``: the row's rank from 0 within its group.

    The rank follows the bucket of ``spread`` (any long whose value decides the bucket), then ``order``.
    Rows are numbered within (group, bucket), and bucket counts give each bucket its first number, so a
    group holding a third of all rows is numbered by ``buckets`` tasks. Groups compare NULL-safely.
    """
    cut = rows.withColumn("_bucket", F.pmod(spread, F.lit(buckets)).cast("int"))
    keys = [*group, "_bucket"]
    inner = cut.withColumn("_at", F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    first = counts.withColumn("_first", F.sum("_n").over(W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)))
    first = first.select(*[F.col(k).alias(f"_rank_key{i}") for i, k in enumerate(keys)], F.coalesce("_first", F.lit(0)).alias("_first"))
    on = [F.col(k).eqNullSafe(F.col(f"_rank_key{i}")) for i, k in enumerate(keys)]
    joined = inner.join(first, on)
    return joined.withColumn(name, F.col("_first") + F.col("_at")).drop("_bucket", "_at", "_first", *[f"_rank_key{i}" for i in range(len(keys))])


def components(edges: DataFrame, file_rows: int = 1 << 20, least_files: int = 16) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b longs); root is the smallest node reachable.

    Alternating large-star and small-star rounds until all components are stars around their smallest node. Each
    round is written to the shared folder, so lineage stays short and nothing is lost with an executor; the number of
    files follows the number of edges, not that of shuffle partitions. Only minima are kept per node, never
    neighbour lists.
    """
    edges = settle(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        below, above = edges.select(F.col("a").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")), edges.select(F.col("b").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above"))
        nodes = below.unionByName(above).groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        n, unsettled = nodes.agg(F.coalesce(F.sum("below"), F.lit(0)), F.count_if((F.col("below") > 1) | ((F.col("below") == 1) & (F.col("above") == 1)))).first()
        if not unsettled:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(low, both.a == low.k).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(low, large.a == low.k).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = settle(small.select("e.*").filter("a <> b").distinct().coalesce(max(least_files, n // file_rows)), "edges")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
