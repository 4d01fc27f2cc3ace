"""Resharding by minimum-cost flow.

Old shard sizes are the supplies and new capacities the demands of a transport network; keeping bytes where
they are costs nothing and moving one costs 1 (or a given price for each pair of shards). Successive
cheapest paths solve it exactly; the network has shards, not documents, so the driver solves it. The flow says
how many bytes go from each old to each new shard. Within an old shard documents line up by size, largest
first, kept bytes first; each transfer takes its stretch of that line, a document going where its middle
falls. So cuts fall between small documents where they can, and shards meet their capacity to within
a document. Only shards that give or get anything are rewritten.

Places in the line follow from counts by (shard, size) and ranks within buckets, so no shard is sorted in one task.

Defined cases: NULL texts have no bytes and size 1; NULL ids, ties and repeated rows are documents of their own;
an empty table gives no rows; extra columns are ignored by the plan and kept by the rewrite.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from rowassay.llm.common import ranked
from rowassay.session import settle


def even_capacities(total: int, shards: int) -> list[int]:
    return [total * (i + 1) // shards - total * i // shards for i in range(shards)]


def cheapest_transfers(supplies: list[int], demands: list[int], price=None) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard, with the least total price."""
    price = price or (lambda i, j: int(i != j))
    if sum(supplies) != sum(demands):
        raise ValueError("supplies and demands differ")
    n, m = len(supplies), len(demands)
    source, sink = n + m, n + m + 1
    room: dict[tuple[int, int], int] = {}
    cost: dict[tuple[int, int], int] = {}
    for i, s in enumerate(supplies):
        room[source, i], cost[source, i] = s, 0
        for j in range(m):
            room[i, n + j], cost[i, n + j] = s, price(i, j)
    for j, d in enumerate(demands):
        room[n + j, sink], cost[n + j, sink] = d, 0
    for a, b in list(room):
        room[b, a], cost[b, a] = 0, -cost[a, b]
    open_amount, flow = sum(supplies), {}
    while open_amount:
        far, came = {source: 0}, {}
        for _ in range(n + m + 2):
            changed = False
            for (a, b), free in room.items():
                if free and a in far and far[a] + cost[a, b] < far.get(b, float("inf")):
                    far[b], came[b], changed = far[a] + cost[a, b], a, True
            if not changed:
                break
        path, node = [], sink
        while node != source:
            path.append((came[node], node))
            node = came[node]
        amount = min(room[e] for e in path)
        for a, b in path:
            room[a, b] -= amount
            room[b, a] += amount
        open_amount -= amount
    for i in range(n):
        for j in range(m):
            if room[n + j, i]:
                flow[i, j] = room[n + j, i]
    return flow


def _destination(transfers: dict[tuple[int, int], int], shard: Column, twice_middle: Column) -> Column:
    """The new shard of a document from its old shard and twice the byte position of its middle."""
    by_old: dict[int, list[tuple[int, int]]] = {}
    for (i, j), amount in sorted(transfers.items(), key=lambda t: (t[0][0], t[0][0] != t[0][1], t[0][1])):
        by_old.setdefault(i, []).append((j, amount))
    choice = None
    for i, parts in by_old.items():
        end, inner = 0, None
        for j, amount in parts[:-1]:
            end += amount
            test = twice_middle < 2 * end
            inner = F.when(test, F.lit(j)) if inner is None else inner.when(test, F.lit(j))
        target = F.lit(parts[-1][0]) if inner is None else inner.otherwise(F.lit(parts[-1][0]))
        choice = F.when(shard == i, target) if choice is None else choice.when(shard == i, target)
    return choice if choice is not None else F.lit(0)


def reshard(placed: DataFrame, shards: int, old_shards: int, price=None) -> DataFrame:
    """``placed`` (old_shard, size, spread, ...) plus ``shard`` and ``slot`` (its number there, from 0)."""
    counts = settle(placed.groupBy("old_shard", "size").agg(F.count(F.lit(1)).alias("n")), "shard-sizes")
    sizes = {r[0]: r[1] for r in counts.groupBy("old_shard").agg(F.sum(F.col("size") * F.col("n"))).collect()}  # one row per shard
    supplies = [int(sizes.get(i, 0)) for i in range(old_shards)]
    transfers = cheapest_transfers(supplies, even_capacities(sum(supplies), shards), price)
    larger = W.partitionBy("old_shard").orderBy(F.desc("size")).rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select(F.col("old_shard").alias("o"), F.col("size").alias("z"), F.coalesce(F.sum(F.col("size") * F.col("n")).over(larger), F.lit(0)).alias("start"))
    lined = ranked(placed, ["old_shard", "size"], [F.col("spread")], F.shiftright("spread", 20), "at").join(starts, (F.col("old_shard") == F.col("o")) & (F.col("size") == F.col("z")))
    twice = 2 * (F.col("start") + F.col("at") * F.col("size")) + F.col("size")
    moved = lined.withColumn("shard", _destination(transfers, F.col("old_shard"), twice).cast("int")).drop("o", "z", "start", "at")
    return ranked(settle(moved, "resharded"), ["shard"], [F.col("spread")], F.shiftright("spread", 20), "slot")


def place(docs: DataFrame, old_shards: int, seed: int = 5) -> DataFrame:
    """The layout that is to be changed: documents dealt to ``old_shards`` by a hash of their id."""
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    return docs.select(
        "doc_id",
        F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(old_shards)).cast("int").alias("old_shard"),
        size.alias("size"),
        F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "text").alias("spread"),
    )


def rewrite(spark: SparkSession, layout: str, out: str, shards: int, old_shards: int) -> DataFrame:
    """Reshard the Parquet folder ``layout`` (partitioned by old_shard; doc_id, text, ...) and write only what changes.

    Returns (shard, path, rewritten): an unaffected shard stays in its old folder, the others are below ``out``.
    """
    old = spark.read.parquet(layout)
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    keyed = old.select("*", size.alias("size"), F.xxhash64("doc_id", "text").alias("spread"))
    planned = settle(reshard(keyed, shards, old_shards), "reshard-rows")
    moving = planned.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct()
    touched = {r.s for r in moving.collect()}  # one row per shard
    changed = planned.filter(F.col("shard").isin(*touched)) if touched else planned.limit(0)
    changed.drop("size", "spread", "slot", "old_shard").write.mode("overwrite").partitionBy("shard").parquet(out)
    rows = [(s, f"{out}/shard={s}" if s in touched else f"{layout}/old_shard={s}", s in touched) for s in range(shards)]
    return spark.createDataFrame(rows, "shard int, path string, rewritten boolean")
