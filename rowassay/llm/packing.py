"""Conflict-constrained best-fit packing of documents into bins of ``capacity`` tokens.

A bin carries a bitmap of the sources and a bitmap of the duplicate clusters it holds; a document fits a bin
if it has room, and neither bitmap has the document's bit. Open bins are ordered by residual room. The
search starts at the smallest residual that holds the document and goes on to the successor, bin by bin,
until the tightest compatible bin is found; without one, a new bin is opened. Documents come in decreasing
size, so the largest find room first.

Documents are dealt by a hash of their content into lots of about ``lot`` pieces, and each lot is packed by one task, so hot sources
and clusters spread over all lots. Best fit holds within a lot; a larger ``lot`` packs tighter and takes a task more time. Equal documents are
counted and told apart by an ordinal, so bins depend on the documents alone, not on their partitions. Documents longer than a bin are cut: full pieces are bins of their
own, the rest is packed like a document.

Defined cases: documents without tokens get one row without a bin; a NULL source or cluster is a value like any other when it is
a source, and no conflict when it is a cluster; NULL and repeated ids are documents of their own; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.common import word_count
from rowassay.session import settle

LOT = 8192
STRETCH = 1 << 16  # equal documents that one row stands for while they are numbered


class Bins:
    """Bins of one lot, found by residual room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.sources: list[int] = []  # bitmap of each bin
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.by_room: dict[int, list[int]] = {}
        self.rooms = 0  # bitmap of the residuals that some bin has

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The compatible bin with the least room; among equals the one that has had that room longest."""
        later = self.rooms >> size
        room = size
        while later:
            skip = (later & -later).bit_length() - 1
            room += skip
            for b in self.by_room[room]:
                if not (self.sources[b] & source or self.clusters[b] & cluster):
                    return b
            later >>= skip + 1
            room += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Bin and start within it."""
        b = self.tightest(size, source, cluster)
        if b is None:
            b = len(self.used)
            self.sources.append(0)
            self.clusters.append(0)
            self.used.append(0)
        else:
            room = self.capacity - self.used[b]
            peers = self.by_room[room]
            peers.remove(b)
            if not peers:
                del self.by_room[room]
                self.rooms &= ~(1 << room)
        start = self.used[b]
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.used[b] += size
        room = self.capacity - self.used[b]
        if room:
            self.by_room.setdefault(room, []).append(b)
            self.rooms |= 1 << room
        return b, start


def pack_lot(lot: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Bin and start for each piece of one lot (row, size, source, cluster)."""
    source_bit = {s: 1 << i for i, s in enumerate(dict.fromkeys(lot["source"].tolist()))}
    repeated = lot["cluster"].value_counts()
    cluster_bit = {c: 1 << i for i, c in enumerate(repeated.index[repeated > 1])}  # clusters met once cannot conflict
    bins = Bins(capacity)
    lot = lot.sort_values(["size", "spread", "piece"], ascending=[False, True, True], kind="stable")
    places = [bins.put(size, source_bit[s] if whole else 0, cluster_bit.get(c, 0)) for size, s, c, whole in zip(lot["size"].tolist(), lot["source"].tolist(), lot["cluster"].tolist(), (lot["size"] <= capacity).tolist())]
    return lot.assign(local=[b for b, _ in places], start=[s for _, s in places], used=[bins.used[b] for b, _ in places])


def pack(docs: DataFrame, capacity: int = 2048, lot: int = LOT) -> DataFrame:
    """Pieces of ``docs`` (doc_id, source, cluster long, size long) with their bins.

    Returns doc_id, piece, first_token, size, source, cluster, bin_id, start, bin_used. Bins are numbered by
    lot and within it; ``start`` is the piece's place in its bin.
    """
    long = lambda n: F.lit(n).cast("long")
    alike = docs.select("doc_id", "source", "cluster", F.col("size").cast("long").alias("total")).groupBy("doc_id", "source", "cluster", "total").agg(F.count(F.lit(1)).alias("copies"))
    stretches = alike.withColumn("from", F.explode(F.sequence(long(0), F.col("copies") - 1, long(STRETCH))))
    each = stretches.withColumn("ordinal", F.explode(F.sequence("from", F.least(F.col("from") + STRETCH, "copies") - 1)))
    pieces = F.greatest(long(1), F.ceil(F.col("total") / F.lit(capacity)).cast("long"))
    rows = each.select("doc_id", "source", "cluster", "total", F.xxhash64("doc_id", "source", "cluster", "total", "ordinal").alias("spread"), F.explode(F.sequence(long(0), pieces - 1)).alias("piece"))
    cut = rows.withColumns({"first_token": F.col("piece") * capacity, "size": F.least(long(capacity), F.col("total") - F.col("piece") * capacity)})
    cut = settle(cut.drop("total"), "pieces")
    lots = max(1, math.ceil(cut.filter("size > 0").count() / lot))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        number = int(rows["lot"].iat[0])
        packed = pack_lot(rows.assign(source=rows["marked"]), capacity)
        packed["bin_id"] = number * (1 << 24) + packed["local"]
        packed["source"] = packed["marked"].str[1:].where(packed["marked"] != "", None)
        return packed[["doc_id", "piece", "first_token", "size", "source", "cluster", "bin_id", "start", "used"]].rename(columns={"used": "bin_used"})

    schema = "doc_id long, piece long, first_token long, size long, source string, cluster long, bin_id long, start long, bin_used long"
    # a NULL source is the empty mark, any other has a sign in front
    cut = cut.withColumn("marked", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    lotted = cut.filter("size > 0").withColumn("lot", F.pmod(F.xxhash64("spread", "piece"), F.lit(lots)).cast("int"))
    packed = lotted.groupBy("lot").applyInPandas(run, schema)
    none = F.lit(None).cast("long")
    empty = cut.filter("size <= 0").select("doc_id", "piece", "first_token", "size", "source", "cluster", none.alias("bin_id"), none.alias("start"), none.alias("bin_used"))
    return packed.unionByName(empty)


def documents_to_pack(docs: DataFrame) -> DataFrame:
    """(doc_id, source, cluster, size): words as size, equal texts as duplicate cluster."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.xxhash64("text").alias("cluster"), word_count(F.col("text")).alias("size"))
