"""Exact top-k search over a bit-sliced index.

Every component is turned into a whole number and shifted to be non-negative; each of its bits, over a block
of rows, is a bitmap (a slice). For a query, a positive factor takes the slices and a negative one their
complements, so all terms are non-negative: slice ``j`` of a component with factor bit ``i`` is added at
position ``i + j``. Bitmaps at a position are added three at a time (sum and carry by AND, XOR, OR). The
best rows of a block are then taken from the most significant slice of the sum downward: rows whose bit is
set are in while they fit into k, and narrow the choice when they do not. Rows still undecided after the
last slice tie exactly; the smallest ids fill up. Block winners are ranked by a window over all blocks.

Blocks hold rows by hash, at most about ``BLOCK`` and fewer when vectors are long or components large, so that the
slices of a block take about ``SLICE_BYTES``; queries travel in bundles to every block. Work and memory of a task are
bounded at any size. A block has as many slices as its own largest component needs, so one huge component makes one
block slow, not all.

Defined cases: vectors that are NULL or hold NULL or non-finite components (or components that are non-finite once
scaled), and rows with a NULL id, take no part; missing components of shorter vectors count as zero; repeated equal
rows count once; rows that share the query's id are its own, and different vectors under one query id have a ranking
each; fewer candidates than k give all of them; an empty table gives no rows. Components and scores are whole numbers
of any size and ranked exactly; a score that a long cannot show is shown as the largest or smallest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowassay.session import settle

BLOCK = 32_768
SLICE_BYTES = 64 << 20
BUNDLE = 64  # queries
WHOLE = float(1 << 53)  # from here on every double is a whole number


def finite(vector: Column) -> Column:
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, x) with whole-number components, as doubles, of the vectors that take part."""
    scaled = F.transform("embedding", lambda x: x.cast("double") * scale)
    fit = vectors.filter(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select("vec_id", scaled.alias("y")).filter(finite(F.col("y")))
    whole = F.transform("y", lambda y: F.when(F.abs(y) >= WHOLE, y).otherwise(F.floor(y).cast("double")))
    return fit.select("vec_id", whole.alias("x")).dropDuplicates()


def matrix(columns: list[pa.Array], width: int) -> np.ndarray:
    """List columns as one array of rows, filled up with zeros."""
    sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in columns])
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in columns])
    return out


def slice_block(x: np.ndarray, bits: int) -> np.ndarray:
    """(components, bits, words) bitmaps of the shifted components, rows in the given order."""
    shift, words = 1 << (bits - 1), -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), dtype=np.uint8)
    if bits <= 62:
        shifted = (x.astype(np.int64) + shift).astype(np.uint64)
        for j in range(bits):
            packed = np.packbits((shifted >> np.uint64(j) & np.uint64(1)).astype(np.uint8).T, axis=1, bitorder="little")
            out[:, j, : packed.shape[1]] = packed
    else:  # beyond machine words: Python's whole numbers, one component at a time
        size = -(-bits // 8)
        for d in range(x.shape[1]):
            raw = b"".join((int(v) + shift).to_bytes(size, "little") for v in x[:, d].tolist())
            each = np.unpackbits(np.frombuffer(raw, dtype=np.uint8).reshape(len(x), size), axis=1, bitorder="little")
            packed = np.packbits(each[:, :bits].T, axis=1, bitorder="little")
            out[d, :, : packed.shape[1]] = packed
    return out.view("<u8")


def bits_of(largest: float) -> int:
    """Bits of the shifted components, for the largest absolute value."""
    return int(largest).bit_length() + 1


def add_up(slices: np.ndarray, query: list[int]) -> list[np.ndarray]:
    """Slices of the weighted sum, least significant first."""
    terms: dict[int, list[np.ndarray]] = {}
    bits = slices.shape[1]
    by_sign = {False: slices, True: ~slices}
    for d, q in enumerate(query):
        size, z = abs(q), by_sign[q < 0][d]
        for i in range(size.bit_length()):
            if size >> i & 1:
                for j in range(bits):
                    terms.setdefault(i + j, []).append(z[j])
    total, position = [], 0
    while position <= max(terms, default=-1):
        here = terms.pop(position, [])
        stack = np.array(here) if here else np.zeros((1, slices.shape[2]), dtype=np.uint64)
        carried = []
        while len(stack) > 2:
            n = len(stack) // 3
            a, b, c, rest = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n], stack[3 * n :]
            half = a ^ b
            carried.append((a & b) | (half & c))
            stack = np.concatenate([half ^ c, rest])
        if len(stack) == 2:
            carried.append((stack[0] & stack[1])[None])
            stack = (stack[0] ^ stack[1])[None]
        total.append(stack[0])
        if carried:
            terms.setdefault(position + 1, []).extend(row for group in carried for row in group)
        position += 1
    return total


def best_rows(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k largest sums among the rows of a bitmap, ties to the smaller number."""
    sure, open_ = np.zeros_like(among), among.copy()
    missing = k
    for bitmap in reversed(total):
        ahead = open_ & bitmap
        n = int(np.bitwise_count(ahead).sum())
        if n > missing:
            open_ = ahead
        else:
            sure |= ahead
            open_ &= ~bitmap
            missing -= n
            if not missing:
                break
    bits = lambda bitmap: np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))
    return np.concatenate([bits(sure), bits(open_)[:missing]])


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each row that is a query with all others."""
    rows = settle(quantised(vectors, scale), "quantised")
    n, low, high, width = rows.agg(F.count(F.lit(1)), F.min(F.array_min("x")), F.max(F.array_max("x")), F.max(F.size("x"))).first()
    most = bits_of(max(abs(low or 0.0), abs(high or 0.0)))
    width = max(width or 1, 1)
    per_block = max(64, min(BLOCK, SLICE_BYTES * 8 // (width * max(most, 64))))
    blocks = max(1, -(-n // per_block))
    # scores as bytes in their own order: moved to be non-negative, of one length
    offset = 1 << (2 * most + width.bit_length())
    length = -(-(offset.bit_length() + 1) // 8)

    def index(groups: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(groups)
        ids = np.concatenate([p.column("vec_id").to_numpy(zero_copy_only=False) for p in parts])
        x = matrix([p.column("x") for p in parts], width)
        bits = bits_of(np.abs(x).max())
        order = np.argsort(ids, kind="stable")
        yield pa.record_batch(
            [parts[0].column("block")[:1], pa.array([bits], pa.int32()), pa.array([ids[order].tobytes()]), pa.array([slice_block(x[order], bits).tobytes()])],
            names=["block", "bits", "ids", "slices"],
        )

    blocked = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.lit(blocks)).cast("int"))
    indexed = settle(blocked.groupBy("block").applyInArrow(index, "block int, bits int, ids binary, slices binary"), "bit-slices")
    queries = rows.filter(is_query).withColumn("which", F.xxhash64("x"))
    bundles = max(1, -(-queries.count() // BUNDLE))
    bundled = queries.groupBy(F.pmod(F.xxhash64("vec_id", "x", F.lit(1)), F.lit(bundles)).alias("bundle")).agg(F.collect_list(F.struct("vec_id", "which", "x")).alias("queries"))
    sent = bundled.select("queries", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("to"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                bits = batch.column("bits")[r].as_py()
                ids = np.frombuffer(batch.column("ids")[r].as_py(), dtype=np.int64)
                slices = np.frombuffer(batch.column("slices")[r].as_py(), dtype="<u8").reshape(width, bits, -1)
                everyone = np.zeros(slices.shape[2] * 64, dtype=np.uint8)
                everyone[: len(ids)] = 1
                out = []
                for q in batch.column("queries")[r].as_py():
                    own, factors = q["vec_id"], [int(v) for v in q["x"]] + [0] * (width - len(q["x"]))
                    others = everyone.copy()
                    others[slice(*np.searchsorted(ids, [own, own + 1]))] = 0
                    total = add_up(slices, factors)
                    rows_ = best_rows(total, np.packbits(others, bitorder="little").view("<u8"), k)
                    # what the shift of the components and the complements of negative factors have added
                    added = sum(f << (bits - 1) if f > 0 else -f * ((1 << (bits - 1)) - 1) for f in factors)
                    for at in rows_.tolist():
                        value = sum((int(t[at >> 6]) >> (at & 63) & 1) << p for p, t in enumerate(total)) - added
                        out.append((own, q["which"], int(ids[at]), max(-(1 << 63), min((1 << 63) - 1, value)), (value + offset).to_bytes(length, "big")))
                kinds = {"query_id": pa.int64(), "which": pa.int64(), "vec_id": pa.int64(), "score": pa.int64(), "place": pa.binary()}
                yield pa.record_batch([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds.values())], names=list(kinds))

    joined = indexed.join(sent.hint("shuffle_merge"), F.col("block") == F.col("to")).select("bits", "ids", "slices", "queries")
    found = joined.mapInArrow(find, "query_id long, which long, vec_id long, score long, place binary")
    best = W.partitionBy("query_id", "which").orderBy(F.desc("place"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
