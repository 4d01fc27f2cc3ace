"""Importance resampling towards a target text collection.

Every run of one to three words is a feature and falls into one of ``BUCKETS`` buckets. From the features of all documents and
of the whole target, each bucket gets a gain, a rounded log ratio; gains are one array, and a document's weight
is the sum of the array at its features. A seeded Gumbel draw by document id is added, and the highest sums win:
sampling without replacement in proportion to the weights' exponentials.

The winners' cut-off is found by weighted median-of-medians selection over the whole order (score, id, features, text digest). Every
task cuts its remaining keys into lots, and gives each lot's median and size; the median of the medians,
weighted by sizes, is the pivot. At least a quarter of the remaining keys lie on either side of it, so each round discards that
many for certain, until the pivot is the cut-off itself or few keys are left to sort. The same job that counts against a
pivot finds the medians of both sides, so a round is one job; when the remaining keys have shrunk to an eighth they are written anew.
Only winners are then sorted, by ranges.

The CRC of a run of words is made from the CRCs of its words: appending n bytes to a text is a linear map of its
CRC, which is kept as four tables of 256 numbers for each n.

Defined cases: NULL, empty and word-less texts have no features and weight 0; a NULL id draws as an empty id and comes after all ids among
equal scores; rows equal in id and text are copies that tie, and as many of them win as there are places; without a target,
or without documents, counts are 0; documents with fewer than ``least_words`` words are scored but never drawn; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from rowassay.llm.common import as_bytes, sliced
from rowassay.session import settle

BUCKETS = 10_000
RUN = 3  # words in a feature, at most
# digits, letters (A-Z lowered) and all bytes beyond ASCII make words
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TABLED = 64  # appended bytes that have tables
LOT = 1 << 20  # keys in a lot
KEY = ("back", "unnamed", "id", "n_features", "digest")  # rising order of the draw; back is minus the score


def appended_tables() -> np.ndarray:
    """[n, k, b]: what appending n bytes makes of byte k of a CRC when that byte is b."""
    out = np.zeros((TABLED + 1, 4, 256), dtype=np.uint32)
    for n in range(TABLED + 1):
        zeros = bytes(n)
        none = zlib.crc32(zeros)
        bit = [zlib.crc32(zeros, 1 << i) ^ none for i in range(32)]
        for i, value in enumerate(bit):
            table, at = out[n, i // 8], np.arange(256)
            table[at >> (i % 8) & 1 == 1] ^= np.uint32(value)
    return out


TABLES = appended_tables()


def extended(crc: np.ndarray, word: np.ndarray, spaced: np.ndarray, length: np.ndarray, vocabulary: list[bytes]) -> np.ndarray:
    """The CRCs of texts with CRCs ``crc``, each followed by a space and the word numbered ``word``."""
    n = length[word]
    n_tabled = np.minimum(n, TABLED)
    out = spaced[word]
    for k in range(4):
        out = out ^ TABLES[n_tabled, k, crc >> np.uint32(8 * k) & np.uint32(255)]
    for i in np.flatnonzero(n > TABLED):
        out[i] = zlib.crc32(b" " + vocabulary[word[i]], int(crc[i]))
    return out


def feature_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(RUN, words) buckets of the runs that begin at each word, -1 where a text ends before; and each text's first word, and the end."""
    split = [t.translate(WORDS).split() for t in texts]
    first = np.cumsum([0, *map(len, split)])
    numbers: dict[bytes, int] = {}
    at = np.fromiter((numbers.setdefault(w, len(numbers)) for w in chain.from_iterable(split)), dtype=np.int64, count=first[-1])
    vocabulary = list(numbers)
    crc = np.array([zlib.crc32(w) for w in vocabulary], dtype=np.uint32)
    spaced = np.array([zlib.crc32(b" " + w) for w in vocabulary], dtype=np.uint32)
    length = np.array([len(w) + 1 for w in vocabulary], dtype=np.int64)
    out = np.full((RUN, len(at)), -1, dtype=np.int32)
    if len(at):
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(at))  # words from here to the end of the text
        own = crc[at]
        for k in range(RUN):
            if k:
                own = extended(own[:-1], at[k:], spaced, length, vocabulary)
            out[k, : len(own)] = np.where(left[: len(own)] > k, own % np.uint32(BUCKETS), -1)
    return out, first


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all ``texts`` (text) by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for batch in sliced(batches, "text", 1 << 20):
            found, _ = feature_buckets([t or b"" for t in as_bytes(batch.column("text"))])
            total += np.bincount(found.ravel() + 1, minlength=BUCKETS + 1)[1:]
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row for each bucket
        out[r.bucket] = r.n
    return out


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the log ratio of smoothed bucket shares, rounded down."""
    s_all, t_all = float(own.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + BUCKETS) / ((s + 1.0) * (t_all + BUCKETS)))) for s, t in zip(own.tolist(), target.tolist())], dtype=np.int64)


def gumbel(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = 42) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, digest) of every row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(np.concatenate([[0], gain]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in sliced(batches, "text", 1 << 20):
            found, first = feature_buckets([t or b"" for t in as_bytes(batch.column("text"))])
            running = np.concatenate([[0], np.cumsum(table[found + 1].sum(axis=0))])
            weight = running[first[1:]] - running[first[:-1]]
            n = np.diff(first)
            n_features = sum(np.maximum(n - k, 0) for k in range(RUN))
            noise = np.array([gumbel(i, seed) for i in batch.column("doc_id").to_pylist()], dtype=np.int64)
            yield pa.record_batch([batch.column("doc_id").cast(pa.int64()), *map(pa.array, (n, n_features, weight, weight + noise)), batch.column("digest")], names=["doc_id", "n_words", "n_features", "weight", "score", "digest"])

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long, digest long")


def keyed(scored: DataFrame) -> DataFrame:
    """``scored`` with the columns of ``KEY``; the smallest key is drawn first."""
    return scored.withColumns({"back": -F.col("score"), "unnamed": F.col("doc_id").isNull().cast("long"), "id": F.coalesce("doc_id", F.lit(0).cast("long"))})


def key_struct(key: tuple[int, ...] | None = None) -> Column:
    return F.struct(*[F.col(c) if key is None else F.lit(v).cast("long").alias(c) for c, v in zip(KEY, key or KEY)])


def middle_key(keys: np.ndarray) -> np.ndarray:
    """The lower median of ``keys`` (rows in rising lexicographic order of columns)."""
    rank = (len(keys) - 1) // 2
    for column in range(keys.shape[1]):
        value = np.partition(keys[:, column], rank)[rank]
        rank -= int((keys[:, column] < value).sum())
        keys = keys[keys[:, column] == value]
    return keys[0]


def weighted_median(keys: list[tuple[int, ...]], sizes: list[int]) -> tuple[int, ...]:
    half, passed = sum(sizes) / 2, 0
    for key, size in sorted(zip(keys, sizes)):
        passed += size
        if passed >= half:
            break
    return key


def lot_medians(rows: DataFrame, pivot: tuple[int, ...] | None, lot: int) -> list:
    """(side, n, key): of every lot the rows below (-1), at (0) and above (1) the pivot, and the medians of both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            keys = np.concatenate(waiting)
            waiting.clear()
            side = np.full(len(keys), int(pivot is None), dtype=np.int64)
            for column, at in zip(keys.T, pivot or ()):
                side = np.where(side == 0, (column > at).astype(np.int64) - (column < at), side)
            made = [(s, len(own), *middle_key(own).tolist()) for s in (-1, 0, 1) if len(own := keys[side == s])]
            return pa.record_batch([pa.array(c, pa.int64()) for c in zip(*made)], names=["side", "n", *KEY])

        for batch in batches:
            for at in range(0, batch.num_rows, lot):
                part = batch.slice(at, lot)
                if waiting and sum(map(len, waiting)) + part.num_rows > lot:
                    yield out()
                waiting.append(np.stack([part.column(c).to_numpy() for c in KEY], axis=1))
        if waiting:
            yield out()

    return rows.select(*KEY).mapInArrow(run, ", ".join(f"{c} long" for c in ("side", "n", *KEY))).collect()  # three rows for a lot at most


def cutoff(rows: DataFrame, places: int, lot: int = LOT, few: int = 1 << 14) -> tuple[int, ...] | None:
    """The key at rank ``places`` (from 1) of ``rows`` (``KEY`` columns), in rising order; None when there are not that many."""
    found = lot_medians(rows, None, lot)
    left, written = sum(r.n for r in found), None
    if not 1 <= places <= left:
        return None
    low = high = None
    while True:
        if left <= few:
            return sorted(tuple(r) for r in rows.select(*KEY).collect())[places - 1]  # at most ``few`` keys
        pivot = weighted_median([tuple(r[2:]) for r in found], [r.n for r in found])
        found = lot_medians(rows, pivot, lot)
        below, level = sum(r.n for r in found if r.side < 0), sum(r.n for r in found if r.side == 0)
        if below < places <= below + level:
            return pivot
        if places <= below:
            found, left, high = [r for r in found if r.side < 0], below, pivot
        else:
            found, left, places, low = [r for r in found if r.side > 0], left - below - level, places - below - level, pivot
        # the first column alone is pushed down to the scan
        if high is pivot:
            rows = rows.filter((F.col(KEY[0]) <= high[0]) & (key_struct() < key_struct(high)))
        else:
            rows = rows.filter((F.col(KEY[0]) >= low[0]) & (key_struct() > key_struct(low)))
        if written is None or left * 8 <= written:
            rows, written = settle(rows.select(*KEY), "importance-left"), left


def numbered(keys: DataFrame, places: int) -> DataFrame:
    """``keys`` (``KEY``, copies) in order, one row for each copy with its rank; ranks beyond ``places`` are NULL.

    Keys are dealt by ranges; the rows of a range are numbered together and ranges add what lies before them.
    """
    order = [F.col(c) for c in KEY]
    dealt = settle(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "importance-winners")
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # one row for each range
    ranges = dealt.groupBy("part").agg(F.sum("copies").alias("n")).select(F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("copies").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    first = dealt.withColumn("first", F.coalesce(inside, F.lit(0))).join(ranges, F.col("part") == F.col("p")).withColumn("first", F.col("first") + F.col("before") + 1)
    # many copies of one text are cut into stretches before they become rows
    step = 1 << 16
    stretch = first.withColumn("start", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1, F.lit(step).cast("long"))))
    stretch = stretch.repartition(F.col("part"), F.col("start")).withColumn("end", F.least(F.col("start") + (step - 1), F.col("first") + F.col("copies") - 1))
    return stretch.withColumn("rank", F.explode(F.sequence("start", "end"))).withColumn("rank", F.when(F.col("rank") <= places, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, lot: int = LOT, few: int = 1 << 14) -> DataFrame:
    """(doc_id, n_features, weight, score, rank, digest) for every row of ``docs`` (doc_id, text); drawn rows have a rank from 1.

    ``target`` (text) is what the drawn documents shall resemble; ``percent`` of the documents with ``least_words`` words or
    more are drawn, rounded down. ``digest`` tells texts of one id apart.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = keyed(settle(score(docs, gain, seed), "importance-scores"))
    able = scored.filter(F.col("n_words") >= least_words)
    places = able.count() * percent // 100
    last = cutoff(able, places, lot, few) if places else None
    shown = ("doc_id", "n_features", "weight", "score")
    if last is None:
        return scored.select(*shown, F.lit(None).cast("long").alias("rank"), "digest")
    wins = (F.col("n_words") >= least_words) & (F.col(KEY[0]) <= last[0]) & (key_struct() <= key_struct(last))
    # id and score decide the weight
    winners = scored.filter(wins).groupBy(*KEY, "doc_id", "weight", "score").agg(F.count(F.lit(1)).alias("copies"))
    others = scored.filter(~wins).select(*shown, F.lit(None).cast("long").alias("rank"), "digest")
    return numbered(winners, places).select(*shown, "rank", "digest").unionByName(others)


def drawn_documents(docs: DataFrame, ranked: DataFrame) -> DataFrame:
    """The whole rows of ``docs`` that ``resample`` drew, each as often as it was drawn; rows equal in id and text stand for each other."""
    wanted = ranked.filter("rank IS NOT NULL").groupBy(F.col("doc_id").alias("wanted_id"), F.col("digest").alias("wanted")).agg(F.count(F.lit(1)).alias("copies"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("digest"))
    found = rows.join(wanted, F.col("id").eqNullSafe(F.col("wanted_id")) & (F.col("digest") == F.col("wanted"))).dropDuplicates(["id", "digest"])
    return found.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")
