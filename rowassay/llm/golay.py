"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A fingerprint bit is set when it is set in over half of the document's shingle hashes. Fingerprints at
``2`` or fewer differing bits are linked.

The 64 bits are cut into three segments of 22, 21 and 21 bits. Two errors leave at least one segment
without error, and for each pattern one of the ordered pairs A-B, B-C, C-A has no error in its first and at
most one in its second segment. The second segment, filled up to 23 bits, is decoded to the codewords of the
[23,12,7] Golay code within distance 4: one for three cosets of every four hundred, six for the rest. Two
words at distance 2 or less always share one (checked in the tests). So (pair, first segment,
codeword index) keys, 18 at most for a fingerprint, bring every linked pair together; pairs are verified on
all bits. Keys shared by very many fingerprints are refined by the codewords of the third segment.

Defined cases: NULL, empty and blank texts have fingerprint 0 and are linked like any other; texts with one
or two words hash the whole sequence; equal fingerprints are one class, linked once; NULL ids stay, and are
smaller than no id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from rowassay.llm.common import as_bytes, components, sliced, words_of
from rowassay.session import settle

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, the binary Golay code
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, width
PAIRS = ((0, 1), (1, 2), (2, 0))
CROWD = 256  # fingerprints under one key from which on the key is refined


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def error_patterns() -> np.ndarray:
    """By syndrome, the six error patterns of weight 4 or less, -1 where there are fewer."""
    words = np.array([sum(1 << b for b in bits) for n in range(5) for bits in combinations(range(23), n)], dtype=np.int64)
    found: dict[int, list[int]] = {}
    for word, syndrome in zip(words.tolist(), syndromes(words).tolist()):
        found.setdefault(syndrome, []).append(word)
    table = np.full((2048, 6), -1, dtype=np.int64)
    for syndrome, patterns in found.items():
        table[syndrome, : len(patterns)] = patterns
    return table


def codeword_indices(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """(n, 6) indices (the upper 12 bits) of the codewords near each 23-bit word, -1 where there are fewer."""
    patterns = table[syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def fingerprint(words: list[bytes], size: int = 3) -> int:
    if not words:
        return 0
    shingles = [words] if len(words) < size else zip(*(words[i:] for i in range(size)))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, 42) for s in map(b" ".join, shingles)), dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[start : start + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, size: int = 3, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text, ...) and fp, the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            values = [fingerprint(words_of(t), size) for t in as_bytes(batch.column("text"))]
            yield pa.record_batch([*map(batch.column, keep), pa.array(values, pa.int64())], names=[*keep, "fp"])

    return docs.select(*keep, "text").mapInArrow(run, docs.select(*keep).schema.add("fp", "long"))


def fuzzy_keys(prints: DataFrame) -> DataFrame:
    """(fp, key, pair) of each distinct fingerprint ``fp``."""
    table = error_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False)
            parts = [(fp.view(np.uint64) >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64) for at, width in SEGMENTS]
            for k, (exact, fuzzy) in enumerate(PAIRS):
                near = codeword_indices(parts[fuzzy], table)
                keys = (k << 34 | parts[exact] << 12)[:, None] | near
                there = near >= 0
                yield pa.record_batch([np.repeat(fp, there.sum(axis=1)), keys[there], np.full(there.sum(), k, dtype=np.int32)], names=["fp", "key", "pair"])

    return prints.mapInArrow(run, "fp long, key long, pair int")


def refined_keys(keys: DataFrame) -> DataFrame:
    """The rows of ``keys`` once for each codeword near the segment that the key leaves out."""
    table = error_patterns()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, key, pair = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("fp", "key", "pair"))
            at = np.array([SEGMENTS[3 - a - b] for a, b in PAIRS], dtype=np.uint64)[pair]
            rest = (fp.view(np.uint64) >> at[:, 0] & ((np.uint64(1) << at[:, 1]) - np.uint64(1))).astype(np.int64)
            near = codeword_indices(rest, table)
            there = near >= 0
            n = there.sum(axis=1)
            yield pa.record_batch([np.repeat(fp, n), ((key << 12)[:, None] | near)[there], np.repeat(pair, n)], names=["fp", "key", "pair"])

    return keys.select("fp", "key", "pair").mapInArrow(run, "fp long, key long, pair int")


def linked(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Distinct pairs (a, b), a < b, of the distinct fingerprints that differ in ``bits`` (2 at most) or fewer bits."""
    if bits > 2:
        raise ValueError("the keys find pairs with at most 2 differing bits")
    keys = fuzzy_keys(prints)  # cheaper to find again than to write
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("k"), "n")
    keyed = keys.join(shared, keys.key == shared.k).select("fp", "key", "pair", "n")

    def verified(rows: DataFrame) -> DataFrame:
        left, right = rows.select("key", F.col("fp").alias("a")), rows.select(F.col("key").alias("other"), F.col("fp").alias("b"))
        near = (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)
        return left.join(right, near).select("a", "b")

    return verified(keyed.filter(f"n <= {CROWD}")).unionByName(verified(refined_keys(keyed.filter(f"n > {CROWD}")))).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, bits: int = 2, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns (doc_id among them) of every row, fp, component_id and root.

    component_id is the smallest doc_id reachable by links, root the component's smallest fingerprint.
    """
    prints = settle(fingerprints(docs, size, keep), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(linked(classes.select("fp"), bits))
    # classes without a partner are their own component
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id")).withColumnRenamed("root", "r")
    named = rooted.join(lowest, rooted.root == lowest.r).select(F.col("fp").alias("k"), "component_id", "root")
    return prints.join(named, prints.fp == named.k).drop("k")
