"""Embedding near-duplicates by spherical-cap filters from structured random product codes.

Vectors are normalised, rotated at random and cut into four blocks; each block has its own code of random
unit vectors, and a filter direction is any combination of one code word per block, scaled to length one. A
vector is list-decoded to every direction within angle ``nearest + slack * reach`` of it, where ``nearest`` is its
angle to its closest direction and ``reach`` the angle of the wanted cosine. Two vectors meet if the closest direction of
one is in the other's list. With a slack of 1 every pair does for certain: the one whose closest direction is closer has it
within ``reach + nearest`` of the other, by the triangle inequality. In d dimensions a step in a random direction (the rotation makes it
one) changes the angle to a fixed direction by about ``reach / sqrt(d)`` only, and a pair is missed only if two such changes exceed
``2 * slack * reach`` together. The slack is therefore ``SIGMAS / sqrt(d)``, at most 1: nearly seven standard deviations in
any dimension, a chance below 1e-9 for a link. The number of directions follows the number of vectors.

So each class of vectors is a row for every direction of its list, and looks others up under its closest one alone: a join on (label,
length, filter) makes a pair at most twice, however many directions both lists share. A 16-byte sketch (16 rotated coordinates, rounded) gives a
lower bound of the distance that drops other pairs within the join; what remains is verified in double
precision on the whole vectors.

Equal vectors of a label are one class with a count, so copies are never paired with each other.

Defined cases: vectors that are NULL, empty, zero, or hold NULL or non-finite components, and rows with a
NULL label or NULL id, link with nothing; vectors of different length do not link; each row of a repeated id
counts as a vector, linked by its own vector only; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from rowassay.llm.common import components
from rowassay.session import settle

BLOCKS = 4
SKETCH = 16  # coordinates, one byte each
STEP = 127.0
SIGMAS = 4.8
SUMS = 1 << 21  # half sums of all vectors that are decoded together


def usable(vector: Column) -> Column:
    """Whether a vector can be compared: no NULL, NaN or infinity in it, and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class ProductCode:
    """Rotation and block codes for vectors of one length."""

    def __init__(self, length: int, words: int, seed: int):
        draw = np.random.default_rng([seed, length])
        self.width = -(-length // BLOCKS)
        self.rotation = np.linalg.qr(draw.standard_normal((self.width * BLOCKS, self.width * BLOCKS)))[0][:length]
        code = draw.standard_normal((BLOCKS, words, self.width))
        self.code = code / np.linalg.norm(code, axis=2, keepdims=True) / np.sqrt(BLOCKS)
        self.words = words

    def decode(self, unit: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Rotated vectors, the closest direction of each, and the directions that each of them exceeds.

        The products of the first two and of the last two blocks are summed apart; the second list is
        sorted, so the partners that lift a sum over the threshold are a prefix found by bisection.
        """
        turned = unit @ self.rotation
        parts = np.einsum("nbw,bcw->nbc", turned.reshape(len(unit), BLOCKS, self.width), self.code)
        head = (parts[:, 0, :, None] + parts[:, 1, None, :]).reshape(len(unit), -1)
        tail = (parts[:, 2, :, None] + parts[:, 3, None, :]).reshape(len(unit), -1)
        best = np.clip(head.max(axis=1) + tail.max(axis=1), -1, 1)
        floor = np.cos(np.minimum(np.pi, np.arccos(best) + reach + 1e-6))
        found, square = [], self.words**2
        for h, t, low in zip(head, tail, floor):
            order = np.argsort(-t)
            down = -t[order]
            firsts = np.flatnonzero(h - down[0] >= low)
            n = np.searchsorted(down, h[firsts] - low, side="right")
            at = np.repeat(np.cumsum(n) - n, n)
            found.append(np.repeat(firsts, n) * square + order[np.arange(n.sum()) - at])
        return turned, head.argmax(axis=1) * square + tail.argmax(axis=1), found


def filter_rows(classes: DataFrame, words: int, reach: float, slack: float | None, seed: int) -> DataFrame:
    """(label, length, filter, closest, rep, s0, s1): one row for each class and filter direction."""
    step = max(1, min(512, SUMS // words**2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, ProductCode] = {}
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                lengths = batch.column("length").to_numpy(zero_copy_only=False)
                for length in np.unique(lengths).tolist():
                    rows = batch.filter(pa.array(lengths == length))
                    if length not in codes:
                        codes[length] = ProductCode(length, words, seed)
                    vectors = rows.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
                    own = min(1.0, SIGMAS / np.sqrt(length)) if slack is None else slack
                    turned, closest, found = codes[length].decode(scaled / np.linalg.norm(scaled, axis=1, keepdims=True), reach * own)
                    small = np.zeros((len(turned), SKETCH), dtype=np.int8)
                    small[:, : min(SKETCH, turned.shape[1])] = np.rint(turned[:, :SKETCH] * STEP)
                    halves = small.view("<i8")
                    n = np.array(list(map(len, found)))
                    take, filters = pa.array(np.repeat(np.arange(len(n)), n)), np.concatenate(found)
                    is_closest = pa.array(filters == np.repeat(closest, n))
                    yield pa.record_batch(
                        [rows.column("label").take(take), rows.column("length").take(take), filters, is_closest, rows.column("rep").take(take), np.repeat(halves[:, 0], n), np.repeat(halves[:, 1], n)],
                        names=["label", "length", "filter", "closest", "rep", "s0", "s1"],
                    )

    label = classes.schema["label"].dataType.simpleString()
    return classes.select("label", "length", "rep", "vector").mapInArrow(run, f"label {label}, length int, filter long, closest boolean, rep long, s0 long, s1 long")


def sketch_distance() -> Column:
    """Squared distance of two sketches (a0, a1) and (b0, b1) in rounding steps."""

    def byte(half: str, k: int) -> Column:
        return F.shiftright(F.shiftleft(F.col(half), 56 - 8 * k), 56)

    parts = [(byte(f"a{h}", k) - byte(f"b{h}", k)) for h in (0, 1) for k in range(8)]
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return total


def links(classes: DataFrame, cosine: float, slack: float | None = None, seed: int = 7) -> DataFrame:
    """(a, b) pairs, a < b, of class numbers with at least that cosine and equal labels."""
    reach = float(np.arccos(cosine))
    words = int(max(6, np.ceil((classes.count() / 4) ** (1 / BLOCKS))))
    rows = settle(filter_rows(classes, words, reach, slack, seed), "cap-filters")
    left = rows.filter("closest").select(F.col("label").alias("la"), F.col("length").alias("na"), F.col("filter").alias("fa"), F.col("rep").alias("a"), F.col("s0").alias("a0"), F.col("s1").alias("a1"))
    right = rows.select(F.col("label").alias("lb"), F.col("length").alias("nb"), F.col("filter").alias("fb"), F.col("rep").alias("b"), F.col("s0").alias("b0"), F.col("s1").alias("b1"))
    # unit vectors at angle ``reach`` are 2 sin(reach / 2) apart; each coordinate is rounded by half a step at most
    limit = int(np.ceil((2 * np.sin(reach / 2) * STEP + np.sqrt(SKETCH)) ** 2)) + 1
    near = (F.col("la") == F.col("lb")) & (F.col("na") == F.col("nb")) & (F.col("fa") == F.col("fb")) & (F.col("a") != F.col("b")) & (sketch_distance() <= limit)
    pairs = left.join(right, near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    unit = classes.select("rep", "label", "vector", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda t, x: t + x * x)).alias("norm"))
    one, two = (unit.select(F.col("rep").alias(f"r{i}"), F.col("label").alias(f"l{i}"), F.col("vector").alias(f"v{i}"), F.col("norm").alias(f"n{i}")) for i in (1, 2))
    product = F.aggregate(F.zip_with("v1", "v2", lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    checked = pairs.join(one, F.col("a") == F.col("r1")).join(two, (F.col("b") == F.col("r2")) & (F.col("l1") == F.col("l2")))
    return checked.filter((F.size("v1") == F.size("v2")) & (product / (F.col("n1") * F.col("n2")) >= cosine)).select("a", "b")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label)."""
    plain = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    largest = F.array_max(F.transform("vector", F.abs))
    fit = plain.filter(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))
    # scaling by the largest component keeps squares in range and leaves the cosine as it is
    fit = fit.withColumn("vector", F.when((largest > 1e100) | (largest < 1e-100), F.transform("vector", lambda x: x / largest)).otherwise(F.col("vector")))
    # a class is numbered once and written: ids may repeat
    classes = fit.groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("n"))
    classes = settle(classes.select(F.monotonically_increasing_id().alias("rep"), "*", F.size("vector").alias("length")), "vector-classes")
    pairs = settle(links(classes, cosine), "vector-links")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(classes.select("rep", "n"), F.col("b") == F.col("rep")).groupBy("a").agg(F.sum("n").alias("others"))
    roots = classes.select("rep", "first").join(components(pairs), F.col("rep") == F.col("node"), "left").select("rep", "first", F.coalesce("root", "rep").alias("root"))
    smallest = roots.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("component_id"))
    named = classes.join(degree, classes.rep == degree.a, "left").join(roots.join(smallest, F.col("root") == F.col("of")).select(F.col("rep").alias("k"), "component_id"), F.col("rep") == F.col("k"))
    named = named.select(F.col("label").alias("l"), F.col("vector").alias("v"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id")
    linked = fit.join(named, (F.col("label") == F.col("l")) & (F.col("vector") == F.col("v"))).select("vec_id", "n_links", "component_id")
    alone = plain.filter(~(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("vector")))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
