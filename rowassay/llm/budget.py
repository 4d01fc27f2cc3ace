"""Mixing sources to target weights by subset-sum budget fitting.

Targets: each source gets its weight's share of ``share`` times all words, but at most ``repeats`` times its
own words; the excess is shared again by weight until no source is above (found in one pass over the sources
sorted by words for each unit of weight).

Budgets: a source takes whole copies of all its documents while they fit. For the rest, its documents are
counted by exact length, most of the budget is spread over the lengths in proportion, and a bounded-knapsack
dynamic program (a bitset of reachable sums) over the documents that are left fits the remaining words to
the nearest reachable sum. Only counts by length meet in one task: ``n`` different lengths need n^2 / 2 words,
so they grow with the root of a source at most. Which documents of a length are taken follows a seeded hash.

Defined cases: NULL texts have size 0; a NULL source is a source, the last in order; documents without words
are spread like any other length and take 0 words; NULL ids and repeated rows are documents of their own; an
empty table gives no rows. Reruns agree, whatever the partitioning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from rowassay.llm.common import ranked, word_count
from rowassay.session import settle

REST = 8192  # words of a source's budget that are left to the dynamic program, about


def source_targets(totals: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """``totals`` (source, source_size) plus ``target``; one row per source, so a single ordered pass is small."""
    at = F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (at % len(weights) + 1).cast("int")).cast("double"))
    limit = repeats * F.col("source_size")
    order = W.orderBy(limit / F.col("w"), F.asc_nulls_last("source"))
    before, rest = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    budget = share * F.sum("source_size").over(W.partitionBy())
    level = (budget - F.coalesce(F.sum(limit).over(before), F.lit(0))) / F.sum("w").over(rest)
    leveled = weighed.withColumn("level", level)
    above = F.when(limit > F.col("level") * F.col("w"), F.col("level"))
    # the first source that stays below its limit sets the level; capped sources come before it
    first = F.first(above, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return leveled.withColumn("target", F.least(limit.cast("double"), F.coalesce(first * F.col("w"), limit.cast("double")))).select("source", "source_size", "target")


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, rest: int = REST) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to ``budget``."""
    taken = np.zeros(len(lengths), dtype=np.int64)
    total = int((lengths * counts).sum())
    if total <= 0 or budget <= 0:
        return taken
    fraction, carry = max(0, budget - rest) / total, 0.0
    for i in np.argsort(-lengths, kind="stable"):
        length, n = int(lengths[i]), int(counts[i])
        if not length:
            taken[i] = round(n * budget / total)
            continue
        wanted = fraction * n * length + carry
        taken[i] = min(n, int(wanted // length))
        carry = wanted - int(taken[i]) * length
    left = budget - int((lengths * taken).sum())
    spare = counts - taken
    # taking nothing misses by ``left``, so a nearer sum lies below twice that
    usable = [int(i) for i in np.argsort(-lengths, kind="stable") if lengths[i] and spare[i]]
    if left <= 0 or not usable:
        return taken
    top = 2 * left
    reach, steps = 1, []
    for i in usable:
        length, n, part = int(lengths[i]), min(int(spare[i]), top // int(lengths[i])), 1
        while n > 0:  # counts in parts of 1, 2, 4, ...
            part = min(part, n)
            steps.append((i, part, reach))
            reach |= reach << part * length & (1 << top + 1) - 1
            n, part = n - part, part * 2
        if reach >> left & 1:
            break
    under = (reach & (1 << left + 1) - 1).bit_length() - 1
    over = reach >> left
    over = left + (over & -over).bit_length() - 1 if over else None
    goal = over if over is not None and over - left < left - under else under
    for i, part, before in reversed(steps):
        if not before >> goal & 1:
            goal -= part * int(lengths[i])
            taken[i] += part
    return taken


def length_plan(histogram: DataFrame, repeats: int) -> DataFrame:
    """(source, size, base, extra): copies of every document of a length, and how many of them get one more."""

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", kind="stable").reset_index(drop=True)
        words, target = int(group["source_size"].iat[0]), float(group["target"].iat[0])
        base = min(repeats, int(target // words)) if words else 0
        budget = 0 if base == repeats else round(target - base * words)
        extra = fit_lengths(group["size"].to_numpy(), group["n"].to_numpy(), budget)
        return pd.DataFrame({"source": group["source"], "size": group["size"], "base": base, "extra": extra})

    return histogram.groupBy("source").applyInPandas(fit, "source string, size long, base long, extra long")


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) and the ``keep`` columns for every row of ``docs`` (doc_id, source, text)."""
    spread = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))
    sized = settle(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), spread.alias("spread"), *keep), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = settle(source_targets(totals, weights, share, repeats), "targets")
    counts = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    named = targets.withColumnRenamed("source", "s")
    histogram = counts.join(named, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plan = settle(length_plan(histogram, repeats), "length-plan")
    plan = plan.join(named, F.col("source").eqNullSafe(F.col("s"))).select("s", F.col("size").alias("z"), "base", "extra", "source_size", "target")
    numbered = ranked(sized, ["source", "size"], [F.col("spread"), F.col("doc_id")], F.shiftright("spread", 20), "at")
    joined = numbered.join(plan, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    copies = F.col("base") + (F.col("at") < F.col("extra")).cast("long")
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
