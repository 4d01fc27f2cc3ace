"""Profiles that grow: a mergeable state per column, so that appended rows cost only their own scan.

A state row holds counts, moments, extremes and three sketches: distinct values (HyperLogLog), quantiles (KLL) and frequent items.
States of any parts of a table merge to the state of the whole, in any order; counts, extremes, sums, means and
deviations are then those of one pass, the sketches keep their error bounds. All of it is one aggregation without a shuffle of values,
and a state has a fixed size, whatever the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowassay import constants as C
from rowassay.functions.logical_types import NUMERIC
from rowassay.operators.column_stats import _finite, _identity, _times, is_numeric, unpivot
from rowassay.operators.value_counts import HEAD_CHARS, Slot, _key, family, slots

TOP_TYPE = "array<struct<value:string,count:bigint,frequency:double>>"
HLL_BITS = 12  # relative error of a distinct count about 1.6 %
KLL_SIZE = 800  # error of a quantile's rank about 0.4 %
TRACKED = 4096  # frequent items followed; counts err by at most about a third of rows / TRACKED
IDENTITY = ("ordinal_position", "name", "physical_type", "logical_type")


def _entry(slot: Slot) -> str:
    kind, cell = family(slot.type), slot.sql
    number = f"CAST({cell} AS DOUBLE)" if is_numeric(slot.type) else "CAST(NULL AS DOUBLE)"
    known = f"nullif({number}, double('NaN'))"
    length = f"length({cell})" if isinstance(slot.type, T.StringType) else "CAST(NULL AS INT)"
    key = _key(slot, kind) if kind else "CAST(NULL AS STRING)"
    # a long text is followed by its head and digest, so an item has a bounded size
    shown = cell if isinstance(slot.type, (T.FloatType, T.DateType)) else f"make_valid_utf8({cell})" if isinstance(slot.type, T.BinaryType) else key
    item = "CAST(NULL AS STRING)" if kind in (None, "nested") else f"CAST({shown} AS STRING)"
    if kind == "text":
        item = f"CASE WHEN length({item}) > {HEAD_CHARS} THEN concat(left({item}, {HEAD_CHARS}), sha2({item}, 256)) ELSE {item} END"
    if kind == "floating":
        item = f"CASE WHEN NOT isnan({cell}) AND abs({cell}) < double('infinity') THEN {item} END"
    return f"""{_identity(slot)}, count(1) AS sample_size, count({cell}) AS non_null_count,
        named_struct('min', min({known}), 'max', max({known}), 'mean', avg({number}), 'squares', var_pop({number}) * count({cell}), 'sum', sum({number})) AS number,
        {_times(slot)} AS temporal, named_struct('min', min({length}), 'max', max({length}), 'total', sum({length})) AS lengths,
        hll_sketch_agg(CASE WHEN {key} IS NOT NULL THEN xxhash64({key}) END, {HLL_BITS}) AS distinct_sketch,
        kll_sketch_agg_double({number}, {KLL_SIZE}) AS quantile_sketch, approx_top_k_accumulate({item}, {TRACKED}) AS item_sketch"""


def profile_state(df: DataFrame, columns=None) -> DataFrame:
    """The state of every column of ``df``: one row each. An empty table has states too, with zero counts."""
    return unpivot(df, [_entry(s) for s in slots(df, columns)])


def merge_states(states: DataFrame, keys=()) -> DataFrame:
    """One state per column (and key) from the states of any parts.

    Parts must agree in a column's position and types. Squares are moved to the common mean before they are added, so large means lose
    no digits.
    """
    by = [*keys, *IDENTITY]
    whole = Window.partitionBy(*by)
    counted = F.when(F.col("number.mean").isNotNull(), F.col("non_null_count"))
    centred = states.withColumn("_mean", F.sum(counted * F.col("number.mean")).over(whole) / F.sum(counted).over(whole))
    shifted = "CASE WHEN number.mean IS NOT NULL THEN number.squares + non_null_count * pow(number.mean - _mean, 2) END"
    merged = (
        "sum(sample_size) AS sample_size",
        "sum(non_null_count) AS non_null_count",
        f"named_struct('min', min(number.min), 'max', max(number.max), 'mean', max(_mean), 'squares', sum({shifted}), 'sum', sum(number.sum)) AS number",
        "named_struct('min', min(temporal.min), 'max', max(temporal.max)) AS temporal",
        "named_struct('min', min(lengths.min), 'max', max(lengths.max), 'total', sum(lengths.total)) AS lengths",
        "hll_union_agg(distinct_sketch) AS distinct_sketch",
        "kll_merge_agg_double(quantile_sketch) AS quantile_sketch",
        f"approx_top_k_combine(item_sketch, {TRACKED}) AS item_sketch",
    )
    return centred.groupBy(*by).agg(*[F.expr(e) for e in merged])


def estimated_profile(states: DataFrame, top_limit: int = C.TOP_VALUES, keys=(), fraction: float = 0.5) -> DataFrame:
    """What a profile shows, from states: distinct count, median (or another quantile) and top values are estimates.

    Long texts are shown by their first characters. Equal counts are ordered by number or text.
    """
    nulls, n = "sample_size - non_null_count", "non_null_count"
    spread = f"CASE WHEN {n} = 1 THEN 0.0D WHEN {n} > 1 THEN sqrt(number.squares / ({n} - 1)) END"
    median = f"CASE WHEN kll_sketch_get_n_double(quantile_sketch) > 0 THEN kll_sketch_get_quantile_double(quantile_sketch, {float(fraction)}D) END"
    numeric = {"min": "number.min", "max": "number.max", "mean": "number.mean", "median": median, "std": spread, "sum": "number.sum"}
    # all followed items, so that ties at the end of the list do not depend on the sketch's own order
    items = f"filter(approx_top_k_estimate(item_sketch, {TRACKED}), e -> e.item IS NOT NULL)"
    size = f"try_cast(CASE WHEN logical_type IN ({', '.join(repr(k) for k in NUMERIC)}) THEN e.item END AS DOUBLE)"
    ordered = f"slice(array_sort(transform({items}, e -> struct(-e.count AS back, {size} AS size, e.item AS item))), 1, {top_limit})"
    cell = f"named_struct('value', left(e.item, {HEAD_CHARS}), 'count', -e.back, 'frequency', -e.back / {n})"
    return states.selectExpr(
        *keys,
        *IDENTITY,
        "'full' AS sampling",
        "sample_size",
        n,
        f"{nulls} AS null_count",
        f"CASE WHEN sample_size > 0 THEN ({nulls}) / sample_size ELSE 0.0D END AS null_rate",
        "hll_sketch_estimate(distinct_sketch) AS distinct_count",
        f"CASE WHEN {n} > 0 THEN least(1.0D, hll_sketch_estimate(distinct_sketch) / {n}) ELSE 0.0D END AS distinct_rate",
        f"transform({ordered}, e -> {cell}) AS top_values",
        f"CAST(NULL AS {TOP_TYPE}) AS placeholders",
        "named_struct(" + ", ".join(f"'{k}', {_finite(e)}" for k, e in numeric.items()) + ") AS numeric",
        "temporal",
        f"named_struct('min', lengths.min, 'max', lengths.max, 'mean', lengths.total / {n}) AS string_length",
    )
