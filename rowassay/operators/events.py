"""Event logs: summaries, sliding usage counts and admission decisions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F, types as T

from rowassay.functions.joins import join_null_safe

MICROS = 1_000_000


def event_totals(events: DataFrame, duration: str) -> DataFrame:
    """Number of events and mean, least and greatest duration, three decimals, 0 when empty."""
    zero = F.lit(0.0)
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.bround(F.coalesce(f(duration), zero), 3).alias(n) for f, n in ((F.avg, "average"), (F.min, "least"), (F.max, "greatest"))],
    )


def event_counts(events: DataFrame, *dimensions: str) -> DataFrame:
    """Events per value of each dimension, such as status and path, in one aggregation."""
    sets = [[F.col(d)] for d in dimensions]
    grouped = events.groupingSets(sets, *[F.col(d) for d in dimensions]).agg(
        F.count(F.lit(1)).alias("event_count"), *[F.grouping(d).alias(f"_{d}") for d in dimensions]
    )
    axis = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.lit(d)) for d in dimensions])
    bucket = F.coalesce(*[F.when(F.col(f"_{d}") == 0, F.col(d).cast("string")) for d in dimensions])
    return grouped.select(axis.alias("axis"), bucket.alias("bucket"), "event_count")


def _floor_div(value: str, unit: int) -> str:
    return f"(({value} - pmod({value}, {unit})) div {unit})"


def sliding_usage(events: DataFrame, keys: list[str], micros: str, window_seconds: float, stretch_windows: int = 16) -> DataFrame:
    """Add ``used``: events of the same key in (t - window, t].

    Each key's time line is cut into stretches of ``stretch_windows`` windows. An event also goes to
    the next stretch when that one's first window can still see it, so every stretch counts on its own
    and a key that owns a third of all events is spread over as many tasks as it has stretches.
    """
    width = int(window_seconds * MICROS)
    span = width * stretch_windows
    own = _floor_div(micros, span)
    seen_later = f"{micros} > ({own} + 1) * {span} - {width}"
    copies = f"array_compact(array(struct({own} AS stretch, false AS halo), CASE WHEN {seen_later} THEN struct({own} + 1 AS stretch, true AS halo) END))"
    rows = events.select("*", F.expr(f"inline({copies})"))
    window = Window.partitionBy(*keys, "stretch").orderBy(micros).rangeBetween(-(width - 1), 0)
    return rows.withColumn("used", F.count(F.lit(1)).over(window)).where(~F.col("halo")).drop("stretch", "halo")


GROUP_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _segments(events: DataFrame, keys: list[str], micros: str, capacity: int, width: int, stretch_windows: int) -> DataFrame:
    """Add ``segment`` and ``halo``: runs of a key's time line that can be decided apart from each other.

    Where the two windows before a stretch hold at most ``capacity`` events, all events of the last of them
    were admitted, whatever came earlier. The stretch then starts a new segment, which gets those
    events once more, marked as halo. Only counts per stretch are put in order, not events. A stretch has
    two windows at least.
    """
    stretch_windows = max(2, stretch_windows)
    span = width * stretch_windows
    own = _floor_div(micros, span)
    late = f"{micros} > ({own} + 1) * {span} - {width}"
    copies = f"array_compact(array(struct({own} AS stretch, false AS halo), CASE WHEN {late} THEN struct({own} + 1 AS stretch, true AS halo) END))"
    by_key = Window.partitionBy(*keys).orderBy("stretch")
    crowd = F.count_if(F.col(micros) > (F.col("stretch") + 1) * span - 2 * width)
    marks = (
        events.withColumn("stretch", F.expr(own)).groupBy(*keys, "stretch").agg(crowd.alias("crowd"))
        .withColumn("fresh", (F.lag("stretch").over(by_key) != F.col("stretch") - 1) | (F.lag("crowd").over(by_key) <= capacity))
        .withColumn("fresh", F.coalesce("fresh", F.lit(True)))
        .withColumn("segment", F.sum(F.col("fresh").cast("int")).over(by_key))
    )
    rows = events.select("*", F.expr(f"inline({copies})"))
    return join_null_safe(rows, marks.drop("crowd"), [*keys, "stretch"]).where("NOT halo OR fresh").drop("stretch", "fresh")


def admit(times: np.ndarray, earlier: np.ndarray, capacity: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decisions on the sorted ``times`` of one segment, after the moments ``earlier`` were admitted.

    A full window opens again ``width`` after the moment that came ``capacity`` admissions before, so the next
    admitted event is found by bisection, and denied events are never visited. Returns whether each is
    admitted, the seconds to wait, the admitted events in its window, and the moments to carry on.
    """
    kept, at = list(earlier[-capacity:]), 0
    places: list[int] = []
    while at < len(times):
        if len(kept) >= capacity:
            at = max(at, int(np.searchsorted(times, kept[-capacity] + width)))
            if at == len(times):
                break
        kept.append(times[at])
        places.append(at)
        at += 1
    known = np.asarray(kept, dtype=np.int64)
    before = len(known) - len(places)
    allowed = np.zeros(len(times), dtype=bool)
    allowed[places] = True
    gone = np.searchsorted(known, times - width, side="right")  # admitted, but out of the window by now
    used = before + np.cumsum(allowed) - gone
    opens = known[np.minimum(gone, max(len(known) - 1, 0))] + width - times if len(known) else np.zeros(len(times), dtype=np.int64)
    wait = np.where(allowed, 0, np.maximum(1, np.ceil(opens / MICROS).astype(np.int64)))
    return allowed, wait, used, known[-capacity:]


DECISION = (("allowed", T.BooleanType()), ("retry_after_seconds", T.LongType()), ("used", T.LongType()))


def decided(events: DataFrame) -> T.StructType:
    return T.StructType([*events.schema.fields, *[T.StructField(n, t) for n, t in DECISION]])


def admission(
    events: DataFrame, keys: list[str], micros: str, tie: str, capacity: int, window_seconds: float, stretch_windows: int = 16
) -> DataFrame:
    """Admit an event while fewer than ``capacity`` admitted ones lie in its window (E2, batch form).

    Denied events are not recorded, so each decision needs the ones before it. Rows are sorted by Spark
    (spilling as needed) and streamed through each task in Arrow batches; a task remembers at most
    ``capacity`` moments. Quiet spells cut even a single busy key into segments of their own. A NULL key is a
    key; an event without a time is not admitted, and its other results are NULL.
    """
    if capacity < 1 or window_seconds <= 0:
        raise ValueError("capacity and window_seconds must be positive")
    width = int(window_seconds * MICROS)
    schema = decided(events)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, recent = None, np.empty(0, dtype=np.int64)
        for batch in batches:
            groups, times, halo = batch["_group"].to_numpy(), batch[micros].to_numpy(np.int64), batch["halo"].to_numpy(bool)
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            parts = []
            for start, end in zip(starts, [*starts[1:], len(groups)]):
                if groups[start] != current:
                    current, recent = groups[start], np.empty(0, dtype=np.int64)
                own = slice(start + int(halo[start:end].sum()), end)  # halo events come first
                recent = np.r_[recent, times[start : own.start]]
                *decision, recent = admit(times[own], recent, capacity, width)
                parts.append(decision)
            out = batch[~halo].drop(columns=["_group", "halo"])
            for position, (name, _) in enumerate(DECISION):
                out[name] = np.concatenate([p[position] for p in parts])
            yield out

    timed = events.where(F.col(micros).isNotNull())
    grouped = _segments(timed, keys, micros, capacity, width, stretch_windows)
    grouped = grouped.select(*events.columns, "halo", F.to_json(F.struct(*keys, "segment"), GROUP_TEXT).alias("_group"))
    ordered = grouped.repartition("_group").sortWithinPartitions("_group", micros, tie)
    none = [F.lit(False if n == "allowed" else None).cast(t).alias(n) for n, t in DECISION]
    return ordered.mapInPandas(run, schema).unionByName(events.where(F.col(micros).isNull()).select("*", *none))
