"""Admission decisions on a stream of events."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rowassay.operators.events import DECISION, GROUP_TEXT, MICROS, admit

STATE = T.StructType([T.StructField("admitted", T.BinaryType()), T.StructField("waiting", T.BinaryType())])
NO_MOMENTS = np.empty(0, dtype=np.int64)


def admission_stream(
    events: DataFrame, keys: list[str], moment: str, micros: str, tie: str, capacity: int, window_seconds: float, delay: str = "1 hour", buckets: int = 1024
) -> DataFrame:
    """Decide every event of a stream in time order, whatever the order of arrival within ``delay``.

    Events wait in the state of their bucket of keys until the watermark has passed them, so an event that arrives late
    is decided before later ones that arrived earlier. State is, per key, the admitted moments still in
    the window, at most ``capacity`` numbers, and the events of the last ``delay``. A bucket is decided in one call, as one call
    for each key costs far more than its decisions; a task holds one bucket at a time. Decisions therefore come
    ``delay`` behind the newest event; events older than the watermark are dropped by it, and events without a time are never decided.
    """
    if capacity < 1 or window_seconds <= 0:
        raise ValueError("capacity and window_seconds must be positive")
    width = int(window_seconds * MICROS)
    # pandas turns whole numbers with NULLs into doubles, so they travel as 0 and a flag
    whole = [f.name for f in events.schema.fields if isinstance(f.dataType, T.IntegralType)]
    tie_order = [f"_null_{tie}", tie] if tie in whole else [tie]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted, waiting = map(pickle.loads, state.get) if state.exists else ({}, None)
        rows = [] if waiting is None else [waiting]
        if not state.hasTimedOut:
            rows += [b for b in batches if len(b)]
        passed = state.getCurrentWatermarkMs()
        now = later = pd.DataFrame()
        if rows:
            held = pd.concat(rows, ignore_index=True).sort_values(["_group", micros, *tie_order], kind="stable", ignore_index=True)
            ready = held[micros] < passed * 1000
            now, later = held[ready], held[~ready]
        if len(now):
            groups, times, parts = now["_group"].to_numpy(), now[micros].to_numpy(np.int64), []
            starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
            for start, end in zip(starts, [*starts[1:], len(groups)]):
                *decision, admitted[groups[start]] = admit(times[start:end], admitted.get(groups[start], NO_MOMENTS), capacity, width)
                parts.append(decision)
            now = now.drop(columns=["_group", "_bucket"])
            yield now.assign(**{name: np.concatenate([p[position] for p in parts]) for position, (name, _) in enumerate(DECISION)})
        admitted = {group: recent for group, recent in admitted.items() if len(recent) and recent[-1] + width > passed * 1000}
        if len(later) or admitted:
            state.update((pickle.dumps(admitted), pickle.dumps(later if len(later) else None)))
            due = later[micros].min() if len(later) else max(recent[-1] for recent in admitted.values()) + width
            state.setTimeoutTimestamp(max(passed + 1, int(due) // 1000 + 1))
        elif state.exists:
            state.remove()

    group = F.to_json(F.struct(*keys), GROUP_TEXT)
    marked = events.where(F.col(micros).isNotNull()).withWatermark(moment, delay).withColumn("_group", group).withColumn("_bucket", F.pmod(F.xxhash64("_group"), F.lit(buckets)))
    marked = marked.withColumns({f"_null_{c}": F.col(c).isNull() for c in whole}).withColumns({c: F.coalesce(c, F.lit(0).cast(events.schema[c].dataType)) for c in whole})
    made = T.StructType([f for f in marked.schema.fields if f.name not in ("_group", "_bucket")])
    out = marked.groupBy("_bucket").applyInPandasWithState(run, T.StructType([*made.fields, *[T.StructField(n, t) for n, t in DECISION]]), STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.when(~F.col(f"_null_{c}"), F.col(c)).alias(c) if c in whole else c for c in events.columns], *[n for n, _ in DECISION])
