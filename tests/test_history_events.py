"""Histories, listings, event operators and streams, against plain Python where SQL is no check."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowassay.operators import events as ev, history
from rowassay.streaming.admission import admission_stream
from rowassay.streaming.summary import event_summary_stream

WINDOW = 60


def hot_log(seed=11, size=4000):
    """One key owns most of the events; some moments repeat, some spells are quiet."""
    rng = random.Random(seed)
    rows, now = [], 1_700_000_000_000_000
    for i in range(size):
        now += rng.choice([0, 1, 500_000, 3_000_000, 20_000_000]) if rng.random() > 0.01 else 400_000_000
        rows.append((i, "hot" if rng.random() < 0.8 else f"k{rng.randint(0, 5)}", now))
    return rows


def log_frame(spark, rows):
    return spark.createDataFrame(rows, "event_id bigint, client string, micros bigint")


def decisions(rows, capacity, seconds):
    seen, out, width = defaultdict(list), {}, seconds * ev.MICROS
    for event, client, moment in sorted(rows, key=lambda r: (r[2], r[0])):
        live = seen[client] = [t for t in seen[client] if t > moment - width]
        if len(live) < capacity:
            live.append(moment)
            out[event] = (True, 0, len(live))
        else:
            out[event] = (False, max(1, -(-(live[0] + width - moment) // ev.MICROS)), len(live))
    return out


@pytest.mark.parametrize("stretch", [1, 4, 64])
def test_sliding_usage(spark, stretch):
    rows = hot_log()
    got = {r.event_id: r.used for r in ev.sliding_usage(log_frame(spark, rows), ["client"], "micros", WINDOW, stretch).collect()}
    moments = defaultdict(list)
    for _, client, t in rows:
        moments[client].append(t)
    want = {i: sum(t - WINDOW * ev.MICROS < u <= t for u in moments[c]) for i, c, t in rows}
    assert got == want


@pytest.mark.parametrize("capacity,stretch", [(1, 1), (3, 1), (3, 8), (20, 4)])
def test_admission(spark, capacity, stretch):
    rows = hot_log(seed=capacity)
    got = ev.admission(log_frame(spark, rows), ["client"], "micros", "event_id", capacity, WINDOW, stretch).collect()
    assert {r.event_id: (r.allowed, r.retry_after_seconds, r.used) for r in got} == decisions(rows, capacity, WINDOW)


def test_busy_key_is_cut_into_segments(spark):
    segments = ev._segments(log_frame(spark, hot_log()), ["client"], "micros", 2, WINDOW * ev.MICROS, 1)
    assert segments.where("client = 'hot'").select("segment").distinct().count() > 10


def test_three_calls_at_once(spark):
    got = ev.admission(log_frame(spark, [(i, "a", 5) for i in range(3)]), ["client"], "micros", "event_id", 2, 1.0).orderBy("event_id").collect()
    assert [r.allowed for r in got] == [True, True, False] and got[2].retry_after_seconds >= 1 and got[2].used == 2


@pytest.mark.parametrize("capacity,seconds", [(0, 1.0), (1, 0.0), (1, -1.0)])
def test_admission_arguments(spark, capacity, seconds):
    with pytest.raises(ValueError):
        ev.admission(log_frame(spark, [(1, "a", 5)]), ["client"], "micros", "event_id", capacity, seconds)


def test_event_summary(spark):
    df = spark.createDataFrame([(10.0, "/a", 200), (20.0, "/a", 200), (30.0, "/b", 500)], "ms double, path string, status int")
    assert tuple(ev.event_totals(df, "ms").first()) == (3, 20.0, 10.0, 30.0)
    counts = {(r.axis, r.bucket): r.event_count for r in ev.event_counts(df, "status", "path").collect()}
    assert counts == {("status", "200"): 2, ("status", "500"): 1, ("path", "/a"): 2, ("path", "/b"): 1}
    assert tuple(ev.event_totals(df.limit(0), "ms").first()) == (0, 0.0, 0.0, 0.0)


def run_stream(stream, path):
    job = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    job.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_streams_over_several_batches(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, "a" if i % 3 else "b", start + timedelta(minutes=7 * i), float(i)) for i in range(600)]
    schema = "event_id bigint, client string, ts timestamp, ms double"
    for part in range(3):
        spark.createDataFrame(rows[part * 200 : part * 200 + 200], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    # Files are read in the order of their modification times: one micro-batch each.
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run_stream(event_summary_stream(source, "ts", ["client"], "ms", "1 hour", "10 minutes"), f"{tmp_path}/a")
    got = spark.read.parquet(f"{tmp_path}/a/out")
    closed = rows[-1][2] - timedelta(minutes=10)
    want = defaultdict(int)
    for _, client, ts, _ms in rows:
        hour = ts.replace(minute=0, second=0)
        if hour + timedelta(hours=1) <= closed:
            want[hour, client] += 1
    assert {(r.window_start, r.client): r.total for r in got.collect()} == dict(want)
    marked = source.withColumn("micros", F.unix_micros("ts"))
    end = rows[-1][2] + timedelta(days=2)  # closes the stream: what waits is decided once time has passed it
    spark.createDataFrame([(-1, "end", end, 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run_stream(admission_stream(marked, ["client"], "ts", "micros", "event_id", 2, 1200, "1 day"), f"{tmp_path}/b")
    decided = spark.read.parquet(f"{tmp_path}/b/out").collect()
    micros = [(i, c, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))) for i, c, t, _ in rows]
    assert {r.event_id: (r.allowed, r.retry_after_seconds, r.used) for r in decided} == decisions(micros, 2, 1200)


def test_late_events_are_decided_in_time_order(spark, tmp_path):
    schema = "event_id bigint, client string, ts timestamp, ms double"
    start = datetime(2024, 1, 1)
    for i, second in enumerate((10, 20, 12, 23, 9999)):  # 12 arrives after 20
        spark.createDataFrame([(i, "a", start + timedelta(seconds=second), 0.0)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("micros", F.unix_micros("ts"))
    run_stream(admission_stream(source, ["client"], "ts", "micros", "event_id", 2, 10, "1 minute"), f"{tmp_path}/b")
    got = {r.event_id: r.allowed for r in spark.read.parquet(f"{tmp_path}/b/out").collect()}
    assert got == {0: True, 1: True, 2: True, 3: True}


def test_admission_stream_decides_many_keys_in_one_call(spark, tmp_path):
    schema, start, big = "event_id bigint, client string, ts timestamp, ms double", datetime(2024, 1, 1), 2**53 + 1
    rows = [(None if i == 7 else big + i, None if i % 50 == 3 else f"c{i % 50}", None if i == 9 else start + timedelta(seconds=i), 0.0) for i in range(400)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").withColumn("micros", F.unix_micros("ts"))
    stream = admission_stream(source, ["client"], "ts", "micros", "event_id", 2, 120, "0 seconds", buckets=4)
    job = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state")
    query = job.outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert 0 < max(p.stateOperators[0].numRowsTotal for p in query.recentProgress) <= 4
    timed = [(i, c, int((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))) for i, c, t, _ in rows if t is not None and t < rows[-1][2]]
    assert {r.event_id: (r.allowed, r.retry_after_seconds, r.used) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == decisions(timed, 2, 120)


def test_admission_null_keys_and_times(spark):
    rows = [(1, None, 5), (2, None, 6), (3, "a", 7), (4, None, 8), (5, "a", None)]
    got = {r.event_id: (r.allowed, r.used) for r in ev.admission(log_frame(spark, rows), ["client"], "micros", "event_id", 2, 1.0).collect()}
    assert got == {1: (True, 1), 2: (True, 2), 3: (True, 1), 4: (False, 2), 5: (False, None)}


def test_hot_key_without_quiet_spell_is_cut(spark):
    rows = [(i, "hot", i * 600_000) for i in range(2000)]  # never a second without an event
    frame = log_frame(spark, rows)
    assert ev._segments(frame, ["client"], "micros", 4, ev.MICROS, 16).select("segment").distinct().count() > 10
    got = {r.event_id: (r.allowed, r.retry_after_seconds, r.used) for r in ev.admission(frame, ["client"], "micros", "event_id", 4, 1.0).collect()}
    assert got == decisions(rows, 4, 1)


VERSIONS = "dataset_id string, version_number bigint"


def test_lineage(spark):
    df = spark.createDataFrame([("t", 3), ("t", 1), ("t", 2), ("single", 1)], VERSIONS)
    for pieces in (1, 2, 16):
        got = sorted((r.dataset_id, r.from_version_number, r.to_version_number) for r in history.lineage(df, pieces=pieces).collect())
        assert got == [("t", 1, 2), ("t", 2, 3)]
    assert history.lineage(df.limit(0)).count() == 0


@pytest.mark.parametrize("pieces", [2, 7, 40])
def test_stretches_change_nothing(spark, pieces):
    rng = random.Random(pieces)
    keys = [None if rng.random() < 0.2 else "hot" if rng.random() < 0.7 else f"d{rng.randint(0, 9)}" for _ in range(800)]
    rows = [(k, n, rng.random()) for k, n in zip(keys, rng.sample(range(100_000), 800))] + [("hot", None, 0.5), (None, None, 0.25)]
    df = spark.createDataFrame(rows, "dataset_id string, n bigint, score double")
    cut = history.score_changes(df, ["dataset_id"], ["n"], pieces).select("dataset_id", "n", "score_delta").collect()
    want = []
    for key in set(keys):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: -1 if r[1] is None else r[1])
        want += [(key, n, score - own[i - 1][2] if i else 0.0) for i, (_, n, score) in enumerate(own)]
    assert Counter(map(tuple, cut)) == Counter(want)


def test_latest_and_trend(spark):
    rows = [("a", i, float(i)) for i in range(40)] + [("b", 1, 50.0)]
    df = spark.createDataFrame(rows, "dataset_id string, n int, score double")
    assert {r.dataset_id: r.score for r in history.latest_per_key(df, ["dataset_id"], ["n"]).collect()} == {"a": 39.0, "b": 50.0}
    assert {r.dataset_id: r.trend for r in history.score_trend(df, ["dataset_id"], ["n"]).collect()} == {"a": 23.0, "b": 0.0}
    assert [r.score for r in history.worst_scores(df, ["dataset_id"], ["n"]).collect()] == [39.0, 50.0]


def test_pages(spark):
    page = history.page_of(spark.range(45), [F.desc("id")], 3, 20).collect()
    assert [r.id for r in page] == [4, 3, 2, 1, 0] and (page[0].total_items, page[0].total_pages) == (45, 3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    df = spark.createDataFrame([("a", 1, 1.0)], "dataset_id string, n int, score double").repartition(3)
    assert "WindowGroupLimit" in plan_of(history.newest_scores(df, ["dataset_id"], ["n"], 7))
    assert "TakeOrderedAndProject" in plan_of(history.page_of(df, [F.desc("n")], 2, 5))
    assert "Window" not in plan_of(history.latest_per_key(df, ["dataset_id"], ["n"]))


def test_neighbours_of_any_order_type(spark):
    """Text labels, moments, NULL labels and keys; one key owns most rows; against sorting in Python."""
    rng = random.Random(9)
    rows = [(rng.choice(("hot", "hot", "hot", "b", None)), None if i == 17 else f"v{rng.randint(0, 10**9):x}", float(i)) for i in range(900)]
    df = spark.createDataFrame(rows, "dataset_id string, version_number string, score double").repartition(5)
    groups = defaultdict(list)
    for key, label, score in rows:
        groups[key].append((label is not None, label or "", score))
    edges, deltas = set(), {}
    for key, own in groups.items():
        own.sort()
        label = lambda r: r[1] if r[0] else None
        edges |= {(key, label(a), label(b)) for a, b in zip(own, own[1:])}
        deltas |= {r[2]: r[2] - p[2] if p else 0.0 for p, r in zip([None, *own], own)}
    for pieces in (2, 16):
        assert {tuple(r) for r in history.lineage(df, pieces=pieces).collect()} == edges
        assert {r.score: r.score_delta for r in history.score_changes(df, ["dataset_id"], ["version_number"], pieces).collect()} == deltas
    dated = df.withColumn("version_number", F.timestamp_seconds("score"))
    assert history.lineage(dated).count() == 900 - len(groups)
    assert history.lineage(df.limit(0)).collect() == []
