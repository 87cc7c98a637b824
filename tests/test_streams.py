"""Streams over several micro-batches give what the batch forms give."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docket.operators import caselog as batch
from docket.streaming import caselog as stream

SCHEMA = "event_id long, case_id long, stage int, action string, second long"


def files(spark, path, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, SCHEMA)
        df.withColumn("ts", F.timestamp_seconds(F.col("second") + 1_700_000_000)).drop("second").coalesce(1).write.mode("append").parquet(path)
    return stream.file_stream(spark, path, files_per_trigger=1)


def dead_in_batch(spark, path):
    return {r["event_id"] for r in batch.dead_runs(spark.read.parquet(path), 20).where("dead").collect()}


def test_late_finish_does_not_close_a_newer_run(spark, tmp_path):
    """Starts at minutes 0 and 25; the finish of minute 24.5 comes in the next file."""
    path = f"{tmp_path}/e"
    live = files(spark, path, [[(1, 1, 1, "start", 0), (2, 1, 1, "start", 1500)], [(3, 1, 1, "done", 1470)], [(4, 9, 1, "done", 90_000)]])
    got = {r["event_id"] for r in stream.drain(stream.dead_runs(live, 20, "1 hour")).collect()}
    assert got == dead_in_batch(spark, path) == {1, 2}


def test_out_of_order_events_equal_batch(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, int(rng.integers(0, 5)), int(rng.integers(1, 3)), str(rng.choice(["start", "start", "done", "failed", "note"])), i * 240 + int(rng.integers(-1500, 1500))) for i in range(240)]
    rows += [(1000, 1, 1, "start", 20_000), (1001, 1, 1, "done", 20_000 + 1200), (1002, 1, 2, "start", 20_000), (1003, 1, 2, "done", 20_000 + 1201)]
    rows.sort(key=lambda r: r[0])
    path = f"{tmp_path}/e"
    live = files(spark, path, [rows[:80], rows[80:160], rows[160:], [(9000, 77, 1, "done", 400_000)]])
    late: list[int] = []
    got = [r["event_id"] for r in stream.drain(stream.dead_runs(live, 20, "1 day"), late=late).collect()]
    assert len(got) == len(set(got)) and set(got) == dead_in_batch(spark, path)
    assert late == [0]


def test_sessions_and_sliding_windows_drop_replays(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(0, 4)), 1, str(rng.choice(["a", "b"])), int(rng.integers(0, 40_000))) for i in range(150)]
    path = f"{tmp_path}/e"
    live = files(spark, path, [rows[:70], rows[40:110], rows[100:], [(9000, 99, 1, "a", 900_000)]])
    once = spark.read.parquet(path).dropDuplicates(["event_id"]).where("event_id < 9000")
    rows_of = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows_of(stream.drain(stream.session_counts(live, "30 minutes", "1 day"))) == rows_of(batch.sessions(once, "30 minutes"))
    assert rows_of(stream.drain(stream.sliding_counts(live, "3 hours", "1 hour", "1 day"))) == rows_of(batch.counts_over_time(once, "3 hours", "1 hour"))


def test_late_rows_are_counted(spark, tmp_path):
    live = files(spark, f"{tmp_path}/e", [[(1, 1, 1, "a", 100_000)], [(3, 1, 1, "a", 100_100)], [(2, 1, 1, "a", 100)], [(4, 2, 1, "a", 900_000)]])
    late: list[int] = []
    got = stream.drain(stream.session_counts(live, "30 minutes", "1 minute"), late=late).collect()
    assert [r["n"] for r in got] == [2] and late == [1]


def test_starts_are_judged_in_buckets(spark, tmp_path, monkeypatch):
    """Python was called for every case's stage in each batch: 137 seconds for 198,630 starts of 75,000 stages."""
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(0, 40)), int(rng.integers(1, 4)), "start", i * 60 + int(rng.integers(-1500, 1500))) for i in range(600)]
    odd = [(700, None, 1, "start", 100), (701, None, 1, "start", 700), (702, 0, 1, "start", 90), (703, 0, None, "start", 95), (2**60 + 1, 0, None, "start", 4000), (704, 0, 1, "start", None)]
    path = f"{tmp_path}/e"
    # the last start is the only one of its stage and nothing comes after it
    live = files(spark, path, [odd + rows[:200], rows[200:400], rows[400:], [(9000, 77, 1, "start", 400_000)]])
    calls = spark.sparkContext.accumulator(0)
    kind, plain = type(live.groupBy()), type(live.groupBy()).applyInPandasWithState

    def counted(self, func, *rest):
        def run(key, batches, state):
            calls.add(1)
            yield from func(key, batches, state)

        return plain(self, run, *rest)

    monkeypatch.setattr(kind, "applyInPandasWithState", counted)
    monkeypatch.setattr(stream, "BUCKETS", 3, raising=False)
    got = [(r["event_id"], r["case_id"], r["stage"], r["accepted"]) for r in stream.drain(stream.accepted_starts(live, 20, "1 day")).collect()]
    # starts without a case are one case's
    rows_in = spark.read.parquet(path).where("ts is not null and event_id <> 9000").withColumn("case_id", F.coalesce("case_id", F.lit(-1)))
    whole = [(r["event_id"], None if r["case_id"] == -1 else r["case_id"], r["stage"], r["accepted"]) for r in batch.accepted_starts(rows_in, 20).collect()]
    assert sorted(map(str, got)) == sorted(map(str, whole)) and len(got) == 605
    assert calls.value < 40


def test_the_last_start_of_all_is_judged(spark, tmp_path):
    live = files(spark, f"{tmp_path}/e", [[(1, 1, 1, "start", 100), (2, 2, 1, "start", 900)]])
    got = {r["event_id"]: r["accepted"] for r in stream.drain(stream.accepted_starts(live, 20, "0 seconds")).collect()}
    assert got == {1: True, 2: True}
