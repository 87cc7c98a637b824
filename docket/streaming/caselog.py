"""Structured Streaming forms of the case log's work, and the resumable load.

Event time comes from ``ts``; state is bounded by watermarks and timers. Each
runs on any streaming source; ``drain`` works a source off and stops, so a batch
of files can be held against the batch form.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docket.operators.caselog import DEAD_MINUTES
from docket.session import scratch_root

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Groups that hold the states of ``accepted_starts``. A stream's checkpoint keeps to the number that it began with.
BUCKETS = 1024
WAITING = np.dtype([("us", "i8"), ("event_id", "i8"), ("case_id", "i8"), ("stage", "i4"), ("missing", "i4")])
LAST = np.dtype([("case_id", "i8"), ("stage", "i4"), ("missing", "i4"), ("us", "i8")])


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 4) -> DataFrame:
    """A Parquet table as a stream of its files.

    Streams read folders and globs; the last character as a class makes a glob
    that fits this name and no other, be it a file or a folder.
    """
    schema = spark.read.parquet(path).schema
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path[:-1]}[{path[-1]}]")


def drain(stream: DataFrame, mode: str = "append", checkpoint: str | None = None, out: str | None = None, late: list[int] | None = None) -> DataFrame:
    """Works off what is there, writes it to ``out`` and gives it as a table.

    With the same checkpoint and ``out`` a later call takes up where this ended.
    Complete mode replaces the table each time. The number of rows that came too
    late for the watermark is added to ``late``.
    """
    spark = stream.sparkSession
    root = f"{scratch_root(spark)}/stream-{uuid.uuid4().hex}"
    checkpoint, out = checkpoint or f"{root}/checkpoint", out or f"{root}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, epoch: df.write.mode("overwrite").parquet(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if late is not None:
        late.append(sum(op.numRowsDroppedByWatermark for p in q.recentProgress for op in p.stateOperators))
    return spark.read.schema(stream.schema).parquet(out)


def resumable_load(spark: SparkSession, path: str, out: str, checkpoint: str, files_per_trigger: int = 4) -> DataFrame:
    """Loads a table's files, some at a time; the checkpoint is the offset. A stopped load goes on with the next call."""
    return drain(file_stream(spark, path, files_per_trigger), "append", checkpoint, out)


def counts(events: DataFrame, length: str = "1 hour", late: str = "7 days") -> DataFrame:
    """(window_start, action, n) as the stream goes; later than ``late`` is dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", length), "action").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "action", "n")


def latency(starts: DataFrame, finishes: DataFrame, minutes: int, late: str = "1 day") -> DataFrame:
    """(start_id, finish_id, seconds): inner interval join of two streams of a case's stage."""
    s = starts.select(F.col("case_id"), F.col("stage"), F.col("event_id").alias("start_id"), F.col("ts").alias("started")).withWatermark("started", late)
    f = finishes.select(F.col("case_id").alias("f_case"), F.col("stage").alias("f_stage"), F.col("event_id").alias("finish_id"), F.col("ts").alias("finished")).withWatermark("finished", late)
    near = (F.col("case_id") == F.col("f_case")) & (F.col("stage") == F.col("f_stage")) & (F.col("finished") >= F.col("started")) & (F.col("finished") <= F.col("started") + F.expr(f"INTERVAL {minutes} MINUTES"))
    out = s.join(f, near)
    return out.select("start_id", "finish_id", (F.unix_timestamp("finished") - F.unix_timestamp("started")).alias("seconds"))


def accepted_starts(starts: DataFrame, minutes: int = DEAD_MINUTES, late: str = "1 day") -> DataFrame:
    """(case, stage, event_id, ts, accepted): a start within ``minutes`` of the last that counted is ignored.

    Starts wait until the watermark (``late`` behind the newest) has passed them
    and are then judged in the order of event time, so their order of arrival
    doesn't matter; later ones are dropped, and so are those without a time. A
    case's stage has its waiting starts and the last that counted as state, which ends
    once any start to come would count. The stages' states are held in BUCKETS by
    hash, so that calls of Python grow with the buckets and not with the cases.
    """
    wait = minutes * 60 * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, last = (np.frombuffer(x, kind) for x, kind in zip(state.get, (WAITING, LAST), strict=True)) if state.exists else (np.empty(0, WAITING), np.empty(0, LAST))
        if not state.hasTimedOut:
            new = [waiting]
            for batch in batches:
                rows = np.empty(len(batch), WAITING)
                for c in WAITING.names:
                    rows[c] = batch[c].to_numpy()
                new.append(rows)
            waiting = np.concatenate(new)
        passed = state.getCurrentWatermarkMs()
        at = waiting["us"] // 1000
        ripe = at <= passed if state.hasTimedOut else at < passed
        due, waiting = waiting[ripe], waiting[~ripe]
        due = due[np.lexsort((due["event_id"], due["us"], due["missing"], due["stage"], due["case_id"]))]
        counted = {(c, s, m): t for c, s, m, t in last.tolist()}
        keep = []
        for t, _, *stage in due.tolist():
            before = counted.get(at_stage := tuple(stage))
            fine = before is None or t - before > wait * 1000
            keep.append(fine)
            if fine:
                counted[at_stage] = t
        last = np.array([(*k, t) for k, t in counted.items() if t // 1000 + wait >= passed], LAST)
        if len(waiting) or len(last):
            state.update((waiting.tobytes(), last.tobytes()))
            # a start is ripe once its millisecond is reached
            never = np.iinfo(np.int64).max
            ends = min(waiting["us"].min(initial=never) // 1000 - 1, last["us"].min(initial=never) // 1000 + wait)
            state.setTimeoutTimestamp(int(max(ends, passed + 1)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({c: due[c] for c in WAITING.names} | {"accepted": keep})

    marked = starts.withWatermark("ts", late).where("ts is not null")
    bits = [(1, "case_id"), (2, "stage"), (4, "event_id")]
    missing = sum((F.when(F.col(c).isNull(), bit).otherwise(0) for bit, c in bits), F.lit(0))
    # numbers without nulls, and the time as one, so that no float and no time zone comes in
    rows = marked.select("ts", F.unix_micros("ts").alias("us"), *[F.coalesce(F.col(c).cast(kind), F.lit(0).cast(kind)).alias(c) for c, kind in (("event_id", "long"), ("case_id", "long"), ("stage", "int"))], missing.alias("missing"), F.pmod(F.xxhash64("case_id", "stage"), F.lit(BUCKETS)).alias("bucket"))
    told = rows.groupBy("bucket").applyInPandasWithState(run, "us long, event_id long, case_id long, stage int, missing int, accepted boolean", "waiting binary, last binary", "append", GroupStateTimeout.EventTimeTimeout)
    there = {c: F.when(F.col("missing").bitwiseAND(F.lit(bit)) == 0, F.col(c)).alias(c) for bit, c in bits}
    return told.select(there["case_id"], there["stage"], there["event_id"], F.timestamp_micros("us").alias("ts"), "accepted")


def dead_runs(events: DataFrame, minutes: int = DEAD_MINUTES, late: str = "1 minute") -> DataFrame:
    """(case_id, stage, event_id, started, dead_at): each start without a finish within ``minutes`` in event time.

    A finish is a done or failed event of the same case's stage after the start; it
    ends all runs before it, as in the batch form, whatever the order of arrival. It
    is an outer join of starts and finishes by whole seconds: a start without one is
    given when the watermark has passed its limit, and state ends with that limit.
    Rows that come later than ``late`` are dropped.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    limit = F.expr(f"INTERVAL {minutes * 60} SECONDS")
    kept = events.where(F.col("action").isin("start", "done", "failed"))
    marked = kept.withColumns({"us": F.unix_micros("ts"), "at": F.timestamp_seconds(F.unix_seconds("ts"))}).withWatermark("at", late)

    def side(name: str, which: Column) -> DataFrame:
        # the filter names the time, so that it stays above the watermark, which starts and finishes share
        rows = marked.where(F.when(which, F.col("at")).isNotNull())
        return rows.select(*[F.col(c).alias(f"{name}_{c}") for c in ("case_id", "stage", "event_id", "us", "at")])

    same = (F.col("s_case_id") == F.col("f_case_id")) & (F.col("s_stage") == F.col("f_stage"))
    within = (F.col("f_at") >= F.col("s_at")) & (F.col("f_at") <= F.col("s_at") + limit)
    after = (F.col("f_us") > F.col("s_us")) | ((F.col("f_us") == F.col("s_us")) & (F.col("f_event_id") > F.col("s_event_id")))
    told = side("s", F.col("action") == "start").join(side("f", F.col("action") != "start"), same & within & after, "left").where(F.col("f_event_id").isNull())
    started = F.timestamp_micros("s_us")
    return told.select(*[F.col(f"s_{c}").alias(c) for c in ("case_id", "stage", "event_id")], started.alias("started"), (started + F.expr(f"INTERVAL {minutes} MINUTES")).alias("dead_at"))


def once(events: DataFrame, late: str, key: str = "event_id") -> DataFrame:
    """``events`` with the watermark, and rows that are sent again within it dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(case_id, session_start, session_end, n) of sessions that the watermark has passed; replayed events count once."""
    out = once(events, late).groupBy("case_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("case_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def sliding_counts(events: DataFrame, length: str = "3 hours", slide: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window_start, action, n) of sliding windows that the watermark has passed; replayed events count once."""
    out = once(events, late).groupBy(F.window("ts", length, slide), "action").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "action", "n")
