"""Sources, sinks, streams and the entry point."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from docket.sources import corpus
from docket.streaming import caselog as stream


def test_scan_files(spark, tmp_path):
    (tmp_path / "law" / "sub").mkdir(parents=True)
    (tmp_path / "law" / "a.txt").write_text("one\ntwo")
    (tmp_path / "law" / "sub" / "b.txt").write_text("three")
    (tmp_path / "law" / "c.pdf").write_text("no")
    assert sorted(map(tuple, corpus.scan_files(spark, str(tmp_path), "law").collect())) == [("a.txt", "one\ntwo"), ("b.txt", "three")]


def test_delete_has_a_cap(spark):
    df = spark.range(600).withColumn("k", F.lit("x"))
    with pytest.raises(ValueError):
        corpus.delete_where(df, "k", "x", dry_run=False)
    kept, n = corpus.delete_where(df, "k", "y", dry_run=False)
    assert (kept.count(), n) == (600, 0)


def test_resume_goes_on(spark, tmp_path):
    src, args = f"{tmp_path}/in", (f"{tmp_path}/out", f"{tmp_path}/cp")
    spark.range(10).write.parquet(src)
    assert stream.resumable_load(spark, src, *args).count() == 10
    spark.range(10, 15).write.mode("append").parquet(src)
    assert stream.resumable_load(spark, src, *args).count() == 15


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    known = entry.queries()
    assert len(known) > 150 and set(entry.oracle_sql()) <= set(known)


def _starts(spark, path, batches):
    for rows in batches:
        df = spark.createDataFrame(rows, "event_id long, case_id long, stage int, minute long")
        df.select("event_id", "case_id", "stage", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("ts")).coalesce(1).write.mode("append").parquet(path)


def test_starts_across_batches_and_out_of_order(spark, tmp_path):
    """Several files, rows of one case in the wrong order: the stream judges as the batch form does."""
    from docket.operators import caselog as batch

    files = [
        [(1, 1, 1, 0), (2, 1, 1, 50), (3, 2, 1, 5)],
        [(4, 1, 1, 10), (5, 1, 1, 30), (6, 2, 1, 100)],
        [(7, 1, 1, 95), (8, 2, 1, 110), (9, 1, 2, 96)],
        [(10, 9, 9, 100_000)],  # moves the watermark past all others
    ]
    path = f"{tmp_path}/starts"
    _starts(spark, path, files)
    live = stream.file_stream(spark, path, files_per_trigger=1)
    got = {r.event_id: r.accepted for r in stream.drain(stream.accepted_starts(live, 20, "2 hours")).collect()}
    want = {r.event_id: r.accepted for r in batch.accepted_starts(spark.read.parquet(path), 20).collect()}
    want.pop(10)
    got.pop(10, None)
    assert got == want
    assert [want[i] for i in (1, 4, 5, 2, 7)] == [True, False, True, False, True]


def test_stream_name_is_exact(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    spark.range(5).write.parquet(f"{tmp_path}/t.parquet.bak")
    assert stream.drain(stream.file_stream(spark, f"{tmp_path}/t.parquet")).count() == 3


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from docket import session

    class Cluster:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Cluster()
        conf = type("C", (), {"get": staticmethod(lambda k, d: d)})

    with pytest.raises(RuntimeError, match="checkpoint"):
        session.scratch_root(Fake())


def test_cut_tables_can_be_dropped(spark):
    from docket import session

    kept = session.cut(spark.range(5))
    assert kept.count() == 5 and session.drop_cuts(spark) >= 1 and session.drop_cuts(spark) == 0


def test_order_over_partitions(spark):
    from docket.operators.ordering import in_order

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 != 0, F.col("id") % 5).alias("g"))
    got = [(r.pos, r.g, r.k) for r in in_order(rows.repartition(6), F.col("g").desc_nulls_last(), F.col("k")).collect()]
    want = sorted(((r.g, r.k) for r in rows.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(got) == [(i, g, k) for i, (g, k) in enumerate(want, 1)]
    assert in_order(rows.limit(0), "k").count() == 0


def test_unfinalise_writes_rows_before_flags(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "case_id long, text string")
    flags = spark.createDataFrame([(1, True, "d1", "n"), (2, True, "d2", "n"), (3, False, None, None)], "case_id long, indexed boolean, indexed_at string, status_note string")
    left, marks = corpus.unfinalise(spark, rows, flags, spark.createDataFrame([(1,), (3,)], "case_id long"), "case_id", str(tmp_path))
    assert [r.case_id for r in left.collect()] == [2]
    assert sorted(map(tuple, marks.collect()), key=str) == [(1, False, None, None), (2, True, "d2", "n"), (3, False, None, None)]
