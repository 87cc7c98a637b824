"""Joins in rounds, scans and stores against the plain forms."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import caselog, drafts, evidence
from docket.operators.ordering import in_group_order
from docket.sources import corpus


def test_matching_in_rounds_equals_in_order(spark):
    """Random cases, one of which holds most proposals; unknown ids and repeated proposals."""
    rng = np.random.default_rng(1)
    rows = [(1, int(i), int(a), int(b)) for i, (a, b) in enumerate(rng.integers(0, 40, (600, 2)))]
    rows += [(int(c), int(p), int(a), int(b)) for c, p, a, b in zip(rng.integers(2, 9, 150), rng.integers(0, 9, 150), rng.integers(0, 6, 150), rng.integers(0, 6, 150), strict=True)]
    rows += rows[-5:] + [(10, 1, 1, 1), (10, 2, 99, 1), (10, 3, 1, None)]
    p = spark.createDataFrame(rows, "case_id long, pos int, left_id long, right_id long").repartition(5)
    ids = spark.createDataFrame([(c, i) for c in range(11) for i in range(40) if (c + i) % 7], "case_id long, left_id long")
    right = ids.withColumnRenamed("left_id", "right_id")
    got = evidence.match_in_rounds(p, ids, right, "case_id")
    want = evidence.match_one_to_one(p, ids, right, "case_id")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))
    none = evidence.match_in_rounds(p, ids.where("false"), right, "case_id")
    assert {r["status"] for r in none.collect()} == {"unknown id"}
    assert evidence.match_in_rounds(p.where("false"), ids, right, "case_id").count() == 0


def test_pointers_equal_the_walk(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(0, 3)), 1, int(s)) for i, s in enumerate(rng.integers(0, 400, 300))] + [(1000 + i, 7, 2, i * 9) for i in range(200)] + [(2000, 8, 1, 5)]
    starts = spark.createDataFrame(rows, "event_id long, case_id long, stage int, minute long")
    starts = starts.withColumn("ts", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000)).drop("minute").repartition(4)
    got = {r["event_id"]: r["accepted"] for r in caselog.accepted_by_pointers(starts).collect()}
    assert got == {r["event_id"]: r["accepted"] for r in caselog.accepted_starts(starts).collect()}
    assert len(got) == len(rows) and caselog.accepted_by_pointers(starts.where("false")).count() == 0


def test_numbers_in_groups(spark):
    rows = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") * 37 % 500).alias("k"))
    got = {(r["g"], r["k"]): r["pos"] for r in in_group_order(rows.repartition(6), ["g"], F.desc("k")).collect()}
    for g in range(3):
        assert [k for k, _ in sorted(((k, p) for (h, k), p in got.items() if h == g), key=lambda x: x[1])] == sorted((k for h, k in got if h == g), reverse=True)
        assert sorted(p for (h, _), p in got.items() if h == g) == list(range(1, 1 + sum(h == g for h, _ in got)))


def test_one_scan_finds_what_joins_find(spark, monkeypatch):
    quotes = spark.createDataFrame([(1, "the court finds the appeal late", ["a"]), (2, "and, so it was decided then", ["b"]), (3, "nothing like this anywhere", ["a"]), (4, "short", ["a"]), (5, "the court finds the appeal late", ["b"])], "quote_id long, quote string, cited array<string>")
    sources = spark.createDataFrame([("a", "Here the court finds the appeal late. More."), ("b", "and so it was decided, then and there"), ("c", None), ("d", "")], "ref_key string, text string")
    read = lambda: sorted((r["quote_id"], r["result"], r["found_in"]) for r in drafts.verify_quotes(quotes, sources).collect())
    once = read()
    assert once == [(1, "verbatim", "a"), (2, "same_without_punctuation", "b"), (3, "not_found", None), (4, "emphasis", None), (5, "misattributed", "a")]
    monkeypatch.setattr(evidence, "MOST_PIECES", 1)
    assert read() == once


def test_a_category_is_replaced_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id long, cat string, text string")
    assert sorted(corpus.replace_categories(rows, root, "cat", 1)) == ["a", "b"]
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "units" / "cat=b").rglob("*.parquet")}
    seen = lambda: sorted((r["id"], r["cat"], r["text"]) for r in corpus.read_categories(spark, root, "cat").collect())
    before = seen()
    fresh = spark.createDataFrame([(9, "a", "new")], "id long, cat string, text string")
    commit = corpus._commit
    monkeypatch.setattr(corpus, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        corpus.replace_categories(fresh.unionByName(fresh), root, "cat", 2)
    assert seen() == before  # staged, not committed
    monkeypatch.setattr(corpus, "_commit", commit)
    corpus.replace_categories(fresh, root, "cat", 2)
    assert seen() == [(3, "b", "z"), (9, "a", "new")]
    assert files == {p: p.stat().st_mtime_ns for p in (tmp_path / "t" / "units" / "cat=b").rglob("*.parquet")}
    corpus.drop_categories(spark, root, "cat", ["a"], 3)
    assert seen() == [(3, "b", "z")]


def test_details_of_any_shape(spark):
    rows = spark.createDataFrame([(1, "v#1", '{"k": 5, "s": "x"}'), (1, "v#2", "not json"), (1, "v#3", '{"k": "text"}'), (2, "v#1", None), (2, "w#1", '{"k": 1}')], "u long, sk string, d string")
    got = corpus.audit_details(corpus.details_loaded(rows, "d"), "sk", "v#", "u", "d", {"k": "long", "s": "string"})
    assert sorted(map(tuple, got.collect())) == [(1, 1, "v#1", 5, "x"), (1, 2, "v#2", None, None), (1, 3, "v#3", None, None), (2, 1, "v#1", None, None)]
