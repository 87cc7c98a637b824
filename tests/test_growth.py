"""Steps that grew faster than their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.llm import bm25
from docket.operators import lexindex, retrieval, scoring
from docket.operators import rules as R
from docket.operators.rules import Rule
from docket.streaming import caselog as stream
from tests.test_streams import files


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_dead_runs_are_joined_and_null_cases_meet_nothing(spark, tmp_path):
    """A call of Python for each case's stage took 51 seconds for 100,000 events."""
    live = files(spark, f"{tmp_path}/e", [[(1, None, 1, "start", 0), (2, None, 1, "done", 60), (3, 1, 1, "start", 0), (4, 1, 1, "failed", 1200), (5, 1, 2, "start", 0), (6, 1, 2, "done", 1201)], [(7, 9, 1, "done", 90_000)]])
    told = stream.dead_runs(live, 20)
    assert "Pandas" not in plan(told)
    assert sorted(r["event_id"] for r in stream.drain(told).collect()) == [1, 5]


def rules_and_cases(spark):
    rows = [(1, "a", None, "low"), (1, "", "x", "low"), (2, None, None, None), (3, "b", "y", "high"), (None, "c", None, "low")]
    cases = spark.createDataFrame(rows, "case long, a string, b string, sure string").withColumn("flag", F.col("b").isNull())
    return [Rule("F1", "present", ("a",)), Rule("P1", "flag_triggers", ("flag",)), Rule("P2", "manual"), Rule("F2", "present", ("b",)), Rule("F3", "present", ("a",), enabled=False)], cases


def test_verdicts_count_within_a_row(spark):
    """One row a rule and case was joined and grouped."""
    rules, cases = rules_and_cases(spark)
    long = R.run_rules(cases, rules, "case").drop("input_confidence")
    # results of a case that has several rows are of each row's own confidence, here the same
    sure = cases.select("case", F.col("sure").alias("input_confidence")).distinct()
    wanted = R.summarize(long.join(sure, long["case"].eqNullSafe(sure["case"])).drop(sure["case"]), "case")
    got = R.case_verdicts(cases, rules, "case", "sure")
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert "Generate" not in plan(got)


def test_confirmations_are_told_within_a_row(spark):
    """Fields and results were joined twice."""
    rules, cases = rules_and_cases(spark)
    fields = {"a": (F.col("a"), F.col("sure")), "b": (F.col("b"), F.lit("high"))}
    long = [cases.select("case", F.lit(k).alias("key"), v.alias("value"), c.alias("confidence")) for k, (v, c) in fields.items()]
    wanted = R.confirmations(long[0].union(long[1]), R.run_rules(cases, rules, "case"), rules[:4], "case", [], ["b"])
    got = R.case_confirmations(cases, rules, "case", fields, [], ["b"])
    assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))
    assert "Join" not in plan(got)


def test_bm25_asks_queries_in_blocks(spark, monkeypatch):
    """Documents and the queries of every shard were shuffled and met in a sort."""
    docs = spark.createDataFrame([(i, f"w{i % 3} w{i % 5} w{i}") for i in range(40)], "doc_id long, text string")
    asked = docs.where("doc_id % 4 = 0").withColumnRenamed("doc_id", "query_id")
    rows = lambda: sorted(map(str, bm25.search(docs, asked, k=3, shard_words=20).collect()))
    whole = rows()
    monkeypatch.setattr(bm25, "BLOCK_WEIGHTS", 7)
    assert rows() == whole and len(whole) == 30


def test_bm25_scores_a_document_where_its_row_lies(spark, monkeypatch):
    """All postings were dealt over the session's partitions and sorted there, so a task's memory grew with the table."""
    docs = spark.createDataFrame([(i, f"v{i % 2}", f"w{i % 3} w{i % 5} w{i}" if i % 11 else None) for i in range(60)], "ref_key long, law string, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1}") for i in range(4)], "query_id long, text string")
    allowed = asked.selectExpr("query_id", "concat('v', query_id % 2) AS law")
    seen = []
    scored = scoring.best_hits
    monkeypatch.setattr(retrieval, "best_hits", lambda post, *rest: seen.append(plan(post)) or scored(post, *rest))
    rows = lambda inside: sorted(map(str, retrieval.bm25(docs, asked, 3, inside=inside).collect()))
    first = [rows(None), rows(("law", allowed))]
    assert not any(step in p for p in seen for step in ("Exchange", "Sort"))
    monkeypatch.setattr(retrieval, "TASK_DOCS", 7)
    assert [rows(None), rows(("law", allowed))] == first and len(first[0]) == 12


def test_stored_index_is_dealt_by_runs(spark, tmp_path, monkeypatch):
    """Postings were dealt three times over the session's partitions, whatever their number, and every task told its best of each query."""
    for name, value in (("RUN_DOCS", 16), ("TASK_RUNS", 2), ("TASK_POSTINGS", 100)):
        monkeypatch.setattr(lexindex, name, value)
    docs = spark.range(600).selectExpr("id AS ref_key", "if(id % 50 = 7, null, concat('common w', id % 7)) AS text")
    path = f"{tmp_path}/index"
    lexindex.write_segment(docs, path, 0)
    assert len(list((tmp_path / "index" / "blocks" / "segment=0").glob("*.parquet"))) > 9  # 1,176 postings
    index = lexindex.Index(spark, path)
    assert (index.docs, index.total) == (600, 1176)
    asked = spark.range(2).selectExpr("id AS query_id", "concat('common w', id) AS text")
    weights = index.weights(asked)
    only = lexindex.term_filter(weights)
    runs = lexindex.bounds(index, weights, only)
    least = asked.select("query_id", F.lit(1.5).alias("least"))
    scored = lexindex._scored(index, weights, only, runs, 5, 6, least=least)
    assert scored.rdd.getNumPartitions() == 19  # 38 runs
    assert {r["query_id"] for r in scored.collect()} == {0, 1} and scored.agg(F.min("score")).first()[0] >= 1.5


def test_blocks_of_an_index_are_formed_without_a_row_a_posting(spark, tmp_path, monkeypatch):
    """Each posting became a row, was counted and gathered again, in writing and in compacting; so was each for a deletion."""
    for name, value in (("RUN_DOCS", 8), ("TASK_RUNS", 3), ("BATCH_BLOCKS", 5)):
        monkeypatch.setattr(lexindex, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    plans = []
    cut = lexindex.cut
    monkeypatch.setattr(lexindex, "cut", lambda df, *a: plans.append((df.columns, plan(df))) or cut(df, *a))
    rows = [(f"k{i:03d}", None if i % 31 == 4 else "" if i % 31 == 5 else f"Common w{i % 7} w{i % 5} common x{i}", [None, "a", "b"][i * 3 // 200]) for i in range(200)]
    docs = spark.createDataFrame(rows, "ref_key string, text string, law string").repartition(4)
    path = f"{tmp_path}/index"
    try:
        lexindex.write_segment(docs, path, 0, "law")
        gone = [f"k{i:03d}" for i in range(0, 200, 9)]
        assert lexindex.delete(spark, path, docs.where(F.col("ref_key").isin(gone)), dry_run=False) == len(gone)

        def wanted(live):
            out = []
            for key, text, law in live:
                words = (text or "").lower().split()
                out += [(w, law, key, words.count(w), len(words)) for w in set(words)]
            return sorted(map(str, out))

        def stored():
            index = lexindex.Index(spark, path)
            opened = index.live(index.blocks().select("segment", "term", "value", "run", "n", F.size("docs").alias("m"), F.explode("docs").alias("d")).select("segment", "term", "value", "n", "m", "d.*"))
            assert opened.where("n <> m").isEmpty()
            return sorted(str((r["term"], r["value"], r["ref_key"], r["tf"], r["dl"])) for r in opened.collect()), {r["term"]: r["df"] for r in index.terms().collect()}, index

        live = wanted([r for r in rows if r[0] not in gone])
        for _ in range(2):
            found, df, index = stored()
            assert found == live and (index.docs, index.total) == (200 - len(gone), sum(len((r[1] or "").split()) for r in rows if r[0] not in gone))
            assert df == {t: sum(x.startswith(f"('{t}',") for x in live) for t in df} and sum(df.values()) == len(live)
            keys = index.documents()
            assert keys.count() == 200 - len(gone) and keys.groupBy("value", "run").count().agg(F.max("count")).first()[0] <= 8
            lexindex.compact(spark, path, 0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    formed = [p for columns, p in plans if "lengths" in columns]
    assert len(formed) == 3 and not any("Generate" in p or "collect_list" in p for p in formed)
