"""Published expectations on small literal tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions.normalize import matching_key, nfc
from docket.operators import canonical, caselog, drafts, evidence, retrieval, rules, segmentation
from docket.operators.rules import Rule


def one(df):
    return df.first()[0]


def hits(spark, rows):
    return spark.createDataFrame([("q", k, s) for k, s in rows], "query_id string, ref_key string, score double")


def test_periods(spark):
    rows = [("114-02-05", "114-04-08", 62, 32, True), ("112-11-12", "114-10-20", 708, 678, True), ("114-03-10", "114-04-02", 23, 0, False)]
    for served, filed, day, over, late in rows:
        p = one(spark.range(1).select(rules.appeal_period(rules.parse_roc(F.lit(served)), rules.parse_roc(F.lit(filed)))))
        assert (p.ok, p.day_n, p.overdue_days, p.is_overdue) == (True, day, over, late)
    assert one(spark.range(1).select(rules.parse_roc(F.lit("114-02-30")))) is None
    assert one(spark.range(1).select(rules.to_roc(rules.parse_roc(F.lit("民國114年3月7日"))))) == "114-03-07"
    bad = one(spark.range(1).select(rules.appeal_period(F.lit("2025-02-02"), F.lit("2025-01-01"))))
    assert not bad.ok and bad.reason == "filed before service"


def test_fusion_keeps_by_raw_cosine_or_lexical_norm(spark):
    kept = retrieval.fuse(hits(spark, [("X", 8.5)]), hits(spark, [("X", 0.87), ("Y", 0.42)])).collect()
    assert [r.ref_key for r in kept] == ["X"] and kept[0].passed == ["vector", "lexical"]
    kept = retrieval.fuse(hits(spark, [("P", 12.0), ("Q", 1.0)]), hits(spark, [("P", 0.45), ("Q", 0.44)])).collect()
    assert [(r.ref_key, r.passed) for r in kept] == [("P", ["lexical"])]
    report = retrieval.fusion_report(hits(spark, [("A", 9.1), ("B", 2.3)]), hits(spark, [("A", 0.88), ("B", 0.55)])).first()
    assert (report.lexical_min, report.lexical_max, report.vector_min, report.vector_max) == (2.3, 9.1, 0.55, 0.88)
    assert [r.norm for r in retrieval.min_max(hits(spark, [("A", 3.0)])).collect()] == [1.0]


def test_interleave_skips_without_losing_the_turn(spark):
    rows = [("q", "a", 0.9, 0.0), ("q", "b", 0.8, 1.0), ("q", "c", 0.7, 0.9), ("q", "d", 0.0, 0.5), ("q", "e", 0.0, 0.0)]
    df = spark.createDataFrame(rows, "query_id string, ref_key string, vec_raw double, bm25_norm double")
    got = retrieval.interleave(df).orderBy("fused_pos").collect()
    assert [(r.ref_key, r.placed_by) for r in got] == [("a", "vector"), ("b", "lexical"), ("c", "vector"), ("d", "lexical"), ("e", "rest")]


def test_han_bigrams(spark):
    got = one(spark.createDataFrame([("訴願決定 A 法",)], "t string").select(retrieval.bigrams(F.col("t"))))
    assert got == ["訴願", "願決", "決定", "法"]


def test_legal_segments(spark):
    text = "第 1 條\n本法依憲法制定之。\n第 2 條\n（刪除）\n第 3 條\n人民得提起\n訴願。"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = segmentation.segment_markers(docs, segmentation.LAW_ARTICLE).orderBy("seg_no").collect()
    assert [(r.seg_no, r.marker, r.body) for r in rows] == [(1, "1", "本法依憲法制定之。"), (3, "3", "人民得提起 訴願。")]


def test_normalisation(spark):
    df = spark.createDataFrame([("行理　：",)], "t string")
    assert one(df.select(nfc(F.col("t")))) == "行理　："
    assert one(df.select(matching_key(F.col("t"), {"行": "X"}))) == "X理:"
    assert one(df.select(segmentation.distinct_matches(F.col("t"), "[\\x{F900}-\\x{FAFF}]"))) == ["理"]


def test_rules_never_fail(spark):
    cases = spark.createDataFrame([(1, "x", None), (2, " ", True)], "case_id int, a string, flag boolean")
    rules.register_check("long", lambda r, get: rules.outcome(F.when(F.length(get(r.fields[0])) > 3, "present").otherwise("missing")))
    todo = [Rule("F1", "present", ("a",)), Rule("P1", "quantum"), Rule("P2", "flag_triggers", ("flag",)), Rule("F2", "long", ("a",)), Rule("F3", "present", ("gone",))]
    got = {(r.case_id, r.code): r.status for r in rules.run_rules(cases, todo, "case_id").collect()}
    assert got[(1, "F1")] == "present" and got[(2, "F1")] == "missing" and got[(1, "P1")] == "need_human"
    assert got[(1, "P2")] == "unclear" and got[(2, "P2")] == "triggered" and got[(1, "F2")] == "missing" and got[(1, "F3")] == "unclear"
    assert one(spark.range(1).select(rules.lowest_confidence([F.lit("high"), F.lit("low"), F.lit(None).cast("string")]))) == "low"


def test_a_bad_rule_is_unclear_and_the_others_stand(spark):
    cases = spark.createDataFrame([(1, "x", "maybe", ["a"]), (2, "y", "true", [])], "case_id int, a string, flag string, list array<string>")
    bad = [Rule("B1", "array_min", ("list",)), Rule("B2", "present"), Rule("B3", "array_min", ("a",), params={"least": 1}), Rule("B4", "flag_true", ("flag",)), Rule("B5", "regex", ("a",), params={"pattern": "(["}), Rule("B6", "date_within", ("a", "flag")), Rule("B7", "adult_age", ("list", "a")), Rule("B8", "entity_kind", ("list",))]
    good = Rule("G1", "array_min", ("list",), params={"least": 1}, basis="art. 9", curable=True, coverage_note="some")
    rows = {(r.case_id, r.code): r for r in rules.run_rules(cases, [*bad, good], "case_id", {"list": "flag"}).collect()}
    assert all(rows[(1, r.code)].status == "unclear" for r in bad)
    assert rows[(2, "B4")].status == "present" and rows[(1, "G1")].status == "present" and rows[(2, "G1")].status == "missing"
    g = rows[(1, "G1")]
    assert (g.basis, g.curable, g.coverage_note, g.computed, g.input_confidence) == ("art. 9", True, "some", "1", None)


def test_calendar_spellings(spark):
    def day(text):
        return one(spark.range(1).select(rules.parse_roc(F.lit(text)).cast("string")))

    for text in ("114-04-08", "114/4/8", "114.04.08", " 114 - 4 - 8 ", "民國114年4月8日", "114 年 4 月 8 號", "114年4月8", "１１４年４月８日"):
        assert day(text) == "2025-04-08", text
    for text in ("5-1-1", "114/3-10x", "民國114-04-08", "114年3-10", "114-02-30", "1140-1-1", "不知道", ""):
        assert day(text) is None, text
    assert day("99.1.2") == "2010-01-02"


def test_precedents_with_text_keys_and_rebuttals(spark):
    rows = [("q", "law#1", 0.95, 1, 1, "no"), ("q", "law#2", 0.9, 2, 0, "never"), ("q", "law#3", 0.85, 3, 0, "never"), ("q", "law#4", 0.5, 4, 1, "no"), ("r", "law#9", 0.4, 1, 1, "no")]
    near = spark.createDataFrame(rows, "query_id string, ref_key string, score double, pos int, outcome int, rebuttal string")
    q = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    got = {r.query_id: r for r in retrieval.precedents(near, q, q).collect()}
    assert (got["q"].matched, got["q"].adopted, [tuple(x) for x in got["q"].rebuttals]) == (3, 1, [("never", 2), ("no", 1)])
    assert (got["r"].near_misses, got["r"].best, got["r"].rebuttals) == (["law#9"], 0.4, []) and got["q"].near_misses == []


def test_search_inside_a_column(spark):
    docs = spark.createDataFrame([(1, "a", "red fox"), (2, "b", "red dog"), (3, "b", "blue fox"), (4, None, "red fox")], "ref_key long, law string, text string")
    q = spark.createDataFrame([(7, "red fox"), (8, "red")], "query_id long, text string")
    hint = spark.createDataFrame([(7, "b"), (8, "a"), (8, "a")], "query_id long, law string")
    got = retrieval.bm25(docs, q, 5, inside=("law", hint)).collect()
    assert sorted((r.query_id, r.ref_key) for r in got) == [(7, 2), (7, 3), (8, 1)]
    every = {(r.query_id, r.ref_key): r.score for r in retrieval.bm25(docs, q, 5).collect()}
    assert all(r.score == every[(r.query_id, r.ref_key)] for r in got)  # statistics are of all documents


def test_cosine_in_blocks(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 5))
    units = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(90, None), (91, [0.0] * 5), (92, [1.0])], "ref_key long, vector array<double>")
    q = units.where("ref_key < 9").select(F.col("ref_key").alias("query_id"), "vector")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for size in (64 << 20, 100):
        got = retrieval.cosine(units, q, 4, block_bytes=size, skip_self=True).collect()
        for i in range(9):
            score = np.round(unit[i] @ unit.T, 6)
            score[i] = -9
            assert [r.ref_key for r in sorted(got, key=lambda r: r.pos) if r.query_id == i] == np.argsort(-score, kind="stable")[:4].tolist()


def test_near_names_against_all_pairs(spark):
    import random

    draw = random.Random(5)
    names = ["".join(draw.choice("abc") for _ in range(draw.randint(4, 9))) for _ in range(150)]
    v = spark.createDataFrame([(n,) for n in names[:70]], "value string")
    k = spark.createDataFrame([(n,) for n in names[70:]], "value string")
    got = {(r.value, r.suggestion, r.distance) for r in canonical.near_names(v, k, top=1000).collect()}
    pairs = v.distinct().crossJoin(k.distinct().withColumnRenamed("value", "s")).where("length(value) >= 5 AND abs(length(value) - length(s)) <= 1")
    want = {(r.value, r.s, r.d) for r in pairs.withColumn("d", F.levenshtein("value", "s")).collect() if r.d and r.d / max(len(r.value), len(r.s)) <= 0.34}
    assert got == want and want


def test_late_grounds_put_curable_ones_aside(spark):
    rows = [(1, "P01", "triggered")] + [(1, f"F0{i}", "missing") for i in range(1, 5)]
    got = rules.grounds(spark.createDataFrame(rows, "case_id int, code string, status string"), "case_id", "P01").first()
    assert got.reasons == ["P01"] and len(got.warnings) == 4 and len(got.grounds) == 5 and got.grounds[0] == "P01"


def test_one_to_one(spark):
    p = spark.createDataFrame([(1, 1, "a", "x"), (1, 2, "a", "y"), (1, 3, "b", "q"), (1, 4, "b", "y")], "case_id int, pos int, left_id string, right_id string")
    ids = spark.createDataFrame([(1, "a", "x"), (1, "b", "y")], "case_id int, left_id string, right_id string")
    got = {r.pos: (r.status, r.pair_no) for r in evidence.match_one_to_one(p, ids, ids, "case_id").collect()}
    assert got == {1: ("accepted", 1), 2: ("not one-to-one", None), 3: ("unknown id", None), 4: ("accepted", 2)}


def test_containment_loses_no_pair(spark):
    needles = spark.createDataFrame([(1, "abc"), (2, "the quick brown fox jumps"), (3, ""), (4, "zzz")], "n long, needle string")
    hays = spark.createDataFrame([(1, "xxabcxx"), (2, "see the quick brown fox jumps now"), (3, "ab"), (4, None), (1, "abc")], "h long, hay string")
    got = sorted((r.n, r.hay) for r in evidence.containing(needles, hays, "needle", "hay").collect())
    assert got == [(1, "abc"), (1, "xxabcxx"), (2, "see the quick brown fox jumps now")]


def test_quotes(spark):
    q = spark.createDataFrame([(1, "alpha beta gamma delta", ["A"]), (2, "one two three four five", ["A"]), (3, "alpha, beta gamma - delta", ["A"]), (4, "never said by any one", ["A"]), (5, "short", ["A"]), (6, "alpha beta ... gamma delta", ["A"])], "quote_id int, quote string, cited array<string>")
    s = spark.createDataFrame([("A", "so alpha beta  gamma delta it is"), ("B", "one two three four five")], "ref_key string, text string")
    rows = {r.quote_id: r for r in drafts.verify_quotes(q, s, cut_at=20).collect()}
    got = {i: r.result for i, r in rows.items()}
    assert rows[4].cited_truncated == ["A"] and rows[1].cited_truncated == []
    assert got == {1: "verbatim", 2: "misattributed", 3: "same_without_punctuation", 4: "not_found", 5: "emphasis", 6: "verbatim"}


def test_near_names(spark):
    v = spark.createDataFrame([("abcdef",), ("abcdxf",), ("zzzzzz",), ("abc",)], "value string")
    k = spark.createDataFrame([("abcdef",), ("abcdefg",)], "value string")
    got = sorted((r.value, r.suggestion, r.distance) for r in canonical.near_names(v, k).collect())
    assert got == [("abcdef", "abcdefg", 1), ("abcdxf", "abcdef", 1), ("abcdxf", "abcdefg", 2)]


def test_dead_runs_are_strictly_longer(spark):
    rows = []
    for case, minutes in ((1, 19), (2, 20), (3, 21)):
        rows += [(case * 2, case, 1, "start", "2024-01-01 10:00:00"), (case * 2 + 1, case, 1, "done", f"2024-01-01 10:{minutes}:00")]
    events = spark.createDataFrame(rows, "event_id long, case_id long, stage int, action string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert {r.case_id: r.dead for r in caselog.dead_runs(events).collect()} == {1: False, 2: False, 3: True}


def test_stale_fields(spark):
    impact = spark.createDataFrame([("a", [3]), ("b", [])], "field string, stages array<int>")
    done = spark.createDataFrame([(c, s, "done") for c in (1, 2, 3) for s in (2, 3, 4)], "case_id int, stage int, status string")
    changes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "other")], "case_id int, field string")
    got = sorted((r.case_id, r.stage) for r in caselog.stale_stages(changes, impact, done).collect())
    assert got == [(1, 3), (3, 2), (3, 3), (3, 4)]
