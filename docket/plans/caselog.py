"""L: case log queries. A user's events are a case; click, view, ... stand for actions, the event's number for its stage."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import caselog as L
from docket.operators import rules as R
from docket.plans import Book
from docket.session import cut
from docket.sources.tables import table

BOOK = Book()
_KINDS = ["click", "purchase", "search", "view", "signup"]
_EV = """
ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) AS n FROM (SELECT DISTINCT event_type FROM events)),
ev AS (SELECT event_id, user_id AS case_id, (event_id % 5 + 1)::INT AS stage, CASE n WHEN 1 THEN 'start' WHEN 2 THEN 'done' WHEN 3 THEN 'failed' WHEN 4 THEN 'confirm' ELSE 'edit' END AS action, ts, props, value FROM events JOIN ty USING (event_type)),
st AS (SELECT *, row_number() OVER (PARTITION BY case_id, stage ORDER BY ts, event_id)::INT AS version FROM ev WHERE action = 'start'),
la AS (SELECT case_id, stage, max(version) AS version, arg_max(ts, version) AS ts FROM st GROUP BY 1, 2),
"""


def log(spark, sf_dir):
    """(event_id, case_id, stage, action, ts, props, value); actions by the alphabet of the event types."""
    events = table(spark, sf_dir, "events")
    from pyspark.sql import Window as W

    kinds = events.select("event_type").distinct().withColumn("n", F.row_number().over(W.orderBy("event_type")))
    action = F.when(F.col("n") == 1, "start").when(F.col("n") == 2, "done").when(F.col("n") == 3, "failed").when(F.col("n") == 4, "confirm").otherwise("edit")
    rows = events.join(F.broadcast(kinds), "event_type")
    return rows.select("event_id", F.col("user_id").alias("case_id"), (F.col("event_id") % 5 + 1).cast("int").alias("stage"), action.alias("action"), "ts", "props", "value")


def starts(spark, sf_dir):
    return L.versions(log(spark, sf_dir).where("action = 'start'"))


@BOOK.add("l01_versions", "WITH " + _EV + "z AS (SELECT 1) SELECT event_id, case_id, stage, version FROM st")
def l01(spark, sf_dir):
    return starts(spark, sf_dir).select("event_id", "case_id", "stage", "version")


@BOOK.add("l02_latest", "WITH " + _EV + "z AS (SELECT 1) SELECT case_id, stage, version, ts FROM la")
def l02(spark, sf_dir):
    return L.latest(starts(spark, sf_dir), ["ts"])


@BOOK.add("l03_version_list", "WITH " + _EV + "z AS (SELECT 1) SELECT case_id, stage, list(version ORDER BY version) AS versions FROM st GROUP BY 1, 2")
def l03(spark, sf_dir):
    return L.version_list(starts(spark, sf_dir))


@BOOK.add("l04_based_on", "WITH " + _EV + """b AS (SELECT s.case_id, s.stage, s.version, max(p.version) FILTER (WHERE (p.ts, p.event_id) <= (s.ts, s.event_id)) AS based_on, max(p.version) AS newest FROM st s LEFT JOIN st p ON p.case_id = s.case_id AND p.stage = s.stage - 1 GROUP BY 1, 2, 3)
SELECT case_id, stage, version, based_on, coalesce(coalesce(based_on, 0) < newest, false) AS stale FROM b""")
def l04(spark, sf_dir):
    return L.based_on(starts(spark, sf_dir))


_STATUS = "ss AS (SELECT case_id, stage, arg_max(CASE action WHEN 'start' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'confirmed' END, (ts, event_id)) AS status, arg_max(version, (ts, event_id)) FILTER (WHERE version IS NOT NULL) AS version FROM (SELECT ev.*, st.version FROM ev LEFT JOIN st USING (event_id, case_id, stage)) x WHERE action <> 'edit' GROUP BY 1, 2),"


def stage_status(spark, sf_dir):
    ev = log(spark, sf_dir).where("action <> 'edit'")
    state = F.when(F.col("action") == "start", "running").when(F.col("action").isin("done", "failed"), F.col("action")).otherwise("confirmed")
    return ev.groupBy("case_id", "stage").agg(F.max_by(state, F.struct("ts", "event_id")).alias("status"))


@BOOK.add("l05_stale_stages", "WITH " + _EV + _STATUS.replace(", arg_max(version, (ts, event_id)) FILTER (WHERE version IS NOT NULL) AS version FROM (SELECT ev.*, st.version FROM ev LEFT JOIN st USING (event_id, case_id, stage)) x", " FROM ev") + """
im(field, stages) AS (VALUES ('start', [2, 5]), ('done', []::INT[]), ('failed', [1])),
ch AS (SELECT DISTINCT case_id, action AS field FROM ev WHERE value > 80),
hi AS (SELECT DISTINCT case_id, unnest(coalesce(stages, [2, 3, 4])) AS stage FROM ch LEFT JOIN im USING (field))
SELECT hi.case_id, hi.stage FROM hi JOIN ss ON hi.case_id = ss.case_id AND hi.stage = ss.stage AND status IN ('done', 'confirmed')""")
def l05(spark, sf_dir):
    impact = spark.createDataFrame([("start", [2, 5]), ("done", []), ("failed", [1])], "field string, stages array<int>")
    changes = log(spark, sf_dir).where("value > 80").select("case_id", F.col("action").alias("field"))
    return L.stale_stages(changes, impact, stage_status(spark, sf_dir))


_CHANGES = {"start": "running", "done": "waiting", "failed": "failed", "confirm": "confirmed"}
_FOLD = "fo AS (SELECT *, coalesce(last_value(CASE action WHEN 'start' THEN 'running' WHEN 'done' THEN 'waiting' WHEN 'failed' THEN 'failed' WHEN 'confirm' THEN 'confirmed' END IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'new') AS case_status FROM ev),"


@BOOK.add("l06_status_fold", "WITH " + _EV + _FOLD + "z AS (SELECT 1) SELECT event_id, case_id, case_status FROM fo")
def l06(spark, sf_dir):
    return L.fold_status(log(spark, sf_dir), _CHANGES).select("event_id", "case_id", "case_status")


@BOOK.add("l07_next_stage", "WITH " + _EV + _FOLD + "z AS (SELECT 1) SELECT event_id, CASE case_status WHEN 'new' THEN 1 WHEN 'waiting' THEN 2 WHEN 'confirmed' THEN 3 WHEN 'failed' THEN 1 END AS next_stage FROM fo")
def l07(spark, sf_dir):
    folded = L.fold_status(log(spark, sf_dir), _CHANGES)
    return folded.select("event_id", L.next_stage(F.col("case_status"), {"new": 1, "waiting": 2, "confirmed": 3, "failed": 1}).alias("next_stage"))


@BOOK.add("l08_run_admission", "WITH " + _EV + """
r AS (SELECT *, lag(action) OVER w AS la_action, lag(ts) OVER w AS la_ts, max(CASE WHEN action = 'done' THEN 1 END) OVER (PARTITION BY case_id, stage ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS done FROM ev WINDOW w AS (PARTITION BY case_id, stage ORDER BY ts, event_id)),
q AS (SELECT event_id, CASE WHEN la_action = 'start' AND floor(epoch(ts))::BIGINT - floor(epoch(la_ts))::BIGINT <= 1200 THEN 'running' WHEN la_action = 'start' THEN 'dead run' WHEN stage = 1 THEN 'expected' WHEN done = 1 THEN 'finished before' ELSE 'not its turn' END AS reason FROM r WHERE action = 'start')
SELECT event_id, reason, reason NOT IN ('running', 'not its turn') AS allowed FROM q""")
def l08(spark, sf_dir):
    return L.admission(log(spark, sf_dir), F.col("stage") == 1).select("event_id", "reason", "allowed")


_RUNS = "rn AS (SELECT event_id, case_id, stage, action, ts, first_value(CASE WHEN action IN ('done', 'failed') THEN ts END IGNORE NULLS) OVER (PARTITION BY case_id, stage ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS finished FROM ev), rs AS (SELECT *, (floor(epoch(finished)) - floor(epoch(ts)))::BIGINT AS seconds FROM rn WHERE action = 'start'),"


@BOOK.add("l09_dead_runs", "WITH " + _EV + _RUNS + "z AS (SELECT 1) SELECT event_id, case_id, stage, seconds, coalesce(seconds > 1200, true) AS dead FROM rs")
def l09(spark, sf_dir):
    return L.dead_runs(log(spark, sf_dir)).select("event_id", "case_id", "stage", "seconds", "dead")


_ACCEPTED = "WITH RECURSIVE " + _EV + """
s AS (SELECT event_id, case_id, stage, ts, row_number() OVER (PARTITION BY case_id, stage ORDER BY ts, event_id) AS rn FROM ev WHERE action = 'start'),
r(event_id, case_id, stage, rn, last, accepted) AS (SELECT event_id, case_id, stage, rn, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.case_id, s.stage, s.rn, CASE WHEN s.ts > r.last + INTERVAL 1440 MINUTE THEN s.ts ELSE r.last END, s.ts > r.last + INTERVAL 1440 MINUTE FROM r JOIN s ON s.case_id = r.case_id AND s.stage = r.stage AND s.rn = r.rn + 1)
SELECT event_id, case_id, stage, accepted FROM r"""


@BOOK.add("l10_accepted_starts", _ACCEPTED)
def l10(spark, sf_dir):
    return L.accepted_starts(log(spark, sf_dir).where("action = 'start'").select("event_id", "case_id", "stage", "ts"), 60 * 24).drop("ts")


@BOOK.add("l10_pointer_doubling", _ACCEPTED)
def l10_pointers(spark, sf_dir):
    starts = log(spark, sf_dir).where("action = 'start'").select("event_id", "case_id", "stage", "ts")
    return L.accepted_by_pointers(starts, 60 * 24).drop("ts")


@BOOK.add("l11_audit_trail", "WITH " + _EV + "z AS (SELECT 1) SELECT case_id, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_id)::INT AS pos, ts, action, left(props, 4000) AS detail FROM ev")
def l11(spark, sf_dir):
    return L.trail(log(spark, sf_dir), "props")


@BOOK.add("l12_counts_tumbling", "WITH " + _EV + "z AS (SELECT 1) SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, action, count(*) AS n FROM ev GROUP BY 1, 2")
def l12(spark, sf_dir):
    return L.counts_over_time(log(spark, sf_dir))


@BOOK.add("l12_counts_sliding", "WITH " + _EV + "w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INT) AS window_start, action FROM ev, range(0, 3) r(k)) SELECT window_start, action, count(*) AS n FROM w GROUP BY 1, 2")
def l12_sliding(spark, sf_dir):
    return L.counts_over_time(log(spark, sf_dir), "3 hours", "1 hour")


@BOOK.add("l12_sessions", "WITH " + _EV + "g AS (SELECT case_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT case_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY case_id, k")
def l12_sessions(spark, sf_dir):
    return L.sessions(log(spark, sf_dir), "6 hours")


@BOOK.add("l13_stage_latency", "WITH " + _EV + _RUNS + "z AS (SELECT 1) SELECT stage, count(seconds) AS runs, min(seconds) AS least, max(seconds) AS most, round(quantile_cont(seconds, 0.5), 3) AS median FROM rs GROUP BY 1")
def l13(spark, sf_dir):
    runs = L.dead_runs(log(spark, sf_dir))
    return runs.groupBy("stage").agg(F.count("seconds").alias("runs"), F.min("seconds").alias("least"), F.max("seconds").alias("most"), F.round(F.percentile("seconds", 0.5), 3).alias("median"))


@BOOK.add("l13_merged_sketches", "WITH " + _EV + _RUNS + "z AS (SELECT 1) SELECT stage, count(*) AS runs, count(DISTINCT case_id) AS exact_cases, true AS cases_fit, true AS q50_fits, true AS q90_fits FROM rs GROUP BY 1")
def l13_sketches(spark, sf_dir):
    """Daily sketches of latency and cases, stored and merged, beside the exact figures they must fit."""
    runs = cut(L.dead_runs(log(spark, sf_dir)).select("case_id", "stage", "ts", "seconds"))
    merged = L.merged_sketches(cut(L.daily_sketches(runs)), ["stage"])
    both = runs.join(merged.drop("runs"), "stage").groupBy("stage").agg(
        F.count(F.lit(1)).alias("runs"),
        F.countDistinct("case_id").alias("exact_cases"),
        F.first("cases").alias("cases"),
        *[F.count_if(F.col("seconds") <= F.col(q)).alias(f"{q}_upto") for q in ("q50", "q90")],
        *[F.count_if(F.col("seconds") < F.col(q)).alias(f"{q}_under") for q in ("q50", "q90")],
        F.count("seconds").alias("timed"),
    )
    fits = lambda q, share: (F.col(f"{q}_under") <= (share + L.SKETCH_RANK_ERROR) * F.col("timed") + 1) & (F.col(f"{q}_upto") >= (share - L.SKETCH_RANK_ERROR) * F.col("timed") - 1)
    near = F.abs(F.col("cases") - F.col("exact_cases")) <= 4 * 1.04 / 2 ** (L.LOG_BUCKETS / 2) * F.col("exact_cases") + 1
    return both.select("stage", "runs", "exact_cases", near.alias("cases_fit"), fits("q50", 0.5).alias("q50_fits"), fits("q90", 0.9).alias("q90_fits"))


_FIELDS = "SELECT o_orderkey AS case_id, 'status' AS key, o_orderstatus AS value, 'low' AS confidence, 'auto' AS method FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority, 'medium', 'auto' FROM orders"


@BOOK.add("l14_patched_fields", f"WITH f AS ({_FIELDS}), p AS (SELECT o_orderkey AS case_id, 'status' AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'F' ELSE o_orderstatus END AS value FROM orders WHERE o_orderkey % 3 = 0) SELECT f.case_id, f.key, coalesce(p.value, f.value) AS value, CASE WHEN p.value IS NOT NULL THEN 'high' ELSE confidence END AS confidence, CASE WHEN p.value IS NOT NULL THEN 'manual' ELSE method END AS method, p.value IS NOT NULL AND p.value IS DISTINCT FROM f.value AS changed FROM f LEFT JOIN p ON f.case_id = p.case_id AND f.key = p.key")
def l14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    of = lambda key, col, c: orders.select(k.alias("case_id"), F.lit(key).alias("key"), F.col(col).alias("value"), F.lit(c).alias("confidence"), F.lit("auto").alias("method"))
    changed = orders.where(k % 3 == 0).select(k.alias("case_id"), F.lit("status").alias("key"), F.when(k % 2 == 0, "F").otherwise(F.col("o_orderstatus")).alias("value"))
    locked = changed.withColumn("key", F.lit("priority"))
    return L.patched(of("status", "o_orderstatus", "low").union(of("priority", "o_orderpriority", "medium")), changed.union(locked), ["status"])


@BOOK.add("l15_merged_summary", "WITH " + _EV + "u AS (SELECT case_id, action AS key, CASE WHEN event_id % 4 = 0 THEN ' ' ELSE json_extract_string(props, '$.k') END AS value, ts, event_id FROM ev) SELECT case_id, key, arg_max(value, (ts, event_id)) AS value FROM u WHERE coalesce(trim(value), '') <> '' GROUP BY 1, 2")
def l15(spark, sf_dir):
    value = F.when(F.col("event_id") % 4 == 0, F.lit(" ")).otherwise(F.get_json_object("props", "$.k"))
    return L.merged_summary(log(spark, sf_dir).select("case_id", F.col("action").alias("key"), value.alias("value"), "ts", "event_id"))


@BOOK.add("l16_finalised", """
WITH r AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 3 <> 0 AND conv_id % 7 <> 0),
s AS (SELECT c.conv_id AS case_id, turn + 1 AS claim_id, c.conv_id || '#r' || turn AS ref_key, text FROM conversations c JOIN r USING (conv_id) WHERE role = 'user' AND length(text) >= 100),
c AS (SELECT c.conv_id AS case_id, turn AS claim_id, c.conv_id || '#c' || turn AS ref_key, text FROM conversations c JOIN r USING (conv_id) WHERE role = 'assistant' AND length(text) >= 10)
SELECT case_id, ref_key, 'reason' AS unit_type, NULL AS linked_reason, text FROM s UNION ALL SELECT c.case_id, c.ref_key, 'claim', s.ref_key, c.text FROM c LEFT JOIN s ON c.case_id = s.case_id AND c.claim_id = s.claim_id""")
def l16(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "case_id")
    cases = talk.select("case_id").distinct().withColumn("archived", F.col("case_id") % 3 != 0)
    sections = talk.where("role = 'user'").select("case_id", (F.col("turn") + 1).alias("claim_id"), F.concat("case_id", F.lit("#r"), "turn").alias("ref_key"), "text")
    claims = talk.where("role = 'assistant'").select("case_id", F.col("turn").alias("claim_id"), F.concat("case_id", F.lit("#c"), "turn").alias("ref_key"), "text")
    return L.finalised(cases, sections, claims, cases.where(F.col("case_id") % 7 == 0), 100)


_QUEUE = "WITH " + _EV + "ss AS (SELECT case_id, stage, arg_max(CASE action WHEN 'start' THEN 'running' WHEN 'done' THEN 'done' WHEN 'failed' THEN 'failed' ELSE 'confirmed' END, (ts, event_id)) AS status FROM ev WHERE action <> 'edit' GROUP BY 1, 2), cs AS (SELECT case_id, list(status) AS s FROM ss GROUP BY 1), wq AS (SELECT case_id, CASE WHEN case_id % 10 = 0 THEN 'archived' WHEN list_contains(s, 'failed') THEN 'failed' WHEN list_contains(s, 'running') THEN 'running' WHEN list_contains(s, 'done') THEN 'to confirm' ELSE 'open' END AS work_stage FROM cs),"


def work(spark, sf_dir):
    maps = stage_status(spark, sf_dir).groupBy("case_id").agg(F.map_from_entries(F.collect_list(F.struct("stage", "status"))).alias("stages"))
    return maps.select("case_id", L.work_stage(F.col("stages"), F.col("case_id") % 10 == 0).alias("work_stage"))


@BOOK.add("l18_work_stages", _QUEUE + "z AS (SELECT 1) SELECT case_id, work_stage FROM wq")
def l18(spark, sf_dir):
    return work(spark, sf_dir)


_PERIOD = "pe AS (SELECT o_orderkey, o_custkey, min(l_shipdate)::DATE AS f, o_orderdate::DATE AS s FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL), pq AS (SELECT o_orderkey, o_custkey, CASE WHEN f >= s THEN greatest(datediff('day', f, s + 30), 0)::INT END AS remaining, CASE WHEN f >= s THEN f > s + 30 END AS over FROM pe),"


def _periods(spark, sf_dir):
    filed = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("filed"))
    rows = table(spark, sf_dir, "orders").join(filed, "o_orderkey", "left")
    return rows.select("o_orderkey", "o_custkey", R.appeal_period(F.col("o_orderdate"), F.col("filed")).alias("p")).select("o_orderkey", "o_custkey", F.col("p.remaining_days").alias("remaining"), F.col("p.is_overdue").alias("over"))


_PRIORITY = "CASE WHEN remaining IS NULL THEN 'normal' WHEN over OR remaining <= 3 THEN 'critical' WHEN remaining <= 7 THEN 'high' WHEN remaining <= 14 THEN 'medium' ELSE 'normal' END"


@BOOK.add("l19_priorities", "WITH " + _PERIOD + f"z AS (SELECT 1) SELECT o_orderkey, {_PRIORITY} AS priority FROM pq")
def l19(spark, sf_dir):
    return _periods(spark, sf_dir).select("o_orderkey", L.priority(F.col("remaining"), F.col("over")).alias("priority"))


@BOOK.add("l20_risk_tags", "WITH " + _PERIOD + "z AS (SELECT 1) SELECT o_orderkey, list_filter([CASE WHEN over THEN 'late' END, CASE WHEN remaining IS NULL THEN 'no period' END, CASE WHEN o_custkey % 2 = 0 THEN 'even' END], lambda x: x IS NOT NULL) AS risks FROM pq")
def l20(spark, sf_dir):
    named = {"late": F.col("over"), "no period": F.col("remaining").isNull(), "even": F.col("o_custkey") % 2 == 0}
    return _periods(spark, sf_dir).select("o_orderkey", L.tags(named).alias("risks"))


@BOOK.add("l21_agreement", "WITH q AS (SELECT CASE WHEN toxic IS NULL THEN 'open' WHEN toxic = 1 AND quality = 1 THEN 'both' WHEN toxic = 1 THEN 'machine only' WHEN quality = 1 THEN 'human only' ELSE 'neither' END AS quadrant, lang FROM documents LEFT JOIN labels USING (doc_id)) SELECT lang, count(*) FILTER (WHERE quadrant = 'open') AS open, count(*) FILTER (WHERE quadrant = 'both') AS both, count(*) FILTER (WHERE quadrant = 'machine only') AS machine_only, count(*) FILTER (WHERE quadrant = 'human only') AS human_only, count(*) FILTER (WHERE quadrant = 'neither') AS neither FROM q GROUP BY 1")
def l21(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    q = rows.select("lang", F.regexp_replace(L.quadrant(F.col("toxic") == 1, F.col("quality") == 1), " ", "_").alias("q"))
    return q.groupBy("lang").pivot("q", ["open", "both", "machine_only", "human_only", "neither"]).count().na.fill(0)


@BOOK.add("l22_queue_filter", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE contains(lower(concat_ws(' ', c_custkey::VARCHAR, c_name, c_nationkey::VARCHAR, c_mktsegment)), 'build') GROUP BY 1")
def l22(spark, sf_dir):
    hits = L.queue(table(spark, sf_dir, "customer"), "BUILD", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return hits.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@BOOK.add("l23_made_by", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'rules' WHEN o_orderstatus = 'O' THEN 'assistant' ELSE 'officer' END AS made_by, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'bad' WHEN o_orderpriority = '3-MEDIUM' THEN 'warn' ELSE 'good' END AS tone FROM orders")
def l23(spark, sf_dir):
    by = F.when(F.col("o_orderstatus") == "F", "rules").when(F.col("o_orderstatus") == "O", "assistant").otherwise("officer")
    tone = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "bad").when(F.col("o_orderpriority") == "3-MEDIUM", "warn").otherwise("good")
    return table(spark, sf_dir, "orders").select("o_orderkey", by.alias("made_by"), tone.alias("tone"))


@BOOK.add("l24_case_rows", "WITH " + _PERIOD + f"z AS (SELECT 1) SELECT o_orderkey, coalesce(c_name, 'customer ' || pq.o_custkey) AS title, {_PRIORITY} AS priority, remaining, CASE WHEN over THEN 'late' END AS alert FROM pq LEFT JOIN customer ON c_custkey = pq.o_custkey")
def l24(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = _periods(spark, sf_dir).join(names, "o_custkey", "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("customer "), "o_custkey")).alias("title"), L.priority(F.col("remaining"), F.col("over")).alias("priority"), "remaining", F.when(F.col("over"), "late").alias("alert"))


@BOOK.add("l25_progress", _QUEUE + "g AS (SELECT DISTINCT case_id, k::INT AS stage FROM ev, range(1, 6) r(k)) SELECT g.case_id, g.stage, version, coalesce(status, 'not started') AS status FROM g LEFT JOIN ss ON g.case_id = ss.case_id AND g.stage = ss.stage LEFT JOIN la ON g.case_id = la.case_id AND g.stage = la.stage")
def l25(spark, sf_dir):
    last = stage_status(spark, sf_dir).join(L.latest(starts(spark, sf_dir), ["ts"]).drop("ts"), ["case_id", "stage"], "left")
    return L.progress(log(spark, sf_dir).select("case_id").distinct(), last).select("case_id", "stage", "version", "status")
