"""S: source and sink queries, and the streaming forms of the case log."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docket.operators import segmentation
from docket.plans import Book
from docket.plans.segmentation import _MARK, _SEGS
from docket.session import scratch_root
from docket.sources import corpus as C
from docket.sources.tables import table
from docket.streaming import caselog as stream

BOOK = Book()


def fresh(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


@BOOK.add("s01_category_scan", "SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE source = 'src3'")
def s01(spark, sf_dir):
    return C.scan_category(table(spark, sf_dir, "documents"), "source", "src3", "doc_id").select("doc_id", "lang", "pos")


def _staged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    units = segmentation.segment_markers(docs, _MARK, "^[.,]").join(docs.select("doc_id", "source"), "doc_id")
    staged = C.stage(units, fresh(spark, "staging"), "source").withColumn("source", F.col("source").cast("string"))
    return C.staged_report(staged, "source", "doc_id", "seg_no", "body", {"short_body": F.length("body") < 20, "long_body": F.length("body") > 800})


@BOOK.add("s02_staged_parse", _SEGS + "SELECT source, count(DISTINCT doc_id) AS files, count(*) AS units, count(*) FILTER (WHERE length(body) < 20) AS short_body, count(*) FILTER (WHERE length(body) > 800) AS long_body, left(arg_min(body, (doc_id, seg_no)), 80) AS sample FROM k JOIN documents USING (doc_id) WHERE kind = 'unit' GROUP BY source")
def s02(spark, sf_dir):
    return _staged(spark, sf_dir)[0]


@BOOK.add("s02_staged_files", _SEGS + "SELECT source, doc_id, count(*) AS units, max(length(body))::INT AS longest, count(*) FILTER (WHERE length(body) < 20 OR length(body) > 800) AS problems FROM k JOIN documents USING (doc_id) WHERE kind = 'unit' GROUP BY source, doc_id")
def s02_files(spark, sf_dir):
    return _staged(spark, sf_dir)[1]


_LOADED = "SELECT CASE WHEN lang = 'en' THEN 'laws' ELSE 'precedents' END AS target, lang, count(*) AS n, sum(doc_id)::BIGINT AS ids FROM documents GROUP BY ALL"


def _loaded(spark, root):
    parts = [spark.read.parquet(f"{root}/{t}").withColumn("target", F.lit(t)) for t in ("laws", "precedents")]
    return parts[0].unionByName(parts[1]).groupBy("target", F.col("lang").cast("string").alias("lang")).agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def routes():
    return {"laws": F.col("lang") == "en", "precedents": F.col("lang") != "en"}


@BOOK.add("s03_routed_load", _LOADED)
def s03(spark, sf_dir):
    root = fresh(spark, "load")
    C.load(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), routes(), root, "lang")
    return _loaded(spark, root)


@BOOK.add("s04_rebuild", _LOADED)
def s04(spark, sf_dir):
    root = fresh(spark, "rebuild")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    C.load(docs, routes(), root, "lang")
    C.rebuild(docs, routes(), root, "lang")
    return _loaded(spark, root)


@BOOK.add("s05_resumable_load", "SELECT doc_id, lang, source, n_chars FROM documents")
def s05(spark, sf_dir):
    root = fresh(spark, "resume")
    args = (spark, f"{sf_dir}/documents.parquet", f"{root}/out", f"{root}/checkpoint")
    stream.resumable_load(*args)
    return stream.resumable_load(*args).select("doc_id", "lang", "source", "n_chars")  # nothing is left the second time


@BOOK.add("s06_delete", "SELECT source, count(*) AS n, (SELECT count(*) FROM documents WHERE source = 'src7') AS deleted FROM documents WHERE source <> 'src7' OR source IS NULL GROUP BY 1")
def s06(spark, sf_dir):
    kept, n = C.delete_where(table(spark, sf_dir, "documents"), "source", "src7", dry_run=False, most=None)
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("deleted", F.lit(n).cast("long"))


_BUILT = "p AS (SELECT lang AS category, unnest(list_filter(regexp_split_to_array(text, '\\n+'), lambda p: trim(p, ' ') <> '')) AS p FROM documents WHERE lang IS NOT NULL), l AS (SELECT category, count(*) AS n FROM p GROUP BY 1)"


@BOOK.add("s07_build_all", f"WITH {_BUILT} SELECT DISTINCT lang AS category, 'built' AS status, coalesce(n, 0) AS n FROM documents LEFT JOIN l ON lang = category WHERE lang IS NOT NULL")
def s07(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return C.build_all(docs, "lang", fresh(spark, "build"), lambda d: segmentation.paragraphs(d).join(docs.select("doc_id", "lang"), "doc_id"))


@BOOK.add("s04_replace_categories", "SELECT doc_id, lang, CASE WHEN lang = 'de' THEN 'new: ' || left(text, 20) ELSE left(text, 20) END AS head FROM documents WHERE lang IS NOT NULL AND (lang <> 'de' OR doc_id % 2 = 0) AND lang <> 'es'")
def s04_replace(spark, sf_dir):
    """All languages are loaded, then one is replaced and one dropped in place."""
    docs = table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", F.left("text", F.lit(20)).alias("head"))
    root = fresh(spark, "replace")
    C.replace_categories(docs, root, "lang", 1)
    C.replace_categories(docs.where("lang = 'de' AND doc_id % 2 = 0").withColumn("head", F.concat(F.lit("new: "), "head")), root, "lang", 2)
    C.drop_categories(spark, root, "lang", ["es"], 3)
    return C.read_categories(spark, root, "lang").select("doc_id", "lang", "head")


@BOOK.add("s07_build_stops", f"""WITH {_BUILT}, c AS (SELECT lang AS category, count(*) AS r FROM documents WHERE lang IS NOT NULL GROUP BY 1),
s AS (SELECT category, CASE WHEN sum(r) OVER (ORDER BY category) > (SELECT count(*) // 2 FROM documents) THEN 'stopped' ELSE 'built' END AS status FROM c)
SELECT category, status, CASE WHEN status = 'built' THEN coalesce(n, 0) ELSE 0 END AS n FROM s LEFT JOIN l USING (category)""")
def s07_stops(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    parse = lambda d: segmentation.paragraphs(d).join(docs.select("doc_id", "lang"), "doc_id")
    return C.build_all(docs, "lang", fresh(spark, "build"), parse, most_rows=docs.count() // 2)


@BOOK.add("s08_config_defaults", "WITH d AS (SELECT DISTINCT p_brand AS key, 'default' AS value FROM part), s AS (SELECT p_brand AS key, max(p_type) AS value FROM part WHERE p_size > 48 GROUP BY 1) SELECT d.key, coalesce(s.value, d.value) AS value, s.value IS NULL AS is_default FROM d LEFT JOIN s USING (key)")
def s08(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    default = part.select(F.col("p_brand").alias("key")).distinct().withColumn("value", F.lit("default"))
    stored = part.where("p_size > 48").groupBy(F.col("p_brand").alias("key")).agg(F.max("p_type").alias("value"))
    return C.with_defaults(default, stored, "key", "value")


@BOOK.add("s09_config_problems", "WITH r AS (SELECT p_partkey, p_type AS \"check\", CASE WHEN p_size % 7 = 0 THEN ' ' ELSE p_name END AS label, p_size % 8 AS s FROM part), k AS (SELECT DISTINCT p_type FROM part WHERE p_size < 3) SELECT p_partkey, 'unknown check' AS problem FROM r WHERE \"check\" NOT IN (SELECT p_type FROM k) UNION ALL SELECT p_partkey, 'no label' FROM r WHERE trim(label) = '' UNION ALL SELECT p_partkey, 'stage outside 1 to 5' FROM r WHERE NOT (s BETWEEN 1 AND 5)")
def s09(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rules = part.select("p_partkey", F.col("p_type").alias("check"), F.when(F.col("p_size") % 7 == 0, F.lit(" ")).otherwise(F.col("p_name")).alias("label"), F.array(F.col("p_size") % 8, F.lit(2)).alias("stages"))
    known = part.where("p_size < 3").select(F.col("p_type").alias("check"))
    return C.config_problems(rules, known, "check", "p_partkey", ["label"], "stages")


@BOOK.add("s10_case_list", "SELECT event_id, user_id, row_number() OVER (ORDER BY ts DESC, event_id) AS pos FROM events WHERE event_type = 'view'")
def s10(spark, sf_dir):
    return C.case_list(table(spark, sf_dir, "events"), F.col("event_type") == "view", "ts", "event_id").select("event_id", "user_id", "pos")


@BOOK.add("s11_audit_read", "WITH e AS (SELECT user_id, event_type || '#' || printf('%09d', event_id) AS sk, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sk)::INT AS pos, sk, k FROM e WHERE starts_with(sk, 'view#')")
def s11(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", F.format_string("%s#%09d", "event_type", "event_id").alias("sk"), "props")
    return C.audit_read(rows, "sk", "view#", "user_id", "props", {"k": "long"})


@BOOK.add("s11_variant_details", "WITH e AS (SELECT user_id, event_type || '#' || printf('%09d', event_id) AS sk, json_extract_string(props, '$.k')::BIGINT AS k FROM events) SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY sk)::INT AS pos, sk, k FROM e WHERE starts_with(sk, 'view#')")
def s11_variant(spark, sf_dir):
    """Details are parsed once at load and stored; reads take typed fields from them."""
    rows = table(spark, sf_dir, "events").select("user_id", F.format_string("%s#%09d", "event_type", "event_id").alias("sk"), "props")
    root = fresh(spark, "details")
    C.details_loaded(rows, "props").write.parquet(root)
    return C.audit_details(spark.read.parquet(root), "sk", "view#", "user_id", "props", {"k": "long"})


@BOOK.add("s12_size_route", "SELECT page_id, octet_length(encode(html))::INT AS bytes, CASE WHEN octet_length(encode(html)) > 8192 THEN 'object' ELSE 'row' END AS target, md5(html) AS body FROM pages")
def s12(spark, sf_dir):
    pages, root = table(spark, sf_dir, "pages"), fresh(spark, "routed")
    C.write_routed(pages, "html", "page_id", root, 8192)
    back = C.read_routed(spark, "html", "page_id", root)
    return C.route_by_size(back, "html", 8192).select("page_id", "bytes", "target", F.md5("html").alias("body"))


@BOOK.add("s13_archive_bundle", """
WITH d AS (SELECT l_orderkey, count(*) AS lines, list(l_linenumber || ':' || l_partkey ORDER BY l_linenumber, l_partkey)::VARCHAR[] AS parts, count(DISTINCT l_suppkey) AS sources, count(*) FILTER (WHERE l_returnflag = 'R') AS returned, count(DISTINCT l_linestatus) AS stages, min(l_shipdate)::DATE::VARCHAR AS first_event FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderstatus AS version, lines, parts, sources, returned, stages, first_event FROM orders JOIN d ON l_orderkey = o_orderkey""")
def s13(spark, sf_dir):
    """A case is an order, its status the version; the bundle's five parts are written as JSON and read back."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("version"))
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = {
        "draft": lines.select("o_orderkey", "l_linenumber", "l_partkey"),
        "sources_used": lines.select("o_orderkey", "l_suppkey").distinct(),
        "check_summary": lines.groupBy("o_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("returned")),
        "stage_versions": lines.groupBy("o_orderkey", F.col("l_linestatus").alias("stage")).agg(F.count(F.lit(1)).alias("version")),
        "audit_trail": lines.select("o_orderkey", F.col("l_shipdate").cast("date").alias("day"), "l_linenumber"),
    }
    root = fresh(spark, "archive")
    made = C.bundle(orders.join(lines.select("o_orderkey").distinct(), "o_orderkey", "left_semi"), parts, "o_orderkey").join(orders, "o_orderkey")
    C.write_bundles(made, "o_orderkey", "version", root)
    shape = "draft array<struct<l_linenumber:int,l_partkey:bigint>>, sources_used array<struct<l_suppkey:bigint>>, check_summary array<struct<returned:bigint>>, stage_versions array<struct<stage:string,version:bigint>>, audit_trail array<struct<day:date,l_linenumber:int>>"
    back = spark.read.schema("o_orderkey long, document string, version string, shard int").json(root).select("o_orderkey", "version", F.from_json("document", shape).alias("d"))
    pair = F.transform("d.draft", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"]))
    count = lambda c: F.size(f"d.{c}").cast("long")
    return back.select("o_orderkey", "version", count("draft").alias("lines"), pair.alias("parts"), count("sources_used").alias("sources"), F.get("d.check_summary", F.lit(0))["returned"].alias("returned"), count("stage_versions").alias("stages"), F.get("d.audit_trail", F.lit(0))["day"].cast("string").alias("first_event"))


@BOOK.add("s14_rendered_text", "SELECT conv_id, 'Case ' || conv_id || chr(10) || chr(10) || string_agg(turn || '. ' || text || CASE WHEN length(text) < 60 THEN ' [check]' ELSE '' END, chr(10) || chr(10) ORDER BY turn) AS document FROM conversations GROUP BY 1")
def s14(spark, sf_dir):
    return C.rendered(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text", F.concat(F.lit("Case "), F.col("conv_id")), F.length("text") < 60)


def live(spark, sf_dir):
    """The events as a stream of cases: the event type is the action."""
    events = stream.file_stream(spark, f"{sf_dir}/events.parquet")
    return events.select("event_id", F.col("user_id").alias("case_id"), (F.col("event_id") % 5 + 1).cast("int").alias("stage"), F.col("event_type").alias("action"), F.col("ts").cast("timestamp").alias("ts"))


@BOOK.add("l12_stream_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type AS action, count(*) AS n FROM events GROUP BY 1, 2")
def l12_stream(spark, sf_dir):
    return stream.drain(stream.counts(live(spark, sf_dir)), "complete").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@BOOK.add("l13_stream_latency", "WITH e AS (SELECT event_id, user_id, event_id % 5 AS s, event_type, ts FROM events) SELECT a.event_id AS start_id, b.event_id AS finish_id, (floor(epoch(b.ts)) - floor(epoch(a.ts)))::BIGINT AS seconds FROM e a JOIN e b ON a.user_id = b.user_id AND a.s = b.s AND a.event_type = 'click' AND b.event_type = 'view' AND b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 1440 MINUTE")
def l13_stream(spark, sf_dir):
    rows = live(spark, sf_dir)
    return stream.drain(stream.latency(rows.where("action = 'click'"), live(spark, sf_dir).where("action = 'view'"), 1440))


@BOOK.add("l10_stream_accepted_starts", """
WITH RECURSIVE s AS (SELECT event_id, user_id AS case_id, (event_id % 5 + 1)::INT AS stage, ts, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY ts, event_id) AS rn FROM events WHERE event_type = 'click'),
r(event_id, case_id, stage, rn, last, accepted) AS (SELECT event_id, case_id, stage, rn, ts, true FROM s WHERE rn = 1
  UNION ALL SELECT s.event_id, s.case_id, s.stage, s.rn, CASE WHEN s.ts > r.last + INTERVAL 1440 MINUTE THEN s.ts ELSE r.last END, s.ts > r.last + INTERVAL 1440 MINUTE FROM r JOIN s ON s.case_id = r.case_id AND s.stage = r.stage AND s.rn = r.rn + 1)
SELECT event_id, case_id, stage, accepted FROM r""")
def l10_stream(spark, sf_dir):
    told = stream.accepted_starts(live(spark, sf_dir).where("action = 'click'"), 60 * 24, late="0 seconds")
    return stream.drain(told).select("event_id", "case_id", "stage", "accepted")


@BOOK.add("l09_stream_dead_runs", """
WITH e AS (SELECT event_id, user_id AS case_id, (event_id % 5 + 1)::INT AS stage, CASE event_type WHEN 'click' THEN 'start' WHEN 'view' THEN 'done' ELSE event_type END AS action, ts, floor(epoch(ts))::BIGINT AS s FROM events),
w AS (SELECT max(epoch_us(ts)) // 1000 - 60000 AS mark FROM e WHERE action IN ('start', 'done', 'failed')),
n AS (SELECT a.event_id, min(b.s) AS s FROM e a JOIN e b ON a.case_id = b.case_id AND a.stage = b.stage AND b.action IN ('done', 'failed') AND (b.ts > a.ts OR (b.ts = a.ts AND b.event_id > a.event_id)) WHERE a.action = 'start' GROUP BY 1)
SELECT event_id, case_id, stage, epoch_us(ts) AS started_us FROM e LEFT JOIN n USING (event_id), w WHERE e.action = 'start' AND coalesce(n.s - e.s > 1200, true) AND (e.s + 1201) * 1000 <= mark""")
def l09_stream(spark, sf_dir):
    named = F.when(F.col("action") == "click", "start").when(F.col("action") == "view", "done").otherwise(F.col("action"))
    told = stream.drain(stream.dead_runs(live(spark, sf_dir).withColumn("action", named)))
    return told.select("event_id", "case_id", "stage", F.unix_micros("started").alias("started_us"))


@BOOK.add("l12_stream_sessions", """
WITH g AS (SELECT user_id AS case_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY case_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g),
r AS (SELECT case_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY case_id, k)
SELECT case_id, epoch_us(session_start) AS start_us, epoch_us(session_end) AS end_us, n FROM r WHERE epoch_us(session_end) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)""")
def l12_stream_sessions(spark, sf_dir):
    """Every event arrives twice and counts once."""
    told = stream.drain(stream.session_counts(live(spark, sf_dir).union(live(spark, sf_dir)), "6 hours", "0 seconds"))
    return told.select("case_id", F.unix_micros("session_start").alias("start_us"), F.unix_micros("session_end").alias("end_us"), "n")


@BOOK.add("l12_stream_sliding", """
WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(k::INT) AS window_start, event_type AS action FROM events, range(0, 3) r(k))
SELECT epoch_us(window_start) AS start_us, action, count(*) AS n FROM w WHERE epoch_us(window_start + INTERVAL 3 HOUR) // 1000 <= (SELECT max(epoch_us(ts)) // 1000 FROM events) GROUP BY 1, 2""")
def l12_stream_sliding(spark, sf_dir):
    told = stream.drain(stream.sliding_counts(live(spark, sf_dir).union(live(spark, sf_dir)), late="0 seconds"))
    return told.select(F.unix_micros("window_start").alias("start_us"), "action", "n")


@BOOK.add("l17_unfinalise", "SELECT conv_id, count(*) FILTER (WHERE conv_id % 7 <> 0) AS n, conv_id % 7 <> 0 AND conv_id % 2 = 0 AS indexed, CASE WHEN conv_id % 7 <> 0 AND conv_id % 2 = 0 THEN 'day ' || conv_id END AS indexed_at FROM conversations GROUP BY conv_id")
def l17(spark, sf_dir):
    """Conversations are cases with their turns in the index; every seventh is taken back, also those whose flag isn't set."""
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cases = talk.select("conv_id").distinct()
    on = F.col("conv_id") % 2 == 0
    flags = cases.select("conv_id", on.alias("indexed"), F.when(on, F.concat(F.lit("day "), F.col("conv_id"))).alias("indexed_at"), F.when(on, "sent").alias("status_note"))
    rows, left = C.unfinalise(spark, talk, flags, cases.where("conv_id % 7 = 0"), "conv_id", fresh(spark, "finalised"))
    n = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    return left.join(n, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"), "indexed", "indexed_at")
