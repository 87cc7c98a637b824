"""D and P: rule, disposition and period queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import rules as R
from docket.operators.rules import Rule
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()

RULES = [
    Rule("F01", "present", ("o_orderpriority",), "priority", basis="art. 1", curable=True),
    Rule("F02", "all_present", ("o_orderstatus", "c_mktsegment", "note"), "fields", partial_ok=True),
    Rule("F03", "array_min", ("lines",), "lines", {"least": 3}),
    Rule("F04", "regex", ("o_orderpriority",), "pattern", {"pattern": "^[1-3]-"}),
    Rule("P01", "date_within", ("served", "filed"), "in time", {"days": 30}, basis="art. 2", coverage_note="holidays are not counted"),
    Rule("P02", "flag_triggers", ("rich",), "flag"),
    Rule("P03", "manual", (), "by hand"),
    Rule("P04", "entity_kind", ("parties",), "representative", {"person_marker": "00"}),
    Rule("P05", "adult_age", ("parties", "served"), "age"),
    Rule("X01", "flag_true", ("rich",), "flag set"),
    Rule("X02", "quantum", ("rich",), "unknown"),
    Rule("X03", "present", ("nowhere",), "no such field"),
    Rule("X04", "present", ("note",), "off", enabled=False),
    Rule("X05", "array_min", ("lines",), "no number"),
    Rule("X06", "array_min", ("o_orderstatus",), "no array", {"least": 1}),
    Rule("X07", "flag_true", ("c_mktsegment",), "text for a flag"),
    Rule("X08", "present", (), "no field"),
    Rule("X09", "regex", ("note",), "bad pattern", {"pattern": "(["}),
]
SURE = {"o_orderpriority": "priority_sure", "filed": "filed_sure"}


def cases(spark, sf_dir):
    """A case is an order with its customer and lines."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linestatus").alias("lines"), F.min("l_shipdate").alias("filed"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", "c_acctbal")
    # lines last: the cases stay dealt by their key, and grouping by it needs no shuffle
    rows = table(spark, sf_dir, "orders").join(customer, "o_custkey", "left").join(lines, "o_orderkey", "left")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "organisation").otherwise("natural")
    person = F.struct(kind.alias("kind"), F.col("c_name").alias("name"), F.when(F.col("o_custkey") % 5 != 0, F.date_sub(F.col("o_orderdate").cast("date"), F.col("o_custkey").cast("int") * 20)).alias("birth"), F.when(F.col("o_custkey") % 2 == 0, F.lit("agent")).alias("rep_name"))
    return rows.select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", F.when(F.col("c_acctbal") < 0, F.lit(" ")).when(F.col("c_acctbal") > 5000, "noted").alias("note"), "lines", F.col("o_orderdate").alias("served"), "filed", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal") > 7000).alias("rich"), F.array(person).alias("parties"), _confidence().alias("priority_sure"), F.when(F.col("o_orderkey") % 2 == 0, "medium").alias("filed_sure"))


_CONF = "CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'high' WHEN o_orderpriority LIKE '3%' THEN 'medium' WHEN o_orderpriority LIKE '5%' THEN 'low' END"


def _confidence():
    p = F.col("o_orderpriority")
    return F.when(p.startswith("1") | p.startswith("2"), "high").when(p.startswith("3"), "medium").when(p.startswith("5"), "low")


_CASES = """
ln AS (SELECT l_orderkey, list(l_linestatus) AS lines, min(l_shipdate) AS filed FROM lineitem GROUP BY 1),
ca AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, CASE WHEN c_acctbal < 0 THEN ' ' WHEN c_acctbal > 5000 THEN 'noted' END AS note, lines, o_orderdate::DATE AS served, filed::DATE AS filed,
   CASE WHEN c_acctbal > 0 THEN c_acctbal > 7000 END AS rich, CASE WHEN c_mktsegment = 'BUILDING' THEN 'organisation' ELSE 'natural' END AS kind, c_name AS name,
   CASE WHEN o_custkey % 5 <> 0 THEN o_orderdate::DATE - (o_custkey * 20)::INT END AS birth, CASE WHEN o_custkey % 2 = 0 THEN 'agent' END AS rep_name
   FROM orders LEFT JOIN ln ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey),
ok AS (SELECT *, coalesce(trim(o_orderstatus) <> '', false) AS f1, coalesce(trim(c_mktsegment) <> '', false) AS f2, coalesce(trim(note) <> '', false) AS f3, coalesce(len(lines), 0) AS n,
   coalesce(filed >= served, false) AS pok, greatest(datediff('day', served + 30, filed), 0) AS over_days,
   year(served) - year(birth) - CASE WHEN month(served) < month(birth) OR (month(served) = month(birth) AND day(served) < day(birth)) THEN 1 ELSE 0 END AS age,
   CASE WHEN served >= DATE '2023-01-01' THEN 18 ELSE 20 END AS age_limit FROM ca),
rr AS (
 SELECT o_orderkey, 'F01' AS code, 'priority' AS label, 'present' AS "check", CASE WHEN coalesce(trim(o_orderpriority) <> '', false) THEN 'present' ELSE 'missing' END AS status, NULL::VARCHAR AS note FROM ok
 UNION ALL SELECT o_orderkey, 'F02', 'fields', 'all_present', CASE WHEN f1 AND f2 AND f3 THEN 'present' WHEN NOT f1 AND NOT f2 AND NOT f3 THEN 'missing' ELSE 'partial' END, nullif(concat_ws(', ', CASE WHEN NOT f1 THEN 'o_orderstatus' END, CASE WHEN NOT f2 THEN 'c_mktsegment' END, CASE WHEN NOT f3 THEN 'note' END), '') FROM ok
 UNION ALL SELECT o_orderkey, 'F03', 'lines', 'array_min', CASE WHEN n >= 3 THEN 'present' WHEN n = 0 THEN 'missing' ELSE 'partial' END, n::VARCHAR FROM ok
 UNION ALL SELECT o_orderkey, 'F04', 'pattern', 'regex', CASE WHEN o_orderpriority IS NULL THEN 'missing' WHEN regexp_matches(o_orderpriority, '^[1-3]-') THEN 'present' ELSE 'partial' END, NULL FROM ok
 UNION ALL SELECT o_orderkey, 'P01', 'in time', 'date_within', CASE WHEN NOT pok THEN 'unclear' WHEN over_days > 0 THEN 'triggered' ELSE 'no_match' END, CASE WHEN served IS NULL OR filed IS NULL THEN 'a date is missing' WHEN filed < served THEN 'filed before service' ELSE over_days::VARCHAR END FROM ok
 UNION ALL SELECT o_orderkey, 'P02', 'flag', 'flag_triggers', CASE WHEN rich IS NULL THEN 'unclear' WHEN rich THEN 'triggered' ELSE 'no_match' END, NULL FROM ok
 UNION ALL SELECT o_orderkey, 'P03', 'by hand', 'manual', 'need_human', NULL FROM ok
 UNION ALL SELECT o_orderkey, 'P04', 'representative', 'entity_kind', CASE WHEN kind <> 'organisation' OR contains(coalesce(name, ''), '00') THEN 'not_applicable' WHEN rep_name IS NULL THEN 'need_human' ELSE 'no_match' END, CASE WHEN kind = 'organisation' AND NOT contains(coalesce(name, ''), '00') AND rep_name IS NULL THEN nullif(coalesce(name, ''), '') END FROM ok
 UNION ALL SELECT o_orderkey, 'P05', 'age', 'adult_age', CASE WHEN served IS NULL THEN 'unclear' WHEN kind = 'natural' AND age < age_limit THEN 'need_human' WHEN kind = 'natural' AND birth IS NULL THEN 'unclear' ELSE 'no_match' END, CASE WHEN kind = 'natural' AND age < age_limit THEN name END FROM ok
 UNION ALL SELECT o_orderkey, 'X01', 'flag set', 'flag_true', CASE WHEN rich IS NULL THEN 'unclear' WHEN rich THEN 'present' ELSE 'missing' END, NULL FROM ok
 UNION ALL SELECT o_orderkey, 'X02', 'unknown', 'quantum', 'need_human', 'unknown check quantum' FROM ok
 UNION ALL SELECT o_orderkey, 'X03', 'no such field', 'present', 'unclear', 'a field is not there' FROM ok
 UNION ALL SELECT o_orderkey, 'X05', 'no number', 'array_min', 'unclear', 'rule failed: KeyError' FROM ok
 UNION ALL SELECT o_orderkey, 'X06', 'no array', 'array_min', 'unclear', 'rule failed: AnalysisException' FROM ok
 UNION ALL SELECT o_orderkey, 'X07', 'text for a flag', 'flag_true', 'unclear', NULL FROM ok
 UNION ALL SELECT o_orderkey, 'X08', 'no field', 'present', 'unclear', 'rule failed: IndexError' FROM ok
 UNION ALL SELECT o_orderkey, 'X09', 'bad pattern', 'regex', 'unclear', 'rule failed: SparkRuntimeException' FROM ok),
rw AS (SELECT rr.*, CASE code WHEN 'F01' THEN 'art. 1' WHEN 'P01' THEN 'art. 2' END AS basis, code = 'F01' AS curable, CASE code WHEN 'P01' THEN 'holidays are not counted' END AS coverage_note,
  CASE WHEN code IN ('F01', 'F04') THEN o_orderpriority WHEN code IN ('P02', 'X01') THEN rich::VARCHAR WHEN code = 'X07' THEN c_mktsegment END AS value,
  CASE WHEN code = 'F03' THEN n::VARCHAR WHEN code = 'P01' AND pok THEN (served + 30)::VARCHAR END AS computed,
  CASE WHEN code IN ('F01', 'F04') THEN """ + _CONF + """ WHEN code = 'P01' AND o_orderkey % 2 = 0 THEN 'medium' END AS input_confidence
  FROM rr JOIN ok USING (o_orderkey)),
"""


def results(spark, sf_dir):
    return R.run_rules(cases(spark, sf_dir), RULES, "o_orderkey", SURE)


@BOOK.add("d01_run_rules", "WITH " + _CASES + "z AS (SELECT 1) SELECT o_orderkey, code, label, basis, \"check\", status, note, value, computed, curable, coverage_note, input_confidence FROM rw")
def d01(spark, sf_dir):
    return results(spark, sf_dir)


def _one(name: str, code: str) -> None:
    @BOOK.add(name, "WITH " + _CASES + f"z AS (SELECT 1) SELECT o_orderkey, status, note FROM rr WHERE code = '{code}'")
    def run(spark, sf_dir):
        only = [r for r in RULES if r.code == code]
        return R.run_rules(cases(spark, sf_dir), only, "o_orderkey").select("o_orderkey", "status", "note")


for _name, _code in (("d02_present", "F01"), ("d03_all_present", "F02"), ("d04_array_min", "F03"), ("d06_flag_true", "X01"), ("d07_date_within", "P01"), ("d08_manual", "P03"), ("d09_regex", "F04"), ("d10_adult_age", "P05"), ("d11_entity_kind", "P04"), ("d12_flag_triggers", "P02")):
    _one(_name, _code)


@BOOK.add("d05_items_present", """
WITH need(kind, name) AS (VALUES ('R', 'l_linestatus'), ('R', 'mark'), ('N', 'l_linestatus')),
it AS (SELECT l_orderkey AS o_orderkey, l_returnflag, l_partkey, l_linestatus, CASE WHEN l_quantity > 25 THEN 'big' END AS mark FROM lineitem),
pb AS (SELECT o_orderkey, CASE WHEN l_returnflag NOT IN ('R', 'N') THEN l_partkey || ': unknown kind' WHEN l_returnflag = 'R' AND mark IS NULL THEN l_partkey || ': mark' END AS p FROM it),
pr AS (SELECT o_orderkey, count(*) AS n, coalesce(list(p ORDER BY p) FILTER (WHERE p IS NOT NULL), []) AS problems FROM pb GROUP BY 1)
SELECT o.o_orderkey, CASE WHEN n IS NULL THEN 'missing' WHEN len(problems) = 0 THEN 'present' WHEN len(problems) < n THEN 'partial' ELSE 'missing' END AS status, coalesce(problems, []) AS problems FROM orders o LEFT JOIN pr USING (o_orderkey)""")
def d05(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_partkey", "l_linestatus", F.when(F.col("l_quantity") > 25, "big").alias("mark"))
    need = spark.createDataFrame([("R", "l_linestatus"), ("R", "mark"), ("N", "l_linestatus")], "kind string, name string")
    return R.items_present(items, need, "o_orderkey", "l_returnflag", "l_partkey", table(spark, sf_dir, "orders"))


@BOOK.add("d13_lowest_confidence", f"SELECT o_orderkey, CASE WHEN a = 'low' OR b = 'low' THEN 'low' WHEN a = 'medium' OR b = 'medium' THEN 'medium' WHEN a = 'high' OR b = 'high' THEN 'high' END AS confidence FROM (SELECT o_orderkey, {_CONF} AS a, CASE o_orderstatus WHEN 'P' THEN 'medium' WHEN 'F' THEN 'high' END AS b FROM orders)")
def d13(spark, sf_dir):
    other = F.when(F.col("o_orderstatus") == "P", "medium").when(F.col("o_orderstatus") == "F", "high")
    return table(spark, sf_dir, "orders").select("o_orderkey", R.lowest_confidence([_confidence(), other]).alias("confidence"))


_GROUP = "CASE WHEN starts_with(code, 'F') THEN 'format' WHEN starts_with(code, 'P') THEN 'procedure' ELSE 'other' END"


@BOOK.add("d14_result_groups", "WITH " + _CASES + f"z AS (SELECT 1) SELECT {_GROUP} AS grp, status, count(*) AS n FROM rr GROUP BY ALL")
def d14(spark, sf_dir):
    return results(spark, sf_dir).groupBy(R.rule_group(F.col("code")).alias("grp"), "status").agg(F.count(F.lit(1)).alias("n"))


_SUM = "WITH " + _CASES + f"""
rg AS (SELECT rr.*, {_GROUP} AS g, {_CONF} AS conf FROM rr JOIN orders USING (o_orderkey)),
sm AS (SELECT o_orderkey, count(*) FILTER (WHERE g = 'procedure' AND status = 'triggered') AS triggered, count(*) FILTER (WHERE g = 'format' AND status IN ('missing', 'partial')) AS gaps,
  count(*) FILTER (WHERE g = 'procedure' AND status = 'need_human') AS to_decide, coalesce(list(code ORDER BY code) FILTER (WHERE (g = 'procedure' AND status = 'triggered') OR (g = 'format' AND status IN ('missing', 'partial'))), []) AS items,
  count(*) FILTER (WHERE g = 'procedure' AND status = 'triggered' AND conf = 'low') > 0 AS low_confidence FROM rg GROUP BY 1),
"""


@BOOK.add("d15_case_verdict", _SUM + "z AS (SELECT 1) SELECT o_orderkey, CASE WHEN triggered > 0 THEN 'blocked' WHEN gaps > 0 THEN 'warning' WHEN to_decide > 0 THEN 'need_human' ELSE 'ok' END AS verdict, CASE WHEN triggered > 0 THEN 'inadmissible' WHEN gaps > 0 THEN 'amend' ELSE 'substantive' END AS suggestion, triggered, gaps, to_decide, items, low_confidence FROM sm")
def d15(spark, sf_dir):
    c = table(spark, sf_dir, "orders").select("o_orderkey", _confidence().alias("sure"))
    return R.case_verdicts(cases(spark, sf_dir).join(c, "o_orderkey"), RULES, "o_orderkey", "sure")


_EFFECT = f"CASE WHEN status IN ('present', 'no_match', 'not_applicable') THEN 'pass' WHEN {_GROUP} = 'format' AND status IN ('missing', 'partial') THEN 'amend' WHEN {_GROUP} = 'procedure' AND status = 'triggered' THEN 'inadmissible' ELSE 'unknown' END"


@BOOK.add("d16_effects", "WITH " + _CASES + f"z AS (SELECT 1) SELECT o_orderkey, code, {_EFFECT} AS effect FROM rr")
def d16(spark, sf_dir):
    return results(spark, sf_dir).select("o_orderkey", "code", R.effect(F.col("code"), F.col("status")).alias("effect"))


@BOOK.add("d17_default_pick", "WITH " + _CASES + f"""e AS (SELECT *, {_EFFECT} AS effect FROM rr),
p AS (SELECT o_orderkey, code, effect, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE effect WHEN 'inadmissible' THEN 0 ELSE 1 END, "check" = 'manual', code) AS n FROM e WHERE effect IN ('inadmissible', 'amend'))
SELECT o.o_orderkey, p.code AS pick, coalesce(p.effect, 'substantive') AS decision FROM orders o LEFT JOIN p ON o.o_orderkey = p.o_orderkey AND n = 1""")
def d17(spark, sf_dir):
    return R.default_pick(results(spark, sf_dir), "o_orderkey", "code")


@BOOK.add("d18_confirmations", "WITH " + _CASES + f"""
fi AS (SELECT o_orderkey, 'o_orderpriority' AS key, o_orderpriority AS value, {_CONF} AS confidence FROM orders UNION ALL SELECT o_orderkey, 'note', note, 'high' FROM ca UNION ALL SELECT o_orderkey, 'served', served::VARCHAR, CASE WHEN o_orderkey % 9 = 0 THEN 'low' ELSE 'high' END FROM ca),
us(code, key) AS (VALUES ('F01', 'o_orderpriority'), ('F02', 'note'), ('F04', 'o_orderpriority'), ('P01', 'served'), ('P05', 'served'), ('X09', 'note')),
al AS (SELECT o_orderkey, key FROM fi WHERE confidence = 'low' OR (key = 'note' AND NOT coalesce(trim(value) <> '', false)) UNION SELECT o_orderkey, key FROM rr JOIN us USING (code) WHERE status NOT IN ('present', 'no_match', 'not_applicable'))
SELECT o_orderkey, key FROM al""")
def d18(spark, sf_dir):
    fields = {
        "o_orderpriority": (F.col("o_orderpriority"), _confidence()),
        "note": (F.col("note"), F.lit("high")),
        "served": (F.col("served"), F.when(F.col("o_orderkey") % 9 == 0, "low").otherwise("high")),
    }
    return R.case_confirmations(cases(spark, sf_dir), [r for r in RULES if r.enabled], "o_orderkey", fields, [], ["note"])


@BOOK.add("d19_grounds", "WITH " + _CASES + """
b AS (SELECT *, code = 'P01' AS late FROM rr WHERE status IN ('triggered', 'missing', 'partial')), w AS (SELECT *, bool_or(late) OVER (PARTITION BY o_orderkey) AS has FROM b)
SELECT o_orderkey, coalesce(list(code ORDER BY NOT late, code) FILTER (WHERE late OR NOT has), []) AS reasons, list(code ORDER BY NOT late, code) AS grounds, coalesce(list(code ORDER BY NOT late, code) FILTER (WHERE NOT late AND has), []) AS warnings FROM w GROUP BY 1""")
def d19(spark, sf_dir):
    return R.grounds(results(spark, sf_dir), "o_orderkey", "P01")


@BOOK.add("d20_template", "WITH " + _CASES + "z AS (SELECT 1) SELECT o_orderkey, code, 'Case ' || o_orderkey || ', ' || label || ': ' || status || ' (' || coalesce(note, '-') || ')' AS line FROM rr")
def d20(spark, sf_dir):
    line = R.template(["Case ", F.col("o_orderkey"), ", ", F.col("label"), ": ", F.col("status"), " (", F.col("note"), ")"])
    return results(spark, sf_dir).select("o_orderkey", "code", line.alias("line"))


@BOOK.add("d21_case_summary", "WITH " + _CASES + "z AS (SELECT 1) SELECT o_orderkey, coalesce(name, '') AS names, CASE WHEN name IS NULL THEN NULL ELSE 1 END AS people, lines[1] IS NOT NULL AS has_lines, CASE WHEN pok THEN served + 30 END AS deadline, CASE WHEN pok THEN over_days::INT END AS overdue FROM ok")
def d21(spark, sf_dir):
    rows = cases(spark, sf_dir).withColumn("p", R.appeal_period(F.col("served"), F.col("filed")))
    names = F.filter(F.transform("parties", lambda x: x["name"]), lambda n: n.isNotNull())
    return rows.select("o_orderkey", F.array_join(names, ", ").alias("names"), F.nullif(F.size(names), F.lit(0)).alias("people"), F.coalesce(F.get("lines", F.lit(0)).isNotNull(), F.lit(False)).alias("has_lines"), F.col("p.deadline").alias("deadline"), F.col("p.overdue_days").alias("overdue"))


@BOOK.add("d22_intake", r"""
WITH f AS (SELECT page_id, page_id % 20 AS case_id, url, html, lower(regexp_extract(regexp_replace(url, '[?#].*$', ''), '\.([A-Za-z0-9]+)$', 1)) AS extension FROM pages),
g AS (SELECT *, count(*) OVER (PARTITION BY case_id, url) > 1 AS duplicate FROM f),
a AS (SELECT *, coalesce(extension IN ('html', 'pdf'), false) AND NOT duplicate AS accepted FROM g)
SELECT page_id, extension, duplicate, accepted, accepted AND extension = 'html' AS parseable, CASE WHEN duplicate THEN 'name repeated' WHEN NOT accepted THEN 'extension not allowed' WHEN extension <> 'html' THEN 'kept, not read' WHEN trim(coalesce(html, ''), ' ') = '' THEN 'no text in it' END AS error FROM a""")
def d22(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 20).alias("case_id"), "url", "html")
    return R.intake(files, "case_id", "url", ["html", "pdf"], ["html"], "html").select("page_id", "extension", "duplicate", "accepted", "parseable", "error")


@BOOK.add("d23_check_list", "WITH " + _CASES + f"z AS (SELECT 1) SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY CASE {_GROUP} WHEN 'format' THEN 1 WHEN 'procedure' THEN 2 ELSE 3 END, code)::INT AS pos, code, {_EFFECT} AS verdict, concat_ws(' / ', label, note) AS reason FROM rr")
def d23(spark, sf_dir):
    from pyspark.sql import Window as W

    g = R.rule_group(F.col("code"))
    order = F.when(g == "format", 1).when(g == "procedure", 2).otherwise(3)
    pos = F.row_number().over(W.partitionBy("o_orderkey").orderBy(order, "code"))
    return results(spark, sf_dir).select("o_orderkey", pos.alias("pos"), "code", R.effect(F.col("code"), F.col("status")).alias("verdict"), F.concat_ws(" / ", "label", "note").alias("reason"))


@BOOK.add("p01_appeal_period", """
WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderdate::DATE AS s, l_shipdate::DATE AS f FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT *, f >= s AS fine FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, fine AS ok, CASE WHEN fine THEN s + 1 END AS start_from, CASE WHEN fine THEN s + 30 END AS deadline, CASE WHEN fine THEN datediff('day', s, f)::INT END AS day_n, CASE WHEN fine THEN greatest(datediff('day', s + 30, f), 0)::INT END AS overdue_days,
  CASE WHEN fine THEN greatest(datediff('day', f, s + 30), 0)::INT END AS remaining_days, CASE WHEN fine THEN f > s + 30 END AS is_overdue, CASE WHEN NOT fine THEN 'filed before service' END AS reason FROM k""")
def p01(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", R.appeal_period(F.col("o_orderdate"), F.col("l_shipdate")).alias("p")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p.*")


@BOOK.add("p02_amend_deadline", "SELECT o_orderkey, o_orderdate::DATE + 20 AS deadline FROM orders")
def p02(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", R.amend_deadline(F.col("o_orderdate")).alias("deadline"))


@BOOK.add("p03_roc_calendar", "SELECT o_orderkey, printf('%03d-%02d-%02d', year(d) - 1911, month(d), day(d)) AS roc, d AS back, d AS words, NULL::DATE AS wrong, NULL::DATE AS short, NULL::DATE AS mixed FROM (SELECT o_orderkey, o_orderdate::DATE AS d FROM orders)")
def p03(spark, sf_dir):
    day = F.col("o_orderdate").cast("date")
    spelt = lambda form: F.format_string(form, F.year(day) - 1911, F.month(day), F.day(day))
    roc = R.to_roc(day)
    return table(spark, sf_dir, "orders").select("o_orderkey", roc.alias("roc"), R.parse_roc(roc).alias("back"), R.parse_roc(spelt("%d 年 %d 月 %d 號")).alias("words"), R.parse_roc(F.concat(F.left(roc, F.lit(4)), F.lit("02-30"))).alias("wrong"), R.parse_roc(F.concat(F.lit("5-"), F.substring(roc, 5, 5))).alias("short"), R.parse_roc(spelt("%d年%d-%d")).alias("mixed"))
