"""R: report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import reports as R
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()


@BOOK.add("r01_corpus_report", "SELECT CASE WHEN grouping(source) = 0 THEN 'source' WHEN grouping(lang) = 0 THEN 'lang' ELSE 'total' END AS grp, coalesce(source, lang) AS value, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source), (lang), ())")
def r01(spark, sf_dir):
    return R.corpus_report(table(spark, sf_dir, "documents"), ["source", "lang"])


@BOOK.add("r02_rank_composition", "SELECT label, count(*) AS n, count(*) FILTER (WHERE vec_id % 2 = 0) AS claims FROM embeddings GROUP BY 1")
def r02(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % 2 == 0).alias("claims"))


_T = "CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END"


@BOOK.add("r03_outcome_tally", f"WITH t AS (SELECT o_custkey, coalesce({_T}, 'unknown') AS outcome FROM orders) SELECT o_custkey, outcome, count(*) AS n FROM t GROUP BY ALL UNION ALL SELECT NULL, outcome, count(*) FROM t GROUP BY outcome")
def r03(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("outcome"))
    return R.tally(rows, "o_custkey", "outcome")


@BOOK.add("r04_quality_report", "WITH d AS (SELECT *, n_chars >= 100 AND lang IS NOT NULL AS fine FROM documents) SELECT source, count(*) AS n, count(*) FILTER (WHERE fine) AS complete, min(n_chars) AS least, list_sort(list(n_chars))[len(list(n_chars)) // 2 + 1] AS median, max(n_chars) AS most, coalesce(list(doc_id ORDER BY doc_id) FILTER (WHERE NOT fine), [])[1:5] AS bad FROM d GROUP BY 1")
def r04(spark, sf_dir):
    fine = (F.col("n_chars") >= 100) & F.col("lang").isNotNull()
    return R.quality_report(table(spark, sf_dir, "documents"), "source", fine, F.col("doc_id"), "n_chars")


@BOOK.add("r04_by_year", "SELECT year(o_orderdate)::INT AS period, count(*) AS n, count(*) FILTER (WHERE o_orderstatus <> 'P') AS substantive, count(*) FILTER (WHERE o_orderstatus = 'P') AS other, year(o_orderdate) IN (1992, 1993, 1994) AS indexed FROM orders GROUP BY ALL")
def r04_by_year(spark, sf_dir):
    return R.by_period(table(spark, sf_dir, "orders"), F.year("o_orderdate"), F.col("o_orderstatus") != "P", [1992, 1993, 1994])


@BOOK.add("r04_compound_cases", "WITH c AS (SELECT l_orderkey, list(DISTINCT l_linestatus ORDER BY l_linestatus) AS clauses, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS results FROM lineitem GROUP BY 1) SELECT * FROM c WHERE len(clauses) > 1 OR len(results) > 1")
def r04_compound(spark, sf_dir):
    return R.compound_cases(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linestatus", "l_returnflag")


@BOOK.add("r05_law_report", "SELECT source, count(*) AS articles, count(*) FILTER (WHERE contains(text, '!!')) AS deleted, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source)")
def r05(spark, sf_dir):
    return R.with_total(table(spark, sf_dir, "documents"), "source", [F.count(F.lit(1)).alias("articles"), F.count_if(F.col("text").contains("!!")).alias("deleted"), F.sum("n_chars").alias("chars")])


@BOOK.add("r06_chunk_report", "WITH c AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) SELECT doc_id, count(*) AS chunks, max(length(l))::INT AS longest, count(*) FILTER (WHERE length(l) > 800) AS over FROM c GROUP BY 1")
def r06(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("l")).alias("longest"), F.count_if(F.length("l") > 800).alias("over"))


@BOOK.add("r07_call_accounting", "SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS tokens, max(value) > 50 AS used FROM events GROUP BY ALL")
def r07(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("calls"), F.round(F.sum("value"), 4).alias("tokens"), (F.max("value") > 50).alias("used"))


@BOOK.add("r08_claim_kinds", "WITH c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS \"user\", count(*) FILTER (WHERE role = 'assistant') AS assistant, count(*) FILTER (WHERE role = 'system') AS system, count(*) FILTER (WHERE length(text) < 60) AS low FROM conversations GROUP BY 1) SELECT *, CASE WHEN \"user\" = 0 THEN 'no user' WHEN assistant = 0 THEN 'no assistant' WHEN low > 0 THEN 'check' ELSE 'ok' END AS verdict FROM c")
def r08(spark, sf_dir):
    return R.side_verdict(table(spark, sf_dir, "conversations"), "conv_id", "role", ["user", "assistant", "system"], F.length("text") < 60)


@BOOK.add("r09_check_totals", "WITH s AS (SELECT source, contains(text, '!!') AS a, n_chars < 60 AS b, lang <> 'en' AND contains(text, ' the ') AS route FROM documents) SELECT source, count(*) FILTER (WHERE a) AS shouting, count(*) FILTER (WHERE b) AS short, count(*) FILTER (WHERE route) AS route, CASE WHEN count(*) FILTER (WHERE route) > 0 THEN 'route conflict' WHEN count(*) FILTER (WHERE a OR b) > 0 THEN 'problem' ELSE 'ok' END AS verdict FROM s GROUP BY 1")
def r09(spark, sf_dir):
    a, b = F.col("text").contains("!!"), F.col("n_chars") < 60
    route = (F.col("lang") != "en") & F.col("text").contains(" the ")
    out = table(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(a).alias("shouting"), F.count_if(b).alias("short"), F.count_if(route).alias("route"), F.count_if(a | b).alias("_any"))
    verdict = F.when(F.col("route") > 0, "route conflict").when(F.col("_any") > 0, "problem").otherwise("ok")
    return out.withColumn("verdict", verdict).drop("_any")


@BOOK.add("r10_top_n", "SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id)::INT AS pos FROM documents QUALIFY pos <= 3")
def r10(spark, sf_dir):
    from pyspark.sql import Window as W

    pos = F.row_number().over(W.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id"))
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", pos.alias("pos")).where("pos <= 3")


@BOOK.add("r11_newest_first", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC NULLS LAST, o_orderkey) AS pos FROM orders")
def r11(spark, sf_dir):
    return R.newest_first(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey").select("o_orderkey", "pos")


@BOOK.add("r12_first_seen", r"WITH w AS (SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS word FROM (SELECT doc_id, regexp_extract_all(text, '\p{L}+') AS a FROM documents)), f AS (SELECT doc_id, word, min(i) AS i FROM w GROUP BY ALL) SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i)::INT AS pos FROM f")
def r12(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("i", "word"))
    return R.first_seen(words, "word", ["i"], ["doc_id"])


@BOOK.add("r13_set_operations", r"WITH k AS (SELECT d.doc_id, list_filter(list_distinct(regexp_extract_all(d.text, '\p{L}+')), lambda x: length(x) = 3) AS a, list_filter(list_distinct(regexp_extract_all(b.text, '\p{L}+')), lambda x: length(x) = 3) AS b FROM documents d JOIN benchmark b ON d.doc_id % 40 = b.item_id) SELECT doc_id, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a, list_sort(list_filter(a, lambda x: list_contains(b, x))) AS shared, len(list_distinct(a || b))::INT AS together FROM k")
def r13(spark, sf_dir):
    pick = lambda c: F.filter(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\p{L}+"), F.lit(0))), lambda x: F.length(x) == 3)
    bench = table(spark, sf_dir, "benchmark").select("item_id", pick("text").alias("b"))
    rows = table(spark, sf_dir, "documents").select("doc_id", pick("text").alias("a")).join(bench, F.col("doc_id") % 40 == F.col("item_id"))
    return rows.select("doc_id", F.array_sort(F.array_except("a", "b")).alias("only_a"), F.array_sort(F.array_intersect("a", "b")).alias("shared"), F.size(F.array_union("a", "b")).alias("together"))


@BOOK.add("r14_value_frequency", "SELECT p_brand AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS pos FROM part GROUP BY 1")
def r14(spark, sf_dir):
    return R.frequency(table(spark, sf_dir, "part"), "p_brand")
