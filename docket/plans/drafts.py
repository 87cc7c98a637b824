"""Q: draft quality queries. A section is a document; its case is its source."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import drafts as D
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


_WORDS = ["the", "that", "this", "les", "des", "der", "und", "los"]
_CITES = r"list_filter(list_distinct(regexp_extract_all(text, '\p{L}+')), lambda x: list_contains(['the', 'that', 'this', 'les', 'des', 'der', 'und', 'los'], x))"


@BOOK.add("q01_citations_outside", f"WITH k AS (SELECT source, list(DISTINCT lang || 'x') AS okk FROM documents GROUP BY 1), a(lang, ref_key) AS (VALUES ('en', 'the'), ('en', 'that'), ('fr', 'les'), ('de', 'der')), al AS (SELECT DISTINCT source, ref_key FROM documents JOIN a USING (lang) WHERE n_chars > 4000), o AS (SELECT source, list(ref_key) AS okk FROM al GROUP BY 1), c AS (SELECT doc_id, source, {_CITES} AS citations FROM documents) SELECT doc_id, list_sort(list_filter(citations, lambda x: NOT list_contains(coalesce(okk, []), x))) AS outside, len(list_filter(citations, lambda x: list_contains(coalesce(okk, []), x))) = 0 AS no_source FROM c LEFT JOIN o USING (source)")
def q01(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    a = F.broadcast(spark.createDataFrame([("en", "the"), ("en", "that"), ("fr", "les"), ("de", "der")], "lang string, ref_key string"))
    allowed = docs.where("n_chars > 4000").join(a, "lang").select("source", "ref_key").distinct()
    cites = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))), lambda w: w.isin(*_WORDS))
    out = D.citations_outside(docs.select("doc_id", "source", cites.alias("citations")), allowed, "source")
    return out.select("doc_id", F.array_sort("outside").alias("outside"), "no_source")


_PAT = r"([A-Z][a-z]+) ([a-z]+),? ?(of|the)?"


@BOOK.add("q02_text_citations", f"""
WITH g AS (SELECT doc_id, regexp_extract_all(text, '{_PAT}', 1) AS n, regexp_extract_all(text, '{_PAT}', 2) AS a, regexp_extract_all(text, '{_PAT}', 3) AS s FROM documents),
e AS (SELECT doc_id, generate_subscripts(n, 1) AS i, unnest(n) AS n, unnest(a) AS a, unnest(s) AS s FROM g),
k AS (SELECT doc_id, i, n || '#' || a || CASE WHEN s <> '' THEN '-' || s ELSE '' END AS c FROM e WHERE NOT regexp_matches(n, '^(The|This)$')),
d AS (SELECT doc_id, c, min(i) AS i FROM k GROUP BY ALL)
SELECT documents.doc_id, coalesce(list(c ORDER BY i) FILTER (WHERE c IS NOT NULL), []) AS cites FROM documents LEFT JOIN d USING (doc_id) GROUP BY 1""")
def q02(spark, sf_dir):
    return D.text_citations(_docs(spark, sf_dir), _PAT, "^(The|This)$", ["doc_id"])


_NAMES = r"SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS name FROM documents WHERE lang = 'en') WHERE regexp_matches(name, '^[a-z]{6,14}$')"
_KNOWN = r"SELECT DISTINCT name FROM (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS name FROM benchmark) WHERE regexp_matches(name, '^[a-z]{4,14}$')"


@BOOK.add("q03_repair_names", rf"""
WITH n AS ({_NAMES}), k AS ({_KNOWN}),
s AS (SELECT name, list_filter([substr(name, i) FOR i IN range(1, length(name))], lambda t: length(t) >= 2 AND regexp_full_match(substr(name, 1, length(name) - length(t)), '(?:the|an|of)*')) AS tails FROM n),
bb AS (SELECT name, list_reduce(tails, lambda x, y: CASE WHEN length(y) < length(x) THEN y ELSE x END) AS base FROM s),
t AS (SELECT name AS nm, CASE WHEN length(base) >= 3 THEN substr(base, i) ELSE base END AS kk FROM bb, range(1, 20) r(i) WHERE i <= greatest(length(base) - 2, 1)),
best AS (SELECT nm, arg_max(k.name, length(k.name)) AS best FROM t JOIN k ON kk = k.name GROUP BY 1)
SELECT bb.name, coalesce(k.name, best, bb.name) AS repaired FROM bb LEFT JOIN k ON base = k.name LEFT JOIN best ON best.nm = bb.name""")
def q03(spark, sf_dir):
    words = F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("name")
    names = _docs(spark, sf_dir).where("lang = 'en'").select(words).where(F.col("name").rlike("^[a-z]{6,14}$"))
    return D.repair_names(names, table(spark, sf_dir, "benchmark").select(words).where(F.col("name").rlike("^[a-z]{4,14}$")), ["the", "an", "of"])


_SQ = r"regexp_replace({0}, '\s+', '', 'g')"
_DP = r"regexp_replace({0}, '[\p{{P}}\p{{S}}]', '', 'g')"


@BOOK.add("q04_verify_quotes", rf"""
WITH q AS (SELECT item_id AS quote_id, text AS quote, CASE WHEN item_id % 3 = 0 THEN [] ELSE [item_id::VARCHAR] END AS cited, {_SQ.format('text')} AS piece FROM benchmark),
s AS (SELECT doc_id::VARCHAR AS ref_key, {_SQ.format('text')} AS body FROM documents),
v AS (SELECT quote_id, list_contains(cited, ref_key) AS own, ref_key FROM q JOIN s ON length(piece) >= 8 AND contains(body, piece)),
a AS (SELECT quote_id, bool_or(own) AS own, min(ref_key) FILTER (WHERE own) AS here, min(ref_key) AS there FROM v GROUP BY 1),
l AS (SELECT quote_id, min(ref_key) AS loose FROM q JOIN s ON length(piece) >= 8 AND contains({_DP.format('body')}, {_DP.format('piece')}) GROUP BY 1)
SELECT q.quote_id, CASE WHEN length(quote) < 12 THEN 'emphasis' WHEN own THEN 'verbatim' WHEN there IS NOT NULL THEN 'misattributed' WHEN loose IS NOT NULL THEN 'same_without_punctuation' ELSE 'not_found' END AS result, CASE WHEN own THEN here ELSE coalesce(there, loose) END AS found_in,
  CASE WHEN length(quote) >= 12 AND own IS NULL AND there IS NULL AND loose IS NULL AND EXISTS (SELECT 1 FROM documents WHERE doc_id::VARCHAR = cited[1] AND length(text) >= 600) THEN cited ELSE [] END AS cited_truncated
FROM q LEFT JOIN a USING (quote_id) LEFT JOIN l USING (quote_id)""")
def q04(spark, sf_dir):
    own = F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.col("item_id").cast("string")))
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"), own.alias("cited"))
    return D.verify_quotes(quotes, _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("ref_key"), "text"))


@BOOK.add("q05_fragments", rf"SELECT doc_id, list_filter(list_transform(string_split(text, '.'), lambda p: {_SQ.format('p')}), lambda p: length(p) >= 8) AS fragments FROM documents")
def q05(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.fragments(F.col("text"), r"\.").alias("fragments"))


_CONC = "CASE WHEN quality = 1 THEN 'has merit' WHEN toxic = 1 THEN 'without merit' WHEN quality = 0 THEN 'undecided' END"


def _concluded(spark, sf_dir):
    c = F.when(F.col("quality") == 1, "has merit").when(F.col("toxic") == 1, "without merit").when(F.col("quality") == 0, "undecided")
    return _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "source", "lang", "text", "n_chars", c.alias("conclusion"))


@BOOK.add("q06_deferrals", f"WITH c AS (SELECT doc_id, text, {_CONC} AS conclusion FROM documents LEFT JOIN labels USING (doc_id)) SELECT doc_id, CASE WHEN conclusion IN ('has merit', 'without merit') THEN nullif(regexp_extract(text, 'and (?:of|the) [a-z]+'), '') END AS deferral FROM c")
def q06(spark, sf_dir):
    return _concluded(spark, sf_dir).select("doc_id", D.deferrals(F.col("text"), F.col("conclusion"), "and (?:of|the) [a-z]+").alias("deferral"))


@BOOK.add("q07_headline_conflicts", """
WITH p AS (SELECT l_orderkey, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_linestatus = 'F'), []) AS merit, coalesce(list(l_linenumber ORDER BY l_linenumber) FILTER (WHERE l_returnflag = 'N'), []) AS undecided FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey, merit, undecided, CASE WHEN o_orderstatus = 'O' AND len(merit) > 0 THEN 'merit' WHEN o_orderstatus = 'O' AND len(undecided) > 0 THEN 'undecided' END AS conflict FROM orders LEFT JOIN p ON o_orderkey = l_orderkey)
SELECT o_orderkey, conflict, CASE conflict WHEN 'merit' THEN merit WHEN 'undecided' THEN undecided END AS numbers FROM c""")
def q07(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("no"), "l_linestatus", "l_returnflag")
    return D.headline_conflicts(table(spark, sf_dir, "orders"), lines, "o_orderkey", F.col("o_orderstatus") == "O", F.col("l_linestatus") == "F", F.col("l_returnflag") == "N")


@BOOK.add("q08_outside_domain", "SELECT event_id, event_type, event_type IS NOT NULL AND event_type NOT IN ('click', 'view') AS outside FROM events")
def q08(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", D.outside_domain(F.col("event_type"), ["click", "view"]).alias("outside"))


_TERMS = {"mail": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "licence": r"[Ll]icensed under [A-Z][^\n.]*", "number": r"[0-9]{3}-[0-9]{3,4}", "key": r"(?:sk|AKIA|ghp)[A-Za-z0-9_-]{8,}"}


@BOOK.add("q09_forbidden_terms", "SELECT doc_id, why, found FROM (" + " UNION ALL ".join(f"SELECT doc_id, '{w}' AS why, regexp_extract(text, '{p}') AS found FROM documents WHERE regexp_matches(text, '{p}')" for w, p in _TERMS.items()) + ")")
def q09(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.explode(D.forbidden_terms(F.col("text"), _TERMS)).alias("t")).select("doc_id", "t.*")


@BOOK.add("q10_route_words", "SELECT doc_id, CASE WHEN lang = 'en' THEN list_filter([' the ', ' of ', ' und '], lambda w: contains(text, w)) ELSE [] END AS words FROM documents")
def q10(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", D.route_words(F.col("text"), [" the ", " of ", " und "], F.col("lang") == "en").alias("words"))


@BOOK.add("q11_headline_check", "SELECT conv_id, turn, CASE WHEN head IS NULL OR trim(head) = '' THEN 'empty' WHEN length(head) > 60 THEN 'too long' WHEN route = 'inadmissible' AND NOT regexp_matches(head, 'the') THEN 'route dismisses, headline does not' WHEN route = 'substantive' AND regexp_matches(head, 'the') THEN 'headline dismisses, route does not' END AS problem FROM (SELECT conv_id, turn, split_part(text, '.', 1) AS head, CASE WHEN conv_id % 2 = 0 THEN 'inadmissible' ELSE 'substantive' END AS route FROM conversations)")
def q11(spark, sf_dir):
    route = F.when(F.col("conv_id") % 2 == 0, "inadmissible").otherwise("substantive")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", D.headline_check(F.split_part("text", F.lit("."), F.lit(1)), route, "the").alias("problem"))


@BOOK.add("q12_replace_flagged", "SELECT doc_id, CASE WHEN regexp_matches(text, '!!') THEN 'withdrawn' ELSE text END AS text, CASE WHEN regexp_matches(text, '!!') THEN text END AS original FROM documents")
def q12(spark, sf_dir):
    bad = F.col("text").rlike("!!")
    return _docs(spark, sf_dir).select("doc_id", F.when(bad, "withdrawn").otherwise(F.col("text")).alias("text"), F.when(bad, F.col("text")).alias("original"))


@BOOK.add("q13_alerts", f"""WITH c AS (SELECT doc_id, CASE WHEN {_CONC} = 'undecided' THEN 'open' END AS w1, CASE WHEN n_chars < 100 THEN n_chars END AS w2, CASE WHEN contains(text, '!!') THEN 'shouts' END AS w3 FROM documents LEFT JOIN labels USING (doc_id))
SELECT doc_id, 1 AS pos, 'blocking' AS level, 'undecided' AS label, w1 AS detail FROM c WHERE w1 IS NOT NULL UNION ALL SELECT doc_id, 2, 'warn', 'short', w2::VARCHAR FROM c WHERE w2 IS NOT NULL UNION ALL SELECT doc_id, 3, 'warn', 'tone', w3 FROM c WHERE w3 IS NOT NULL""")
def q13(spark, sf_dir):
    rows = _concluded(spark, sf_dir).select("doc_id", F.when(F.col("conclusion") == "undecided", "open").alias("w1"), F.when(F.col("n_chars") < 100, F.col("n_chars")).alias("w2"), F.when(F.col("text").contains("!!"), "shouts").alias("w3"))
    return D.alerts(rows, ["doc_id"], {"w1": ("blocking", "undecided"), "w2": ("warn", "short"), "w3": ("warn", "tone")})


@BOOK.add("q14_applicable_line", "SELECT doc_id, CASE WHEN lang = 'en' AND contains(text, ' the ') THEN 'article 77' WHEN lang = 'en' THEN 'article 81' ELSE 'article 79' END AS law, coalesce(nullif(trim(split_part(text, chr(10), 1), ' '), ''), nullif(source, ''), 'untitled') AS gist FROM documents")
def q14(spark, sf_dir):
    law = F.when((F.col("lang") == "en") & F.col("text").contains(" the "), "article 77").when(F.col("lang") == "en", "article 81").otherwise("article 79")
    gist = F.coalesce(F.nullif(F.trim(F.substring_index("text", "\n", 1)), F.lit("")), F.nullif(F.col("source"), F.lit("")), F.lit("untitled"))
    return _docs(spark, sf_dir).select("doc_id", law.alias("law"), gist.alias("gist"))


@BOOK.add("q15_outcome_guess", "SELECT doc_id, CASE WHEN contains(text, 'scum') THEN 'dismissed' WHEN contains(text, '!!') THEN 'upheld' WHEN contains(text, ' the ') THEN 'partly' ELSE 'unknown' END AS outcome FROM documents")
def q15(spark, sf_dir):
    rules = [("scum", "dismissed"), ("!!", "upheld"), (" the ", "partly")]
    return _docs(spark, sf_dir).select("doc_id", D.first_word_rule(F.col("text"), rules, "unknown").alias("outcome"))
