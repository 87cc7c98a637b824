"""N: canonicalisation and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions.normalize import matching_key
from docket.operators import canonical as C
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()
_MAP = {"a": "e", "i": "y"}


def key(c):
    """White space out, lower case; Latin names need no compatibility forms."""
    return F.lower(matching_key(c, compatible=False))


KEY = r"lower(regexp_replace({0}, '\s+', '', 'g'))"


@BOOK.add("n01_matching_key", r"SELECT p_partkey, translate(regexp_replace(nfc_normalize(p_name), '\s+', '', 'g'), 'ai', 'ey') AS k FROM part")
def n01(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", matching_key(F.col("p_name"), _MAP).alias("k"))


def aliases(spark, sf_dir):
    """Alias table from the parts: upper-cased types of small sizes stand for the type; brands of every kind for themselves."""
    part = table(spark, sf_dir, "part").where(F.col("p_size") <= 10)
    return part.select(F.upper("p_type").alias("alias"), F.col("p_type").alias("target")).distinct()


_ALIAS = "al AS (SELECT DISTINCT upper(p_type) AS alias, p_type AS target FROM part WHERE p_size <= 10)"
_TIERS = f"""
n AS (SELECT alias, min(target) AS target FROM al GROUP BY alias),
k3 AS (SELECT {KEY.format('alias')} AS k, arg_min(target, alias) AS t3 FROM n GROUP BY 1),
t AS (SELECT DISTINCT target AS t4 FROM al),
"""


def tiers_sql(rows: str, value: str, out: str) -> str:
    return f"""{out} AS (SELECT r.*, CASE WHEN coalesce(trim({value}), '') = '' THEN {value} ELSE coalesce(a1.target, a2.target, k3.t3, t.t4, {value}) END AS canonical,
  CASE WHEN coalesce(trim({value}), '') = '' THEN 0 WHEN a1.target IS NOT NULL THEN 1 WHEN a2.target IS NOT NULL THEN 2 WHEN k3.t3 IS NOT NULL THEN 3 WHEN t.t4 IS NOT NULL THEN 4 END AS tier
  FROM {rows} r LEFT JOIN n a1 ON {KEY.format(value)} = a1.alias LEFT JOIN n a2 ON {value} = a2.alias LEFT JOIN k3 ON {KEY.format(value)} = k3.k LEFT JOIN t ON {value} = t.t4)"""


@BOOK.add("n02_canonical_lookup", f"WITH {_ALIAS}, {_TIERS} {tiers_sql('part', 'p_type', 'f')} SELECT p_partkey, p_type, canonical, tier IS NOT NULL AS matched, tier FROM f")
def n02(spark, sf_dir):
    return C.canonical_lookup(table(spark, sf_dir, "part").select("p_partkey", "p_type"), "p_type", aliases(spark, sf_dir), key)


@BOOK.add("n03_rename_units", f"""WITH {_ALIAS}, {_TIERS} u AS (SELECT p_partkey, upper(p_type) AS law, p_size AS article, p_brand || ': ' || upper(p_type) || ', ' || upper(p_type) AS text FROM part), {tiers_sql('u', 'law', 'f')}
SELECT p_partkey, article, law AS law_raw, canonical AS law, canonical || '#' || article AS ref_key, CASE WHEN instr(text, law) > 0 THEN substr(text, 1, instr(text, law) - 1) || canonical || substr(text, instr(text, law) + length(law)) ELSE text END AS text, tier IS NOT NULL AS matched FROM f""")
def n03(spark, sf_dir):
    law = F.upper("p_type")
    units = table(spark, sf_dir, "part").select("p_partkey", law.alias("law"), F.col("p_size").alias("article"), F.concat("p_brand", F.lit(": "), law, F.lit(", "), law).alias("text"))
    return C.rename_units(units, aliases(spark, sf_dir), key)


_STATUS = "(VALUES ('f', 'finished'), ('O', 'open'))"
_FLAG = "(VALUES ('n', 'none'), ('R', 'returned'))"


@BOOK.add("n04_rename_nested", """
SELECT l_orderkey AS k, l_linenumber, l_partkey, l_returnflag, CASE WHEN l_returnflag IN ('R') THEN 'returned' WHEN lower(l_returnflag) IN ('n') THEN 'none' WHEN lower(l_returnflag) = 'r' THEN 'returned' ELSE l_returnflag END AS l_returnflag_canonical,
  CASE lower(o_orderstatus) WHEN 'f' THEN 'finished' WHEN 'o' THEN 'open' ELSE o_orderstatus END AS o_orderstatus_canonical
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def n04(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_returnflag")
    status = spark.createDataFrame([("f", "finished"), ("O", "open")], "alias string, target string")
    flag = spark.createDataFrame([("n", "none"), ("R", "returned")], "alias string, target string")
    return C.rename_nested(orders, lines, "k", "o_orderstatus", "l_returnflag", status, flag, key)


def _names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_name").alias("value")), part.where(F.col("p_size") == 1).select(F.col("p_name").alias("value"))


_NEAR = """
v AS (SELECT DISTINCT p_name AS value FROM part {where} ), kn AS (SELECT DISTINCT p_name AS value FROM part WHERE p_size = 1),
nr AS (SELECT v.value, kn.value AS suggestion, levenshtein(v.value, kn.value) AS distance FROM v JOIN kn ON length(v.value) >= 5 AND abs(length(v.value) - length(kn.value)) <= 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY distance, suggestion) AS pos FROM nr WHERE distance > 0 AND distance / greatest(length(value), length(suggestion)) <= 0.34)
"""


@BOOK.add("n06_near_names", "WITH " + _NEAR.format(where="") + " SELECT value, suggestion, distance::INT AS distance, pos::INT AS pos FROM rk WHERE pos <= 3")
def n06(spark, sf_dir):
    return C.near_names(*_names(spark, sf_dir))


@BOOK.add("n05_unknown_triage", "WITH c AS (SELECT p_name AS value, count(*) AS n FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_size = 1) GROUP BY 1), " + _NEAR.format(where="") + " SELECT c.value, n, CASE WHEN suggestion IS NULL THEN 'info' ELSE 'warning' END AS level, suggestion, distance::INT AS distance FROM c LEFT JOIN rk ON c.value = rk.value AND pos = 1")
def n05(spark, sf_dir):
    return C.triage(*_names(spark, sf_dir))


@BOOK.add("n07_alias_candidates", f"WITH {_NEAR.format(where='')}, kk AS (SELECT {KEY.format('value')} AS k, min(value) AS same_key FROM kn GROUP BY 1)" + f""",
j AS (SELECT v.value, e.value AS exact, same_key FROM v LEFT JOIN kn e ON v.value = e.value LEFT JOIN kk ON {KEY.format('v.value')} = kk.k)
SELECT j.value, CASE WHEN exact IS NOT NULL THEN 'exact' WHEN same_key IS NOT NULL THEN 'char_only' WHEN suggestion IS NOT NULL THEN 'needs_review' ELSE 'no_authority' END AS status,
  coalesce(exact, same_key, suggestion) AS candidate, exact IS NOT NULL OR same_key IS NOT NULL AS auto_safe FROM j LEFT JOIN rk ON j.value = rk.value AND pos = 1 AND exact IS NULL AND same_key IS NULL""")
def n07(spark, sf_dir):
    return C.alias_candidates(*_names(spark, sf_dir), key)


@BOOK.add("n08_validate_units", r"""
WITH d AS (SELECT text, doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS again, lang, n_chars FROM documents)
SELECT md5(text) AS text_key, doc_id, unnest(list_filter([CASE WHEN text IS NULL THEN 'missing_key' END, CASE WHEN text IS NOT NULL AND again THEN 'duplicate_key' END,
  CASE WHEN n_chars < 60 THEN 'empty_text' END, CASE WHEN regexp_matches(text, '!!|\|') THEN 'deleted_shell' END, CASE WHEN lang NOT IN ('en', 'de', 'fr') THEN 'bad_unit_type' END], lambda x: x IS NOT NULL)) AS problem FROM d""")
def n08(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("text_key", F.md5("text"))
    checks = {"empty_text": F.col("n_chars") < 60, "deleted_shell": F.col("text").rlike(r"!!|\|"), "bad_unit_type": ~F.col("lang").isin("en", "de", "fr")}
    return C.validate_units(docs, "text_key", "doc_id", checks)


@BOOK.add("n09_flatten_claims", """
SELECT printf('%d#claim#%02d', conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT) AS ref_key, 'claim' AS unit_type, conv_id::VARCHAR AS case_no, text FROM conversations WHERE role <> 'system'
UNION ALL SELECT printf('%d#reason#%02d', doc_id, 1), 'reason', source, text FROM documents WHERE lang = 'en'""")
def n09(spark, sf_dir):
    from pyspark.sql import Window as W

    talk = table(spark, sf_dir, "conversations").where(F.col("role") != "system")
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy("turn"))
    claims = talk.select(F.format_string("%d#claim#%02d", "conv_id", nth).alias("ref_key"), F.lit("claim").alias("unit_type"), F.col("conv_id").cast("string").alias("case_no"), "text")
    reasons = table(spark, sf_dir, "documents").where(F.col("lang") == "en").select(F.format_string("%d#reason#%02d", "doc_id", F.lit(1)).alias("ref_key"), F.lit("reason").alias("unit_type"), F.col("source").alias("case_no"), "text")
    return claims.unionByName(reasons, allowMissingColumns=True)


_USE = r"""
w AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '\p{L}+'))) AS name FROM documents),
kw AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS name FROM benchmark),
s AS (SELECT DISTINCT doc_id, name FROM w WHERE name IN (SELECT name FROM kw) AND length(name) >= 6)
"""


def _in_use(spark, sf_dir):
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    used = table(spark, sf_dir, "documents").select("doc_id", F.explode(words).alias("name")).where(F.length("name") >= 6)
    known = table(spark, sf_dir, "benchmark").select(F.explode(words).alias("name"))
    return used, known


@BOOK.add("n10_names_in_use", "WITH " + _USE + " SELECT doc_id, name FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.name <> s.name AND ends_with(o.name, s.name))")
def n10(spark, sf_dir):
    return C.names_in_use(*_in_use(spark, sf_dir), "doc_id").select("doc_id", "name")


@BOOK.add("n11_hint_precedence", "WITH " + _USE + """,
a AS (SELECT doc_id, list(DISTINCT name ORDER BY name) AS a FROM s WHERE NOT EXISTS (SELECT 1 FROM s o WHERE o.doc_id = s.doc_id AND o.name <> s.name AND ends_with(o.name, s.name)) GROUP BY 1),
b AS (SELECT doc_id, [source] AS b FROM documents)
SELECT d.doc_id, CASE WHEN len(a) > 0 THEN a ELSE coalesce(b, []) END AS hints, CASE WHEN len(a) > 0 THEN 'verified' WHEN len(b) > 0 THEN 'source' END AS source FROM documents d LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id)""")
def n11(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = C.names_in_use(*_in_use(spark, sf_dir), "doc_id")
    return C.hint_precedence(docs, first, docs.select("doc_id", F.col("source").alias("name")), "doc_id", ("verified", "source"))
