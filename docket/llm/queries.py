"""The operators on their whole tables, and their SQL where it can say the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docket.llm import ann, bm25, collisions, divergence, langid, linededup, mixing, packing, prefixtrie, simhash, tokenfile, toxicity, urlfilter
from docket.llm.urlfilter import Rule
from docket.session import scratch_root, ship_package
from docket.sources.tables import table

URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def fold(key: str, n: int) -> Column:
    """CRC-32 of the id's text, modulo n."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return table(spark, sf_dir, "documents")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir))


def toxicity_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Model:
    """Learnt from the labelled rows of ``docs`` outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return toxicity.fit(docs.where(fold("doc_id", 3) != 1), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    scored = toxicity.score(docs, toxicity_model(spark, docs, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = langid.fit(docs.where(fold("doc_id", 5) != 0))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    judged = urlfilter.judge(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "text", "removed_lines")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_documents(spark, sf_dir))
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), F.col("mix_taken").alias("taken"))


def op7_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.pmod(F.col("vec_id"), F.lit(20)) == 0)


def op8_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 20 is a query, its whole text, against all documents."""
    docs = _documents(spark, sf_dir)
    asked = docs.where(F.pmod(F.col("doc_id"), F.lit(20)) == 0).select(F.col("doc_id").alias("query_id"), "text")
    return bm25.search(docs, asked)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    tokenfile.write_tokens(_documents(spark, sf_dir), path)
    return tokenfile.read_tokens(spark, path)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source against the others of its language, over all documents."""
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the prefix tree of all rebuilt conversations."""
    out = prefixtrie.conversation_trie(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more inside a label, over all vectors."""
    out = collisions.near_duplicates(table(spark, sf_dir, "embeddings"))
    return out.withColumnRenamed("id", "vec_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_toxicity": op2_toxicity,
    "op3_language_id": op3_language_id,
    "op4_url_filters": op4_url_filters,
    "op5_line_dedup": op5_line_dedup,
    "op6_mixing": op6_mixing,
    "op7_multiprobe_neighbours": op7_multiprobe_neighbours,
    "op8_bm25_top_k": op8_bm25_top_k,
    "op9_simhash": op9_simhash,
    "op10_token_files": op10_token_files,
    "op11_source_divergence": op11_source_divergence,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_collision_counting": op13_collision_counting,
}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op6_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((rn - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / weight AS ratio FROM w),
l AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
        / sum(weight) OVER (ORDER BY ratio, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
f AS (SELECT arg_min(level, (ratio, rn)) FILTER (WHERE ratio >= level) AS lev FROM l),
t AS (SELECT source, source_size, CASE WHEN lev IS NULL THEN cap ELSE least(cap, lev * weight) END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
g AS (SELECT source, h, sum(size) AS n FROM d GROUP BY source, h),
c AS (SELECT g.source, h, n, sum(n) OVER (PARTITION BY g.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM g),
k AS (SELECT c.source, h, p.target - p.base * p.source_size AS budget, upto, upto - n AS under FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source),
x AS (SELECT source, h, (upto <= budget OR (under <= budget AND budget < upto AND upto + under <= 2 * budget)) AS more FROM k)
SELECT d.doc_id, d.size, p.source_size, p.target, (d.size * (p.base + CASE WHEN x.more THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source JOIN x ON d.source IS NOT DISTINCT FROM x.source AND d.h = x.h
"""

ORACLE_SQL["op4_url_filters"] = r"""
WITH RECURSIVE a AS (
  SELECT page_id, url, html, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
tags AS (
  SELECT url, unnest(regexp_extract_all(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical["'']?[^>]*>')
         || regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh["'']?[^>]*>')) AS tag
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL),
hrefs AS (
  SELECT url, coalesce(nullif(regexp_extract(tag, '(?is)href\s*=\s*["'']?([^"''\s>]+)', 1), ''), nullif(regexp_extract(tag, '(?is)url\s*=\s*["'']?([^"''\s>]+)', 1), '')) AS href FROM tags),
told AS (
  SELECT url, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN 'http:' || href
    WHEN starts_with(href, '/') THEN regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || href
    ELSE coalesce(nullif(regexp_extract(url, '^((?s:.*?)://[^?#]*/)', 1), ''), regexp_extract(url, '^((?s:.*?)://[^/?#]*)', 1) || '/') || href END AS target
  FROM hrefs WHERE href IS NOT NULL),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT target FROM told) WHERE url IS NOT NULL),
q AS (SELECT url, translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
   regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '(^|&)(utm_[^&=]*|ref|fbclid|gclid)=[^&]*', '', 'g'), '^&+', '') AS query FROM urls),
keys AS (SELECT url, host, path, CASE WHEN host <> '' THEN host || regexp_replace(path, '/+$', '') || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key FROM q),
rules(rule, rhost, rpath, verdict) AS (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
   ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')),
own AS (SELECT k.url, k.key, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
   FROM keys k LEFT JOIN rules r ON (k.host = r.rhost OR ends_with(k.host, '.' || r.rhost)) AND starts_with(k.path, r.rpath) GROUP BY 1, 2),
edges AS (SELECT a.key AS u, b.key AS v FROM told t JOIN keys a ON t.url = a.url JOIN keys b ON t.target = b.url WHERE a.key IS NOT NULL AND b.key IS NOT NULL),
both_ways AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
spread(node) AS (SELECT DISTINCT key FROM own WHERE verdict = 'block' AND key IS NOT NULL UNION SELECT e.v FROM spread s JOIN both_ways e ON s.node = e.u)
SELECT a.page_id, a.host, a.path, o.rule, coalesce(o.verdict, CASE WHEN o.key IN (SELECT node FROM spread) THEN 'block' ELSE 'allow' END) AS verdict
FROM a LEFT JOIN own o ON a.url = o.url
"""

ORACLE_SQL["op8_bm25_top_k"] = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT count(*)::DOUBLE AS n, greatest(1.0::DOUBLE, sum(len(w))::DOUBLE / count(*)) AS avgdl FROM t),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM t) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT doc_id AS query_id, term, tf AS qtf FROM p WHERE doc_id % 20 = 0),
r AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), s GROUP BY query_id, doc_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM r WHERE score > 0 QUALIFY rank <= 10
"""

ORACLE_SQL["op13_collision_counting"] = r"""
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
u AS (SELECT * FROM e WHERE len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
      WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
r(node, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, p.y FROM r JOIN p ON r.other = p.x),
c AS (SELECT node, min(other) AS component_id FROM r GROUP BY node),
n AS (SELECT x, count(*) AS n_links FROM p GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON vec_id = node LEFT JOIN n ON vec_id = x
"""

ORACLE_SQL["op12_prefix_trie"] = r"""
WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text
           FROM conversations WHERE conv_id IS NOT NULL),
h AS (SELECT conv_id, conv_id - conv_id % 20 AS family,
        list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
          lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
      FROM (SELECT DISTINCT conv_id FROM s)),
c AS (SELECT conv_id, family, xor(crc, 4294967295) % 4 AS h FROM h),
k AS (SELECT c.conv_id, 0 AS part, s.pos, role, text FROM c JOIN s ON s.conv_id = c.family AND s.pos <= c.h
      UNION ALL SELECT c.conv_id, 1, s.pos, role, text FROM c JOIN s ON s.conv_id = c.conv_id AND s.pos > c.h),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM k),
p AS (SELECT conv_id, depth, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS words,
        list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS path FROM r
      UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, depth, words, sha256(path::VARCHAR || len(path)) AS node FROM p),
l AS (SELECT conv_id, max(depth) AS length FROM m GROUP BY conv_id),
n AS (SELECT node, depth, any_value(words) AS words, min(m.conv_id) AS conv_id, count(*) AS n_convs,
        sha256(coalesce(string_agg(m.conv_id::VARCHAR, ',' ORDER BY m.conv_id) FILTER (WHERE l.length = depth), '')) AS ends_sha256
      FROM m JOIN l ON m.conv_id = l.conv_id GROUP BY node, depth),
e AS (SELECT n.node, a.node AS parent FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1),
b AS (SELECT parent, count(*) AS n_children FROM e GROUP BY parent),
x AS (SELECT a.node, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens, count(*) FILTER (WHERE b.n_children IS NULL) AS n_leaves
      FROM n JOIN m a ON a.conv_id = n.conv_id AND a.depth <= n.depth LEFT JOIN b ON b.parent = n.node GROUP BY a.node)
SELECT n.conv_id, n.depth, o.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0) AS n_children, x.n_leaves, x.saved_tokens, n.ends_sha256
FROM n JOIN x ON n.node = x.node LEFT JOIN b ON b.parent = n.node LEFT JOIN e ON e.node = n.node LEFT JOIN n o ON o.node = e.parent
"""

ORACLE_SQL["op11_source_divergence"] = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS i,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, i, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(n) AS n_lang FROM g GROUP BY lang),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)::HUGEINT) // (g.n + 2 * g.v)::HUGEINT AS p
      FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (sum(c.n) + 2)::HUGEINT) // (any_value(n_lang) + 2 * any_value(v))::HUGEINT AS q FROM c JOIN l USING (lang) JOIN v USING (lang) GROUP BY lang, term),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM f JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 10
"""
