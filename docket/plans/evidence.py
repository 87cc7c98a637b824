"""J: claim pairing and evidence queries. A case is a conversation: user turns are the petition's claims, assistant turns the defense's."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.operators import evidence as E
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: length(x) > 4))"
_PROPOSALS = f"""
u AS (SELECT conv_id, turn AS left_id, {_WORDS} AS w FROM conversations WHERE role = 'user'),
a AS (SELECT conv_id, turn AS right_id, {_WORDS} AS w FROM conversations WHERE role = 'assistant'),
pr AS (SELECT conv_id, left_id, right_id, row_number() OVER (PARTITION BY conv_id ORDER BY len(list_intersect(u.w, a.w)) DESC, left_id, right_id) AS pos FROM u JOIN a USING (conv_id)),
"""


def proposals(spark, sf_dir):
    """Every petition and defense claim of a case, most shared words first."""
    from pyspark.sql import Window as W

    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 4))
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", words.alias("w"))
    left = talk.where("role = 'user'").select("conv_id", F.col("turn").alias("left_id"), F.col("w").alias("lw"))
    right = talk.where("role = 'assistant'").select("conv_id", F.col("turn").alias("right_id"), F.col("w").alias("rw"))
    order = W.partitionBy("conv_id").orderBy(F.desc(F.size(F.array_intersect("lw", "rw"))), "left_id", "right_id")
    return left.join(right, "conv_id").withColumn("pos", F.row_number().over(order)).select("conv_id", "left_id", "right_id", "pos")


def pairs(spark, sf_dir):
    p = proposals(spark, sf_dir)
    known = table(spark, sf_dir, "conversations").where(F.length("text") >= 30)
    return E.match_one_to_one(p, known.select("conv_id", F.col("turn").alias("left_id")), known.select("conv_id", F.col("turn").alias("right_id")), "conv_id")


_GREEDY = "WITH RECURSIVE " + _PROPOSALS + """
kn AS (SELECT conv_id, turn FROM conversations WHERE length(text) >= 30),
pk AS (SELECT pr.*, EXISTS (SELECT 1 FROM kn WHERE kn.conv_id = pr.conv_id AND kn.turn = left_id) AND EXISTS (SELECT 1 FROM kn WHERE kn.conv_id = pr.conv_id AND kn.turn = right_id) AS known FROM pr),
st(conv_id, pos, lefts, rights, status, pair_no) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::VARCHAR, 0 FROM pk
  UNION ALL
  SELECT s.conv_id, p.pos, CASE WHEN p.known AND NOT list_contains(lefts, left_id) AND NOT list_contains(rights, right_id) THEN list_append(lefts, left_id) ELSE lefts END,
    CASE WHEN p.known AND NOT list_contains(lefts, left_id) AND NOT list_contains(rights, right_id) THEN list_append(rights, right_id) ELSE rights END,
    CASE WHEN NOT p.known THEN 'unknown id' WHEN list_contains(lefts, left_id) OR list_contains(rights, right_id) THEN 'not one-to-one' ELSE 'accepted' END,
    CASE WHEN p.known AND NOT list_contains(lefts, left_id) AND NOT list_contains(rights, right_id) THEN len(lefts) + 1 END::INT
  FROM st s JOIN pk p ON s.conv_id = p.conv_id AND p.pos = s.pos + 1),
ma AS (SELECT pk.conv_id, pk.pos, left_id, right_id, status, pair_no FROM pk JOIN st ON pk.conv_id = st.conv_id AND pk.pos = st.pos),
"""


@BOOK.add("j01_one_to_one", _GREEDY + "z AS (SELECT 1) SELECT conv_id, pos::INT AS pos, left_id, right_id, status, pair_no FROM ma")
def j01(spark, sf_dir):
    return pairs(spark, sf_dir)


@BOOK.add("j01_in_rounds", _GREEDY + "z AS (SELECT 1) SELECT conv_id, pos::INT AS pos, left_id, right_id, status, pair_no FROM ma")
def j01_rounds(spark, sf_dir):
    known = table(spark, sf_dir, "conversations").where(F.length("text") >= 30)
    return E.match_in_rounds(proposals(spark, sf_dir), known.select("conv_id", F.col("turn").alias("left_id")), known.select("conv_id", F.col("turn").alias("right_id")), "conv_id")


@BOOK.add("j02_unpaired", _GREEDY + "ac AS (SELECT * FROM ma WHERE status = 'accepted') SELECT conv_id, turn, role FROM conversations c WHERE (role = 'user' AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.conv_id = c.conv_id AND left_id = turn)) OR (role = 'assistant' AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.conv_id = c.conv_id AND right_id = turn))")
def j02(spark, sf_dir):
    done = pairs(spark, sf_dir).where("status = 'accepted'")
    talk = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    left = E.unpaired(talk.where("role = 'user'"), done.select("conv_id", F.col("left_id").alias("turn")), ["conv_id", "turn"])
    right = E.unpaired(talk.where("role = 'assistant'"), done.select("conv_id", F.col("right_id").alias("turn")), ["conv_id", "turn"])
    return left.unionByName(right)


@BOOK.add("j03_likely_missed", _GREEDY + "ac AS (SELECT * FROM ma WHERE status = 'accepted') SELECT conv_id, turn, left(text, 120) AS claim FROM conversations c WHERE role = 'assistant' AND NOT EXISTS (SELECT 1 FROM ac WHERE ac.conv_id = c.conv_id AND right_id = turn)")
def j03(spark, sf_dir):
    done = pairs(spark, sf_dir).where("status = 'accepted'")
    talk = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return E.unpaired(talk, done.select("conv_id", F.col("right_id").alias("turn")), ["conv_id", "turn"]).select("conv_id", "turn", F.left("text", F.lit(120)).alias("claim"))


@BOOK.add("j04_quote_location", r"WITH q AS (SELECT item_id, left(regexp_replace(text, '\s+', '', 'g'), 20) AS q FROM benchmark), f AS (SELECT item_id, min(doc_id) AS doc_id FROM q JOIN documents d ON length(q) >= 8 AND contains(regexp_replace(d.text, '\s+', '', 'g'), q) GROUP BY 1) SELECT b.item_id, f.doc_id FROM benchmark b LEFT JOIN f USING (item_id)")
def j04(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return E.locate_quotes(table(spark, sf_dir, "benchmark"), docs, "text", "body", "item_id", "doc_id", "doc_id")


@BOOK.add("j05_claim_reason_link", "SELECT o_orderkey, o_orderstatus, l_linenumber, l_partkey, l_linestatus FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1")
def j05(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_linestatus")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left")


@BOOK.add("j06_issue_attachment", _GREEDY + "i AS (SELECT conv_id, pair_no, unnest([left_id, right_id]) AS turn FROM ma WHERE status = 'accepted') SELECT c.conv_id, c.turn, role, pair_no FROM conversations c LEFT JOIN i ON c.conv_id = i.conv_id AND c.turn = i.turn")
def j06(spark, sf_dir):
    issues = pairs(spark, sf_dir).where("status = 'accepted'").select("conv_id", "pair_no", "left_id", "right_id")
    return E.attach_issues(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), issues, "turn", ["left_id", "right_id"], "pair_no", ["conv_id"])


_HITS = """
h AS (SELECT doc_id % 50 AS case_id, doc_id % 7 AS claim_id, source AS ref_key, CASE WHEN doc_id % 2 = 0 THEN 'petition' ELSE 'defense' END AS side, doc_id AS pos, n_chars > 1500 AS selected, text FROM documents),
c AS (SELECT DISTINCT case_id, claim_id FROM h),
"""


def _hits(spark, sf_dir):
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select((d % 50).alias("case_id"), (d % 7).alias("claim_id"), F.col("source").alias("ref_key"), F.when(d % 2 == 0, "petition").otherwise("defense").alias("side"), d.alias("pos"), (F.col("n_chars") > 1500).alias("selected"), "text")


@BOOK.add("j07_selected_sources", "WITH " + _HITS + "f AS (SELECT case_id, ref_key, min((pos, claim_id)) AS seen, list(DISTINCT side ORDER BY side) AS sides, left(arg_min(text, (pos, claim_id)), 400) AS text FROM h WHERE selected GROUP BY ALL) SELECT case_id, ref_key, sides, text, row_number() OVER (PARTITION BY case_id ORDER BY seen, ref_key)::INT AS source_no FROM f")
def j07(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return E.selected_sources(hits, hits.select("case_id", "claim_id").distinct(), "case_id", "claim_id")[0]


@BOOK.add("j07_claims_without_source", "WITH " + _HITS + "z AS (SELECT 1) SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM h WHERE selected AND h.case_id = c.case_id AND h.claim_id = c.claim_id)")
def j07_without(spark, sf_dir):
    hits = _hits(spark, sf_dir)
    return E.selected_sources(hits, hits.select("case_id", "claim_id").distinct(), "case_id", "claim_id")[1]


@BOOK.add("j08_prior_cases", "SELECT o_orderkey, CASE WHEN o_custkey IS NULL OR o_orderdate IS NULL THEN 'unclear' WHEN EXISTS (SELECT 1 FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderpriority = o.o_orderpriority AND p.o_orderstatus = 'F') THEN 'triggered' ELSE 'no_match' END AS status FROM orders o")
def j08(spark, sf_dir):
    from docket.operators.rules import prior_case

    orders = table(spark, sf_dir, "orders")
    known = orders.where("o_orderstatus = 'F'").select("o_custkey", "o_orderpriority").distinct()
    return prior_case(orders, known, ["o_custkey", "o_orderpriority"]).select("o_orderkey", F.col("outcome.status").alias("status"))


@BOOK.add("j09_party_match", r"""
WITH n AS (SELECT c_nationkey, list('Name: ' || replace(c_name, 'Customer', 'Supplier')) AS names FROM customer GROUP BY 1)
SELECT s_suppkey, CASE WHEN s_name IS NULL OR trim(s_name) = '' THEN 'unclear' WHEN len(list_filter(names, lambda x: regexp_replace(regexp_replace(x, '[\s:：]+', '', 'g'), '^(?:Name)', '') = regexp_replace(regexp_replace(s_name, '[\s:：]+', '', 'g'), '^(?:Name)', ''))) > 0 THEN 'no_match' ELSE 'need_human' END AS status
FROM supplier LEFT JOIN n ON s_nationkey = c_nationkey""")
def j09(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("s_nationkey"), F.concat(F.lit("Name: "), F.replace("c_name", F.lit("Customer"), F.lit("Supplier"))).alias("name"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    return E.party_match(rows, names, ["s_nationkey"], "s_name", "Name").select("s_suppkey", "status")


@BOOK.add("j10_highlights", r"""
WITH p AS (SELECT doc_id, generate_subscripts(l, 1) AS para_no, unnest(l) AS para FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\n+'), lambda x: trim(x, ' ') <> '') AS l FROM documents)),
v AS (SELECT doc_id, 'lang' AS code, lang || ' ' AS value FROM documents UNION ALL SELECT doc_id, 'first', split_part(text, ' ', 1) FROM documents UNION ALL SELECT doc_id, 'second', split_part(text, ' ', 2) FROM documents)
SELECT p.doc_id, para_no, list(code ORDER BY code) AS codes FROM p JOIN v ON p.doc_id = v.doc_id AND length(value) >= 4 AND contains(para, value) GROUP BY ALL""")
def j10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = F.filter(F.split("text", "\n+"), lambda x: F.trim(x) != "")
    paras = docs.select("doc_id", F.posexplode(lines).alias("at", "para")).select("doc_id", (F.col("at") + 1).alias("para_no"), "para")
    part = lambda n: F.split_part("text", F.lit(" "), F.lit(n))
    pairs_ = F.array(F.struct(F.lit("lang").alias("code"), F.concat("lang", F.lit(" ")).alias("value")), F.struct(F.lit("first").alias("code"), part(1).alias("value")), F.struct(F.lit("second").alias("code"), part(2).alias("value")))
    values = docs.select("doc_id", F.explode(pairs_).alias("v")).select("doc_id", "v.*").where(F.length("value") >= 4)
    return E.containing(values, paras, "value", "para", ["doc_id"]).groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list("code")).alias("codes"))


_OVER = """
r AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'triggered' WHEN 1 THEN 'missing' WHEN 2 THEN 'unclear' ELSE 'no_match' END AS status, lang, text FROM documents),
a AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN 'suspicious' WHEN quality = 1 THEN 'clear' ELSE 'other' END AS verdict, CASE WHEN quality = 1 THEN 'quoted' ELSE ' ' END AS quote FROM labels l),
"""


def _results(spark, sf_dir):
    states = F.array(*[F.lit(s) for s in ("triggered", "missing", "unclear", "no_match")])
    return table(spark, sf_dir, "documents").select("doc_id", F.get(states, (F.col("doc_id") % 4).cast("int")).alias("status"))


@BOOK.add("j11_overlay", "WITH " + _OVER + """o AS (SELECT r.doc_id, status, CASE WHEN verdict IS NULL THEN NULL WHEN verdict NOT IN ('clear', 'suspicious', 'insufficient') THEN 'suspicious' ELSE verdict END AS v, quote FROM r LEFT JOIN a USING (doc_id)),
f AS (SELECT doc_id, status, CASE WHEN v = 'suspicious' AND trim(coalesce(quote, '')) = '' THEN 'insufficient' ELSE v END AS ai_verdict FROM o)
SELECT *, CASE WHEN ai_verdict = 'suspicious' AND status NOT IN ('triggered', 'no_match', 'not_applicable') THEN 'need_human' ELSE status END AS final_status FROM f""")
def j11(spark, sf_dir):
    advice = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "suspicious").when(F.col("quality") == 1, "clear").otherwise("other").alias("verdict"), F.when(F.col("quality") == 1, "quoted").otherwise(" ").alias("quote"))
    return E.overlay(_results(spark, sf_dir), advice, ["doc_id"])


@BOOK.add("j12_narrative_coverage", "SELECT source, count(*) AS total, count(l.doc_id) AS explained, coalesce(list(d.doc_id ORDER BY d.doc_id) FILTER (WHERE l.doc_id IS NULL), []) AS missing FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def j12(spark, sf_dir):
    results = table(spark, sf_dir, "documents").select("source", "doc_id")
    notes = results.join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return E.coverage(results, notes, "source", "doc_id")


@BOOK.add("j13_source_precedence", "SELECT doc_id, coalesce(toxic, n_chars::INT) AS value, CASE WHEN toxic IS NOT NULL THEN 'petition' WHEN n_chars IS NOT NULL THEN 'defense' END AS source FROM documents LEFT JOIN labels USING (doc_id)")
def j13(spark, sf_dir):
    from docket.operators.rules import first_value

    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    got = first_value({"petition": F.col("toxic"), "defense": F.col("n_chars").cast("int")})
    return rows.select("doc_id", got.alias("v")).select("doc_id", F.col("v.value").alias("value"), F.col("v.source").alias("source"))


_SECTIONS = """
cl AS (SELECT conv_id, turn AS claim_id FROM conversations WHERE role = 'user'),
dr AS (SELECT conv_id, turn AS claim_id, left(text, 200) AS text FROM conversations WHERE role = 'user' AND length(text) > 100),
co AS (SELECT cl.conv_id, cl.claim_id, row_number() OVER (PARTITION BY cl.conv_id ORDER BY cl.claim_id) AS no, coalesce(text, 'to be drafted') AS text, text IS NULL AS is_placeholder FROM cl LEFT JOIN dr ON cl.conv_id = dr.conv_id AND cl.claim_id = dr.claim_id),
"""


def _completed(spark, sf_dir):
    claims = table(spark, sf_dir, "conversations").where("role = 'user'")
    drafted = claims.where(F.length("text") > 100).select("conv_id", F.col("turn").alias("claim_id"), F.left("text", F.lit(200)).alias("text"))
    return E.completed_sections(claims.select("conv_id", F.col("turn").alias("claim_id")), drafted, "conv_id", "claim_id", "to be drafted")


@BOOK.add("j14_completed_sections", "WITH " + _SECTIONS + "z AS (SELECT 1) SELECT conv_id, claim_id, no::INT AS no, text, is_placeholder FROM co")
def j14(spark, sf_dir):
    return _completed(spark, sf_dir)


@BOOK.add("j15_prefixed_sections", "WITH " + _SECTIONS + "b AS (SELECT 0 AS part, conv_id, 1 AS no, 'procedure' AS text FROM (SELECT DISTINCT conv_id FROM cl) UNION ALL SELECT 1, conv_id, no, text FROM co) SELECT conv_id, no::INT AS no, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, no)::INT AS new_no FROM b")
def j15(spark, sf_dir):
    later = _completed(spark, sf_dir).select("conv_id", "no", "text")
    first = later.select("conv_id").distinct().select("conv_id", F.lit(1).alias("no"), F.lit("procedure").alias("text"))
    return E.prefixed(first, later, "conv_id")


@BOOK.add("j16_file_references", "WITH m(lang, folder) AS (VALUES ('en', 'law'), ('de', 'ruling'), ('fr', 'letter')) SELECT doc_id, folder || '/' || source AS path, page_id IS NOT NULL AS found FROM documents JOIN m USING (lang) LEFT JOIN pages ON doc_id = page_id")
def j16(spark, sf_dir):
    folders = F.broadcast(spark.createDataFrame([("en", "law"), ("de", "ruling"), ("fr", "letter")], "lang string, folder string"))
    listing = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("_there"))
    docs = table(spark, sf_dir, "documents").join(folders, "lang").join(listing, "doc_id", "left")
    return docs.select("doc_id", F.concat_ws("/", "folder", "source").alias("path"), F.col("_there").isNotNull().alias("found"))
