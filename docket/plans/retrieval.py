"""H: retrieval queries. Queries are the benchmark's items; their vector is the embedding with the item's id."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import functions as F

from docket.operators import lexindex, vectors
from docket.operators import retrieval as R
from docket.plans import Book
from docket.session import scratch_root
from docket.sources.tables import table

BOOK = Book()
UNIVERSAL = ["src1", "src5"]
PREFERRED = ["src8", "src4"]

_TOK = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
_POST = f"""
sz AS (SELECT doc_id AS ref_key, {_TOK.format('text')} AS t FROM documents),
po AS (SELECT ref_key, dl, term, count(*) AS tf FROM (SELECT ref_key, len(t) AS dl, unnest(t) AS term FROM sz) GROUP BY ALL),
"""


def _bm25(k: int, queries: str = "SELECT item_id AS query_id, text FROM benchmark", out: str = "bm", where: str = "true") -> str:
    return f"""
{out}_q AS ({queries}), {out}_t AS (SELECT query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM {out}_q),
{out}_w AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM sz), {out}_d AS (SELECT term, count(*) AS df FROM po GROUP BY 1),
{out}_s AS (SELECT query_id, ref_key, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {out}_t JOIN {out}_d USING (term) JOIN po USING (term), {out}_w GROUP BY ALL),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_key) AS pos FROM {out}_s WHERE {where} QUALIFY pos <= {k}),
"""


def _vec(k: int, where: str = "true", out: str = "ve", ask: str = "q.vec_id IN (SELECT item_id FROM benchmark)") -> str:
    return f"""
{out}_s AS (SELECT q.vec_id AS query_id, u.vec_id AS ref_key, round(list_cosine_similarity(u.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings u, embeddings q WHERE {ask} AND {where}),
{out} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_key) AS pos FROM {out}_s QUALIFY pos <= {k}),
"""


def _norm(name: str) -> str:
    over = "OVER (PARTITION BY query_id)"
    return f"{name}_n AS (SELECT *, CASE WHEN max(score) {over} = min(score) {over} THEN 1.0 ELSE (score - min(score) {over}) / (max(score) {over} - min(score) {over}) END AS norm FROM {name}),"


def _fuse(k: int) -> str:
    return _norm("bm") + _norm("ve") + """
fu AS (SELECT coalesce(b.query_id, v.query_id) AS query_id, coalesce(b.ref_key, v.ref_key) AS ref_key, coalesce(b.score, 0) AS bm25_raw, coalesce(b.norm, 0) AS bm25_norm, coalesce(v.score, 0) AS vec_raw, coalesce(v.norm, 0) AS vec_norm,
   b.score IS NOT NULL AS in_lexical, v.score IS NOT NULL AS in_vector FROM bm_n b FULL JOIN ve_n v ON b.query_id = v.query_id AND b.ref_key = v.ref_key),
fs AS (SELECT *, round(0.5 * bm25_norm + 0.5 * vec_norm, 4) AS score, CASE WHEN in_lexical AND in_vector THEN 'both' WHEN in_lexical THEN 'lexical' ELSE 'vector' END AS side,
   list_filter([CASE WHEN vec_raw >= 0.60 THEN 'vector' END, CASE WHEN in_lexical AND bm25_norm >= 0.35 THEN 'lexical' END], lambda x: x IS NOT NULL) AS passed FROM fu),
fk AS (SELECT * FROM fs WHERE len(passed) > 0),
hy AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_key) AS pos FROM fk QUALIFY pos <= """ + str(k) + """),
"""


_FUSE = _fuse(8)
_DOC = """
un AS (SELECT doc_id AS ref_key, source AS law, 1 + substr(source, 4)::INT % 4 AS authority_rank, ['law', 'interpretation', 'ruling', 'letter'][1 + substr(source, 4)::INT % 4] AS doc_type, lang, text FROM documents),
rg AS (SELECT h.*, law, doc_type, authority_rank, ['src' || (query_id % 20), 'src' || ((query_id + 4) % 20)] AS hints, row_number() OVER (PARTITION BY query_id, authority_rank ORDER BY pos, h.ref_key) AS relevance_rank FROM hy h JOIN un ON h.ref_key = un.ref_key),
ap AS (SELECT *, doc_type <> 'law' OR law IN ('src1', 'src5') OR list_contains(hints, law) AS applies FROM rg),
stg AS (SELECT *, applies AND (vec_raw >= 0.70 OR (bm25_norm >= 0.999 AND bm25_raw >= 15 AND list_contains(hints, law))) AS strong FROM ap),
se AS (SELECT *, authority_rank <= 3 AND relevance_rank <= 2 AND strong AS selected, CASE WHEN authority_rank <= 3 AND relevance_rank <= 2 AND NOT applies THEN 'law not of this case' WHEN authority_rank <= 3 AND relevance_rank <= 2 AND NOT strong THEN 'score too low' END AS blocked_by FROM stg),
di AS (SELECT *, row_number() OVER (PARTITION BY query_id, authority_rank ORDER BY CASE WHEN authority_rank = 1 AND law = 'src8' THEN 1 WHEN authority_rank = 1 AND law = 'src4' THEN 2 ELSE 3 END, relevance_rank) AS display_pos FROM se),
"""
_BASE = "WITH " + _POST + _bm25(16) + _vec(16) + _FUSE


def corpus(spark, sf_dir):
    number = F.substring("source", 4, 10).cast("int") % 4
    kinds = F.array(*[F.lit(k) for k in ("law", "interpretation", "ruling", "letter")])
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("ref_key"), F.col("source").alias("law"), (number + 1).alias("authority_rank"), F.get(kinds, number).alias("doc_type"), "lang", "text")


def queries(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def units(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ref_key"), F.col("embedding").alias("vector"), "label")


def query_vectors(spark, sf_dir):
    asked = queries(spark, sf_dir).select("query_id")
    return units(spark, sf_dir).join(asked, F.col("ref_key") == F.col("query_id")).select("query_id", "vector")


def lexical(spark, sf_dir, k=16):
    return R.bm25(corpus(spark, sf_dir), queries(spark, sf_dir), k)


def nearest(spark, sf_dir, k=16):
    return R.cosine(units(spark, sf_dir), query_vectors(spark, sf_dir), k)


def hybrid_hits(spark, sf_dir):
    return R.hybrid(corpus(spark, sf_dir), queries(spark, sf_dir), units(spark, sf_dir), query_vectors(spark, sf_dir))


def grouped(spark, sf_dir):
    """Hybrid hits with their units, hints and place in their rank."""
    hits = hybrid_hits(spark, sf_dir).join(corpus(spark, sf_dir).drop("text", "lang"), "ref_key")
    hint = [F.concat(F.lit("src"), (F.col("query_id") + n) % 20) for n in (0, 4)]
    return R.rank_groups(hits.withColumn("hints", F.array(*hint)), "pos")


def chosen(spark, sf_dir):
    return R.display_order(R.auto_select(grouped(spark, sf_dir), UNIVERSAL), PREFERRED)


_FUSED = ["query_id", "ref_key", "bm25_raw", "vec_raw", "score", "side", "passed"]
_stores: dict[tuple[str, str, str], str] = {}


def _store(spark, sf_dir, kind, write):
    """The path of a store over the tables of ``sf_dir``, written once in an application and used by all queries."""
    key = (spark.sparkContext.applicationId, sf_dir, kind)
    if key not in _stores:
        path = f"{scratch_root(spark)}/store-{kind}-{uuid.uuid4().hex}"
        write(path)
        _stores[key] = path
    return _stores[key]


def lexical_index(spark, sf_dir):
    """Documents by law in one segment."""
    path = _store(spark, sf_dir, "lexical", lambda path: lexindex.write_segment(corpus(spark, sf_dir), path, 0, "law"))
    return lexindex.Index(spark, path)


def vector_cells(spark, sf_dir):
    return _store(spark, sf_dir, "cells", lambda path: vectors.write_cells(units(spark, sf_dir), path))


@BOOK.add("h01_postings", "WITH " + _POST + "z AS (SELECT 1) SELECT ref_key, term, tf, dl::INT AS dl FROM po")
def h01(spark, sf_dir):
    return R.postings(corpus(spark, sf_dir))


@BOOK.add("h02_bm25_top_k", "WITH " + _POST + _bm25(10) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def h02(spark, sf_dir):
    return lexical(spark, sf_dir, 10)


@BOOK.add("h03_vector_top_k", "WITH " + _vec(10) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM ve")
def h03(spark, sf_dir):
    return nearest(spark, sf_dir, 10)


@BOOK.add("h01_index_terms", "WITH " + _POST + "z AS (SELECT 1) SELECT term, count(*) AS df FROM po GROUP BY term")
def h01_index_terms(spark, sf_dir):
    return lexical_index(spark, sf_dir).terms()


@BOOK.add("h02_indexed_top_k", "WITH " + _POST + _bm25(10) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def h02_indexed(spark, sf_dir):
    hits, _ = lexindex.search(lexical_index(spark, sf_dir), queries(spark, sf_dir), 10)
    return hits.select("query_id", "ref_key", "score", "pos")


@BOOK.add("h02_indexed_inside", "WITH " + _POST + _bm25(5, where="ref_key IN (SELECT doc_id FROM documents d WHERE d.source = 'src' || (query_id % 20))") + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def h02_indexed_inside(spark, sf_dir):
    asked = queries(spark, sf_dir)
    values = asked.select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("value"))
    hits, _ = lexindex.search(lexical_index(spark, sf_dir), asked, 5, values)
    return hits.select("query_id", "ref_key", "score", "pos")


_LEFT = _POST.replace("FROM documents", "FROM (SELECT * FROM documents WHERE source IS DISTINCT FROM 'src7')")


@BOOK.add("s06_index_delete", "WITH " + _LEFT + _bm25(10) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def s06_index_delete(spark, sf_dir):
    """Searches after one source was deleted from the stored index, with its documents out of all statistics."""
    path = f"{scratch_root(spark)}/store-deleted-{uuid.uuid4().hex}"
    docs = corpus(spark, sf_dir)
    lexindex.write_segment(docs, path, 0, "law")
    lexindex.delete(spark, path, docs.where("law = 'src7'"), dry_run=False, most=None)
    return lexindex.search(lexindex.Index(spark, path), queries(spark, sf_dir), 10)[0].select("query_id", "ref_key", "score", "pos")


@BOOK.add("s06_vector_delete", "WITH " + _vec(10, "u.label IS DISTINCT FROM 2") + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM ve")
def s06_vector_delete(spark, sf_dir):
    """Nearest vectors after those of one label were deleted from the stored cells."""
    path = f"{scratch_root(spark)}/store-deleted-{uuid.uuid4().hex}"
    rows = units(spark, sf_dir)
    vectors.write_cells(rows, path)
    vectors.delete_units(spark, path, rows.where("label = 2"), dry_run=False, most=None)
    return vectors.search_cells(spark, path, query_vectors(spark, sf_dir), 10)[0]


@BOOK.add("h02_index_blocks", "WITH " + _POST + f"""
q AS (SELECT item_id AS query_id, unnest(list_distinct({_TOK.format('text')})) AS term FROM benchmark),
r AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 128 AS run FROM documents),
b AS (SELECT DISTINCT query_id, term, source, run FROM q JOIN po USING (term) JOIN r ON ref_key = doc_id)
SELECT query_id, count(*) AS blocks, true AS read_within FROM b GROUP BY query_id""")
def h02_blocks(spark, sf_dir):
    """How many blocks a query's terms have in the stored index; a search reads no more of them."""
    _, report = lexindex.search(lexical_index(spark, sf_dir), queries(spark, sf_dir), 10)
    return report.select("query_id", "blocks", (F.col("read") <= F.col("blocks")).alias("read_within"))


@BOOK.add("h03_cell_top_k", "WITH " + _vec(10) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM ve")
def h03_cells(spark, sf_dir):
    return vectors.search_cells(spark, vector_cells(spark, sf_dir), query_vectors(spark, sf_dir), 10)[0]


@BOOK.add("h03_cell_filtered", "WITH " + _vec(4, "u.label IN (2, 3)") + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM ve")
def h03_cells_filtered(spark, sf_dir):
    return vectors.search_cells(spark, vector_cells(spark, sf_dir), query_vectors(spark, sf_dir), 4, where=F.col("label").isin(2, 3))[0]


@BOOK.add("h08_stored_hybrid", _BASE + "z AS (SELECT 1) SELECT query_id, ref_key, bm25_raw, vec_raw, score, side, passed, pos::INT AS pos FROM hy")
def h08_stored(spark, sf_dir):
    lexical_hits, _ = lexindex.search(lexical_index(spark, sf_dir), queries(spark, sf_dir), 16)
    near, _ = vectors.search_cells(spark, vector_cells(spark, sf_dir), query_vectors(spark, sf_dir), 16)
    fused = R.fuse(lexical_hits.select("query_id", "ref_key", "score"), near.select("query_id", "ref_key", "score"))
    return R.top_k(fused, 8).select(*_FUSED, "pos")


@BOOK.add("h04_over_fetch", "WITH " + _POST + _bm25(16) + _vec(16) + "z AS (SELECT 1) SELECT 'lexical' AS side, query_id, ref_key, pos::INT AS pos FROM bm UNION ALL SELECT 'vector', query_id, ref_key, pos::INT FROM ve")
def h04(spark, sf_dir):
    sides = [d.select(F.lit(n).alias("side"), "query_id", "ref_key", "pos") for n, d in (("lexical", lexical(spark, sf_dir)), ("vector", nearest(spark, sf_dir)))]
    return sides[0].union(sides[1])


@BOOK.add("h05_min_max", "WITH " + _vec(10) + _norm("ve") + "z AS (SELECT 1) SELECT query_id, ref_key, round(norm, 6) AS norm FROM ve_n")
def h05(spark, sf_dir):
    return R.min_max(nearest(spark, sf_dir, 10)).select("query_id", "ref_key", F.round("norm", 6).alias("norm"))


@BOOK.add("h06_fusion", _BASE + "z AS (SELECT 1) SELECT query_id, ref_key, bm25_raw, vec_raw, score, side, passed FROM fk")
def h06(spark, sf_dir):
    return R.fuse(lexical(spark, sf_dir), nearest(spark, sf_dir)).select(*_FUSED)


@BOOK.add("h07_fusion_report", _BASE + "z AS (SELECT 1) SELECT query_id, min(bm25_raw) FILTER (WHERE in_lexical) AS lexical_min, max(bm25_raw) FILTER (WHERE in_lexical) AS lexical_max, min(vec_raw) FILTER (WHERE in_vector) AS vector_min, max(vec_raw) FILTER (WHERE in_vector) AS vector_max, count(*) AS candidates, count(*) FILTER (WHERE len(passed) > 0) AS kept, count(*) FILTER (WHERE len(passed) = 0) AS dropped FROM fs GROUP BY query_id")
def h07(spark, sf_dir):
    return R.fusion_report(lexical(spark, sf_dir), nearest(spark, sf_dir))


@BOOK.add("h08_hybrid_search", _BASE + "z AS (SELECT 1) SELECT query_id, ref_key, bm25_raw, vec_raw, score, side, passed, pos::INT AS pos FROM hy")
def h08(spark, sf_dir):
    return hybrid_hits(spark, sf_dir).select(*_FUSED, "pos")


def _renamed(sql: str) -> str:
    """The same steps under other names, for a second search in one statement."""
    return re.sub(r"\b(bm|ve)(_[qtwdsn])?\b(?!25)|\b(fu|fs|fk|hy)\b", lambda m: "x" + m.group(0), sql)


_HINTED = "(SELECT doc_id FROM documents d WHERE d.source = 'src' || ({0} % 20))"


@BOOK.add("h09_two_pass", _BASE + _renamed(_bm25(10, where="ref_key IN " + _HINTED.format("query_id")) + _vec(10, "u.vec_id IN " + _HINTED.format("q.vec_id")) + _fuse(5)) + """
z AS (SELECT 1) SELECT query_id, ref_key, bm25_raw, vec_raw, score, 'corpus' AS scope FROM hy
UNION ALL SELECT query_id, ref_key, bm25_raw, vec_raw, score, 'hinted' FROM xhy WHERE NOT EXISTS (SELECT 1 FROM hy WHERE hy.query_id = xhy.query_id AND hy.ref_key = xhy.ref_key)""")
def h09(spark, sf_dir):
    docs, asked = corpus(spark, sf_dir), queries(spark, sf_dir)
    hints = asked.select("query_id", F.concat(F.lit("src"), F.col("query_id") % 20).alias("law"))
    placed = units(spark, sf_dir).join(docs.select("ref_key", "law"), "ref_key", "left")
    found = R.two_pass(docs, asked, placed, query_vectors(spark, sf_dir), ("law", hints))
    return found.select("query_id", "ref_key", "bm25_raw", "vec_raw", "score", "scope")


@BOOK.add("h10_interleave", _BASE.replace("WITH ", "WITH RECURSIVE ", 1) + """
qu AS (SELECT query_id, coalesce(list(ref_key ORDER BY vec_raw DESC, ref_key) FILTER (WHERE vec_raw > 0), []) AS v, coalesce(list(ref_key ORDER BY bm25_norm DESC, ref_key) FILTER (WHERE bm25_norm > 0), []) AS l FROM fk GROUP BY 1),
st(query_id, vi, li, turn, taken, sides) AS (
  SELECT query_id, 1, 1, 'vector', []::BIGINT[], []::VARCHAR[] FROM qu
  UNION ALL
  SELECT query_id, CASE WHEN side = 'vector' THEN vi + 1 ELSE vi END, CASE WHEN side = 'lexical' THEN li + 1 ELSE li END, CASE WHEN list_contains(taken, key) THEN turn WHEN turn = 'vector' THEN 'lexical' ELSE 'vector' END,
    CASE WHEN list_contains(taken, key) THEN taken ELSE list_append(taken, key) END, CASE WHEN list_contains(taken, key) THEN sides ELSE list_append(sides, side) END
  FROM (SELECT *, CASE WHEN side = 'vector' THEN v[vi] ELSE l[li] END AS key FROM (
    SELECT st.*, v, l, CASE WHEN (turn = 'vector' AND vi <= len(v)) OR li > len(l) THEN 'vector' ELSE 'lexical' END AS side FROM st JOIN qu USING (query_id) WHERE vi <= len(v) OR li <= len(l)))),
dn AS (SELECT st.* FROM st JOIN qu USING (query_id) WHERE vi > len(v) AND li > len(l)),
tk AS (SELECT query_id, unnest(taken) AS ref_key, unnest(sides) AS placed_by, generate_subscripts(taken, 1) AS fused_pos FROM dn)
SELECT query_id, ref_key, fused_pos::INT AS fused_pos, placed_by FROM tk
UNION ALL SELECT fk.query_id, fk.ref_key, (len(taken) + row_number() OVER (PARTITION BY fk.query_id ORDER BY fk.ref_key))::INT, 'rest' FROM fk JOIN dn USING (query_id) WHERE NOT list_contains(taken, fk.ref_key)""")
def h10(spark, sf_dir):
    return R.interleave(R.fuse(lexical(spark, sf_dir), nearest(spark, sf_dir))).select("query_id", "ref_key", "fused_pos", "placed_by")


@BOOK.add("h11_rank_groups", _BASE + _DOC + "z AS (SELECT 1) SELECT query_id, ref_key, authority_rank, relevance_rank::INT AS relevance_rank FROM rg")
def h11(spark, sf_dir):
    return grouped(spark, sf_dir).select("query_id", "ref_key", "authority_rank", "relevance_rank")


@BOOK.add("h12_applicable", _BASE + _DOC + "z AS (SELECT 1) SELECT query_id, ref_key, doc_type, law, applies FROM ap")
def h12(spark, sf_dir):
    return grouped(spark, sf_dir).select("query_id", "ref_key", "doc_type", "law", R.applies(F.col("doc_type"), F.col("law"), F.col("hints"), UNIVERSAL).alias("applies"))


@BOOK.add("h13_strong", _BASE + _DOC + "z AS (SELECT 1) SELECT query_id, ref_key, strong FROM stg")
def h13(spark, sf_dir):
    fits = R.applies(F.col("doc_type"), F.col("law"), F.col("hints"), UNIVERSAL)
    return grouped(spark, sf_dir).select("query_id", "ref_key", R.strong(fits, F.col("law"), F.col("hints")).alias("strong"))


@BOOK.add("h14_auto_select", _BASE + _DOC + "z AS (SELECT 1) SELECT query_id, ref_key, selected, blocked_by FROM se")
def h14(spark, sf_dir):
    return R.auto_select(grouped(spark, sf_dir), UNIVERSAL).select("query_id", "ref_key", "selected", "blocked_by")


@BOOK.add("h15_display_order", _BASE + _DOC + "z AS (SELECT 1) SELECT query_id, ref_key, authority_rank, display_pos::INT AS display_pos FROM di")
def h15(spark, sf_dir):
    return chosen(spark, sf_dir).select("query_id", "ref_key", "authority_rank", "display_pos")


@BOOK.add("h16_nested_groups", _BASE + _DOC + "g AS (SELECT query_id, authority_rank, string_agg(display_pos || ':' || ref_key || ':' || selected, ',' ORDER BY display_pos) AS hits FROM di GROUP BY ALL) SELECT query_id, string_agg(authority_rank || '=' || hits, ';' ORDER BY authority_rank) AS groups FROM g GROUP BY query_id")
def h16(spark, sf_dir):
    one = F.transform("g.hits", lambda h: F.concat_ws(":", h["display_pos"], h["ref_key"], h["selected"]))
    nested = R.nested_groups(chosen(spark, sf_dir)).select("query_id", F.explode("groups").alias("g"))
    flat = nested.select("query_id", F.concat(F.col("g.authority_rank"), F.lit("="), F.array_join(one, ",")).alias("t"), "g.authority_rank")
    return flat.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("authority_rank", "t"))), lambda x: x["t"]), ";").alias("groups"))


@BOOK.add("h17_rank_coverage", _BASE + _DOC + "c AS (SELECT query_id, list(DISTINCT authority_rank ORDER BY authority_rank) AS hit, count(*) FILTER (WHERE selected) AS selected, count(*) FILTER (WHERE blocked_by IS NOT NULL) AS blocked FROM di GROUP BY 1) SELECT query_id, hit, list_filter([1, 2, 3, 4], lambda r: NOT list_contains(hit, r)) AS missing, selected, blocked FROM c")
def h17(spark, sf_dir):
    return R.rank_coverage(chosen(spark, sf_dir))


_NEAR10 = "WITH " + _vec(10, "u.vec_id <> q.vec_id")


@BOOK.add("h18_precedents", _NEAR10 + """
n AS (SELECT ve.*, label AS outcome, CASE WHEN ref_key % 3 <> 0 THEN 'answer ' || (ref_key % 5) END AS rebuttal FROM ve JOIN embeddings e ON ve.ref_key = e.vec_id),
r AS (SELECT query_id, rebuttal, count(*) AS used, min(pos) AS seen FROM n WHERE score >= 0.8 AND rebuttal IS NOT NULL GROUP BY ALL),
s AS (SELECT query_id, list(rebuttal || ' x' || used ORDER BY used DESC, seen) AS rebuttals FROM r GROUP BY 1),
g AS (SELECT query_id, count(*) FILTER (WHERE score >= 0.8) AS matched, count(*) FILTER (WHERE score >= 0.8 AND outcome = 1) AS adopted, max(score) AS best, list(ref_key ORDER BY pos) FILTER (WHERE pos <= 3) AS tried FROM n GROUP BY 1)
SELECT query_id, matched, adopted, (SELECT count(*) FROM embeddings) AS corpus, coalesce(rebuttals, []) AS rebuttals, CASE WHEN matched = 0 THEN tried ELSE [] END AS near_misses, CASE WHEN matched = 0 THEN best END AS best FROM g LEFT JOIN s USING (query_id)""")
def h18(spark, sf_dir):
    u, q = units(spark, sf_dir), query_vectors(spark, sf_dir)
    rebuttal = F.when(F.col("ref_key") % 3 != 0, F.concat(F.lit("answer "), F.col("ref_key") % 5))
    near = R.cosine(u, q, 10, skip_self=True).join(u.select("ref_key", F.col("label").alias("outcome"), rebuttal.alias("rebuttal")), "ref_key")
    found = R.precedents(near, q, u)
    return found.withColumn("rebuttals", F.transform("rebuttals", lambda x: F.concat(x["text"], F.lit(" x"), x["used"])))


@BOOK.add("h19_style_references", "WITH " + _vec(3, "u.label = 3") + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM ve")
def h19(spark, sf_dir):
    return R.cosine(units(spark, sf_dir).where(F.col("label") == 3), query_vectors(spark, sf_dir), 3)


_TYPED = "SELECT item_id AS query_id, concat_ws(' ', 'the', left(text, 80), 'of that') AS text FROM benchmark"


@BOOK.add("h20_type_precedents", "WITH " + _POST + _bm25(6, _TYPED) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos, left(text, 400) AS head FROM bm JOIN documents ON ref_key = doc_id")
def h20(spark, sf_dir):
    asked = queries(spark, sf_dir).select("query_id", F.concat_ws(" ", F.lit("the"), F.left("text", F.lit(80)), F.lit("of that")).alias("text"))
    docs = corpus(spark, sf_dir)
    return R.bm25(docs, asked, 6).join(docs.select("ref_key", F.left("text", F.lit(400)).alias("head")), "ref_key")


_ATTACHED = "SELECT page_id AS query_id, left(regexp_replace(html, '<[^>]*>', ' ', 'g'), 1500) AS text FROM pages"


@BOOK.add("h21_attachment_queries", "WITH " + _POST + _bm25(3, _ATTACHED) + "z AS (SELECT 1) SELECT page_id, ref_key, score, ref_key IS NOT NULL AS used, CASE WHEN ref_key IS NULL THEN 'no hit' END AS reason FROM pages LEFT JOIN bm ON page_id = query_id")
def h21(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    asked = pages.select(F.col("page_id").alias("query_id"), F.left(F.regexp_replace("html", "<[^>]*>", " "), F.lit(1500)).alias("text"))
    hits = R.bm25_of_many(corpus(spark, sf_dir), asked, 3)
    out = pages.select("page_id").join(hits, F.col("page_id") == F.col("query_id"), "left")
    return out.select("page_id", "ref_key", "score", F.col("ref_key").isNotNull().alias("used"), F.when(F.col("ref_key").isNull(), "no hit").alias("reason"))


@BOOK.add("h22_refresh", "WITH " + _vec(5) + "o AS (SELECT query_id, ref_key, score FROM ve WHERE query_id % 4 <> 3), f AS (SELECT query_id, ref_key, score + 1 AS score FROM ve) SELECT *, true AS reused FROM o WHERE query_id % 4 <> 1 UNION ALL SELECT *, false FROM f WHERE query_id % 4 IN (1, 3)")
def h22(spark, sf_dir):
    hits = nearest(spark, sf_dir, 5).select("query_id", "ref_key", "score")
    only = queries(spark, sf_dir).where(F.col("query_id") % 4 == 1)
    return R.refresh(hits.where(F.col("query_id") % 4 != 3), hits.withColumn("score", F.col("score") + 1), only)


@BOOK.add("h22_maintained_view", "WITH " + _POST + _bm25(5) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def h22_maintained(spark, sf_dir):
    """Documents arrive in three parts; the standing queries' hits are kept up to date from part to part."""
    path = f"{scratch_root(spark)}/store-view-{uuid.uuid4().hex}"
    docs, asked = corpus(spark, sf_dir), queries(spark, sf_dir)
    lexindex.write_segment(docs.where(F.pmod("ref_key", F.lit(3)) == 0), path, 0)
    view = lexindex.start_view(lexindex.Index(spark, path), asked, 5)
    for segment in (1, 2):
        lexindex.write_segment(docs.where(F.pmod("ref_key", F.lit(3)) == segment), path, segment)
        view, _ = lexindex.refresh_view(view, path, [segment], asked, 5)
    return lexindex.view_hits(view, 5)


_AMENDED = "(SELECT doc_id, CASE WHEN source = 'src2' THEN 'amended ' || text ELSE text END AS text FROM documents WHERE source IS NULL OR source NOT IN ('src7', 'src3'))"


@BOOK.add("h22_view_after_changes", "WITH " + _POST.replace("FROM documents", "FROM " + _AMENDED) + _bm25(5) + "z AS (SELECT 1) SELECT query_id, ref_key, score, pos::INT AS pos FROM bm")
def h22_after_changes(spark, sf_dir):
    """One source is taken out of the index and another one's texts are replaced; then a third goes and the segment is compacted."""
    path = f"{scratch_root(spark)}/store-view-{uuid.uuid4().hex}"
    docs, asked = corpus(spark, sf_dir), queries(spark, sf_dir)
    lexindex.write_segment(docs, path, 0)
    view = lexindex.start_view(lexindex.Index(spark, path), asked, 5)
    lexindex.delete(spark, path, docs.where("law = 'src7'"), dry_run=False, most=None)
    lexindex.replace(docs.where("law = 'src2'").withColumn("text", F.concat(F.lit("amended "), "text")), path, 1)
    view, _ = lexindex.refresh_view(view, path, [1], asked, 5)
    lexindex.delete(spark, path, docs.where("law = 'src3'"), dry_run=False, most=None)
    lexindex.compact(spark, path, 0)
    view, _ = lexindex.refresh_view(view, path, [], asked, 5)
    return lexindex.view_hits(view, 5)


@BOOK.add("h23_case_summary", _BASE + _DOC + "p AS (SELECT query_id, count(*) AS hits, count(*) FILTER (WHERE selected) AS selected FROM di GROUP BY 1) SELECT item_id % 7 AS case_id, count(*) AS queries, coalesce(sum(hits), 0)::BIGINT AS hits, coalesce(sum(selected), 0)::BIGINT AS selected, count(*) FILTER (WHERE coalesce(selected, 0) = 0) AS without_basis FROM benchmark LEFT JOIN p ON item_id = query_id GROUP BY 1")
def h23(spark, sf_dir):
    asked = queries(spark, sf_dir).select((F.col("query_id") % 7).alias("case_id"), "query_id")
    return R.case_summary(asked, chosen(spark, sf_dir))


@BOOK.add("h24_authority_conflicts", _BASE + _DOC + "c AS (SELECT query_id, list(ref_key ORDER BY ref_key) FILTER (WHERE doc_type = 'letter') AS letters, list(ref_key ORDER BY ref_key) FILTER (WHERE doc_type = 'ruling') AS rulings FROM di GROUP BY 1) SELECT * FROM c WHERE len(letters) > 0 AND len(rulings) > 0")
def h24(spark, sf_dir):
    return R.conflicts(chosen(spark, sf_dir), "letter", "ruling")


@BOOK.add("h25_regression_evaluation", "WITH " + _POST + _bm25(10) + "e AS (SELECT item_id AS query_id, doc_id AS ref_key FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT query_id, min(pos)::INT AS best_rank, coalesce(min(pos) <= 5, false) AS passed FROM e LEFT JOIN bm USING (query_id, ref_key) GROUP BY 1")
def h25(spark, sf_dir):
    from docket.operators.evidence import containing

    found = containing(queries(spark, sf_dir), corpus(spark, sf_dir).select("ref_key", F.col("text").alias("body")), "text", "body")
    return R.evaluate(found.select("query_id", "ref_key"), lexical(spark, sf_dir, 10), 5)


@BOOK.add("h26_holdout", "SELECT o_orderkey, year(o_orderdate)::INT AS year, year(o_orderdate) IN (1992, 1993, 1994, 1995) AS indexed, CASE WHEN year(o_orderdate) NOT IN (1992, 1993, 1994, 1995) THEN 'holdout year' END AS reason FROM orders")
def h26(spark, sf_dir):
    year = F.year("o_orderdate")
    indexed = year.isin(1992, 1993, 1994, 1995)
    return table(spark, sf_dir, "orders").select("o_orderkey", year.alias("year"), indexed.alias("indexed"), F.when(~indexed, "holdout year").alias("reason"))


@BOOK.add("h27_substantive", "SELECT o_orderkey, list(DISTINCT l_returnflag ORDER BY l_returnflag) AS results FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(*) FILTER (WHERE NOT contains(l_returnflag, 'R')) > 0")
def h27(spark, sf_dir):
    results = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_set("l_returnflag")).alias("results"))
    cases = table(spark, sf_dir, "orders").select("o_orderkey").join(results, "o_orderkey")
    return cases.where(F.exists("results", lambda r: ~r.contains("R")))


@BOOK.add("h28_merged_hits", _BASE + _DOC + "m AS (SELECT *, row_number() OVER (PARTITION BY ref_key ORDER BY selected DESC, pos, query_id) AS n FROM di) SELECT ref_key, query_id, selected, authority_rank, CASE WHEN doc_type = 'law' THEN 'law' ELSE 'other' END AS kind FROM m WHERE n = 1")
def h28(spark, sf_dir):
    return R.merge_hits(chosen(spark, sf_dir)).select("ref_key", "query_id", "selected", "authority_rank", "kind")
