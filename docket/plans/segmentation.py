"""G: segmentation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docket.functions.normalize import nfc
from docket.operators import segmentation as S
from docket.plans import Book
from docket.sources.tables import table

BOOK = Book()

_SEGS = r"""
WITH c AS (SELECT doc_id, string_split(regexp_replace(text, '(?m)^(\p{Lu}[^ .,\n]*)', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS parts FROM documents),
p AS (SELECT doc_id, unnest(parts[2:]) AS part, generate_subscripts(parts[2:], 1) AS seg_no FROM c),
s AS (SELECT doc_id, seg_no, split_part(part, chr(2), 1) AS marker, trim(regexp_replace(split_part(part, chr(2), 2), '\s+', ' ', 'g')) AS body FROM p),
k AS (SELECT *, CASE WHEN body = '' THEN 'empty' WHEN regexp_matches(body, '^[.,]') THEN 'deleted' ELSE 'unit' END AS kind FROM s)
"""
_MARK = r"(?dm)^(\p{Lu}[^ .,\n]*)"


@BOOK.add("g01_marker_segments", _SEGS + "SELECT doc_id, seg_no, marker, body FROM k WHERE kind = 'unit'")
def g01(spark, sf_dir):
    return S.segment_markers(table(spark, sf_dir, "documents"), _MARK, "^[.,]")


@BOOK.add("g01_marker_counts", _SEGS + "SELECT doc_id, count(*) FILTER (WHERE kind = 'unit') AS units, count(*) FILTER (WHERE kind = 'empty') AS empties, count(*) FILTER (WHERE kind = 'deleted') AS deleted FROM k GROUP BY doc_id")
def g01_counts(spark, sf_dir):
    rows = S.segment_markers(table(spark, sf_dir, "documents"), _MARK, "^[.,]", keep_dropped=True)
    return rows.groupBy("doc_id").agg(F.count_if(F.col("kind") == "unit").alias("units"), F.count_if(F.col("kind") == "empty").alias("empties"), F.count_if(F.col("kind") == "deleted").alias("deleted"))


@BOOK.add("g02_noise_lines", r"SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda l: NOT regexp_matches(l, '[%&#$*]{3}|!!|\|')), chr(10)) AS clean FROM documents")
def g02(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.drop_noise_lines(F.col("text"), r"[%&#$*]{3}|!!|\|").alias("clean"))


@BOOK.add("g03_line_numbers", r"SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '(?m)^\p{Lu}\p{Ll}')) > 20 THEN regexp_replace(text, '(?m)^\p{Lu}\p{Ll}', '', 'g') ELSE text END AS stripped FROM documents")
def g03(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.strip_line_numbers(F.col("text"), r"(?dm)^\p{Lu}\p{Ll}").alias("stripped"))


_LABELS = ["<title>", "<nav>", "<article>", "<h1>", "<footer>", "<table>"]
_LABEL_SQL = r"""
WITH f AS (SELECT page_id, html, list_sort(list_filter([{'at': instr(html, l), 'label': l} FOR l IN ['<title>', '<nav>', '<article>', '<h1>', '<footer>', '<table>']], lambda x: x.at > 0)) AS found FROM pages),
e AS (SELECT page_id, html, found, unnest(range(1, len(found) + 1)) AS i FROM f)
SELECT page_id, found[i].label AS label, trim(regexp_replace(substr(html, found[i].at + length(found[i].label),
   greatest(CASE WHEN i < len(found) THEN found[i + 1].at ELSE length(html) + 1 END - found[i].at - length(found[i].label), 0)), '^[:：\s]+', ''), ' ') AS value FROM e
"""


@BOOK.add("g04_label_fields", _LABEL_SQL)
def g04(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(S.label_fields(F.col("html"), _LABELS)).alias("label", "value"))


_SECTIONS = r"""
WITH p AS (SELECT doc_id, text, length(split_part(text, regexp_extract(text, ' [Tt]he '), 1)) + 1 AS a, regexp_extract(text, ' [Tt]he ') AS head,
   regexp_extract(text, ' [Aa]nd ') AS tail, length(split_part(text, regexp_extract(text, ' [Aa]nd '), 1)) + 1 AS b FROM documents)
SELECT doc_id, CASE WHEN ok THEN trim(substr(text, a + length(head), greatest(b - a - length(head), 0))) END AS main,
  CASE WHEN ok THEN trim(substr(text, b + length(tail))) END AS reasons
FROM (SELECT *, head <> '' AND tail <> '' AND b > a AS ok FROM p)
"""


@BOOK.add("g05_section_split", _SECTIONS)
def g05(spark, sf_dir):
    cut = table(spark, sf_dir, "documents").select("doc_id", S.split_sections(F.col("text"), " [Tt]he ", " [Aa]nd ").alias("s"))
    return cut.select("doc_id", F.col("s.main").alias("main"), F.col("s.reasons").alias("reasons"))


_PARTS = r"""
WITH c AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(text, '\p{Lu}', chr(1) || '\0', 'g'), chr(1)), lambda p: trim(p, ' ') <> ''), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS parts FROM documents)
"""


@BOOK.add("g06_points_drop", _PARTS + "SELECT * FROM (SELECT doc_id, generate_subscripts(parts, 1) AS point_no, unnest(parts) AS point FROM c) WHERE length(point) >= 10")
def g06(spark, sf_dir):
    return S.points(table(spark, sf_dir, "documents"), r"\p{Lu}")


_MERGED = _PARTS + r""", e AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN i = 1 OR length(p) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS point_no FROM e)
SELECT doc_id, point_no::INT AS point_no, string_agg(p, ' ' ORDER BY i) AS point FROM g GROUP BY doc_id, point_no
"""


@BOOK.add("g07_points_merge", _MERGED)
def g07(spark, sf_dir):
    return S.merged_points(table(spark, sf_dir, "documents"), r"\p{Lu}")


@BOOK.add("g08_first_boundary", r"SELECT doc_id, CASE WHEN least(a, b, c) = 1000000000 THEN NULL ELSE least(a, b, c) END AS boundary FROM (SELECT doc_id, " + ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN length(split_part(text, regexp_extract(text, '{p}'), 1)) + 1 ELSE 1000000000 END AS {n}" for n, p in (("a", " of "), ("b", " de "), ("c", " der "))) + " FROM documents)")
def g08(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.first_boundary(F.col("text"), [" of ", " de ", " der "]).alias("boundary"))


@BOOK.add("g09_context_prefix", r"SELECT doc_id, concat_ws(' ', source, lang, left(split_part(text, chr(10), 1), 120), text) AS unit FROM documents WHERE length(text) >= 30")
def g09(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where(F.length("text") >= 30)
    parts = [(F.col("source"), None), (F.col("lang"), None), (F.substring_index("text", "\n", 1), 120)]
    return docs.select("doc_id", S.context_prefix(parts, F.col("text")).alias("unit"))


@BOOK.add("g10_three_part_chunks", r"""
WITH s AS (""" + _SECTIONS.replace("WITH p AS", "WITH q AS").replace("AS ok FROM p)", "AS ok FROM q)") + r"""),
c AS (SELECT doc_id, list_transform(list_filter(string_split(regexp_replace(reasons, '\p{Lu}', chr(1) || '\0', 'g'), chr(1)), lambda p: trim(p, ' ') <> ''), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))) AS parts FROM s WHERE reasons IS NOT NULL),
e AS (SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS p FROM c),
g AS (SELECT *, sum(CASE WHEN i = 1 OR length(p) >= 40 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS point_no FROM e)
SELECT doc_id, 'text' AS part, 1 AS point_no, trim(regexp_replace(main, '\s+', ' ', 'g')) AS point FROM s WHERE main <> ''
UNION ALL SELECT doc_id, 'reasoning', point_no::INT, string_agg(p, ' ' ORDER BY i) FROM g GROUP BY doc_id, point_no
""")
def g10(spark, sf_dir):
    return S.three_part_chunks(table(spark, sf_dir, "documents"), " [Tt]he ", " [Aa]nd ", r"\p{Lu}")


_NAME = {"host": r"://([^/?#]*)", "lang": r"://[^/]*/([a-z]{2})/", "number": r"/([0-9]+)", "args": r"\?([^#]*)"}


@BOOK.add("g11_name_fields", r"""
SELECT page_id, host, lang, number, args, string_split(args, '&') AS args_list, coalesce(len(string_split(args, '&')) > 1, false) AS is_compound, host IS NOT NULL AS parsed, url AS raw
FROM (SELECT page_id, url, """ + ", ".join(f"nullif(regexp_extract(url, '{p}', 1), '') AS {k}" for k, p in {"host": "://([^/?#]*)", "lang": "://[^/]*/([a-z]{2})/", "number": "/([0-9]+)", "args": r"\?([^#]*)"}.items()) + " FROM pages)")
def g11(spark, sf_dir):
    cut = table(spark, sf_dir, "pages").select("page_id", "url", S.name_fields(F.col("url"), _NAME, "args", "[&＆]").alias("n"))
    return cut.select("page_id", *[F.col(f"n.{k}").alias(k) for k in _NAME], F.col("n.args_list").alias("args_list"), F.coalesce(F.col("n.is_compound"), F.lit(False)).alias("is_compound"), F.col("n.host").isNotNull().alias("parsed"), F.col("url").alias("raw"))


_FORMATS = {"table": "<table", "list": "<li>", "code": "<pre", "ad": 'class="ad"', "bold": "<b>"}


@BOOK.add("g12_format_labels", "SELECT page_id, coalesce(nullif(concat_ws('+', " + ", ".join(f"CASE WHEN regexp_matches(html, '{p}') THEN '{k}' END" for k, p in _FORMATS.items()) + "), ''), 'unknown') AS format FROM pages")
def g12(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.format_labels(F.col("html"), _FORMATS).alias("format"))


@BOOK.add("g13_first_digest", r"""
SELECT page_id, left(coalesce(a, b, c), 200) AS digest, CASE WHEN a IS NOT NULL THEN 'heading' WHEN b IS NOT NULL THEN 'title' WHEN c IS NOT NULL THEN 'url' END AS provenance
FROM (SELECT page_id, nullif(trim(regexp_extract(html, '<h2>([^<]*)', 1)), '') AS a, nullif(trim(regexp_extract(html, '<title>([^<]*)', 1)), '') AS b, nullif(trim(url), '') AS c FROM pages)
""")
def g13(spark, sf_dir):
    digest, source = S.first_digest({"heading": F.regexp_extract("html", "<h2>([^<]*)", 1), "title": F.regexp_extract("html", "<title>([^<]*)", 1), "url": F.col("url")})
    return table(spark, sf_dir, "pages").select("page_id", digest.alias("digest"), source.alias("provenance"))


@BOOK.add("g14_noise_share", r"""
SELECT page_id, CASE WHEN n > 0 THEN round((1 - m / n) * 100, 1) ELSE 0.0 END AS noise
FROM (SELECT page_id, length(regexp_replace(html, '\s', '', 'g'))::DOUBLE AS n, length(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s', '', 'g'))::DOUBLE AS m FROM pages)
""")
def g14(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.noise_share(F.col("html"), F.regexp_replace("html", "<[^>]*>", "")).alias("noise"))


@BOOK.add("g15_citations", r"""
SELECT page_id, generate_subscripts(a, 1) AS cite_no, unnest(a) AS name, unnest(b) AS article
FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS a, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS b FROM pages)
""")
def g15(spark, sf_dir):
    link = r'<a href="([^"]*)">([^<]*)</a>'
    return S.citations(table(spark, sf_dir, "pages"), link, link, "page_id", "html")


@BOOK.add("g16_low_text_pages", r"""
SELECT conv_id, list(turn ORDER BY turn) AS pages, 'little text on page ' || string_agg(turn::VARCHAR, ', ' ORDER BY turn) AS reason
FROM conversations WHERE length(coalesce(regexp_replace(text, '\s', '', 'g'), '')) < 60 GROUP BY conv_id
""")
def g16(spark, sf_dir):
    return S.low_text_pages(table(spark, sf_dir, "conversations"), "conv_id", "turn", least=60)


@BOOK.add("g17_distinct_characters", r"SELECT doc_id, list_sort(list_distinct(regexp_extract_all(text, '[À-ÿ]'))) AS found FROM documents")
def g17(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.distinct_matches(F.col("text"), "[À-ÿ]").alias("found"))


@BOOK.add("g18_canonical_text", "SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def g18(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", nfc(F.col("text")).alias("text"))


@BOOK.add("g19_paragraphs", r"""
SELECT doc_id, 'p' || generate_subscripts(l, 1) AS para_id, unnest(l) AS para
FROM (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\n+'), lambda p: trim(p, ' ')), lambda p: p <> '') AS l FROM documents)
""")
def g19(spark, sf_dir):
    return S.paragraphs(table(spark, sf_dir, "documents"))


@BOOK.add("g20_truncated", "SELECT doc_id, left(text, 400) AS head, length(text)::INT AS length, length(text) > 400 AS cut FROM documents")
def g20(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.truncated(F.col("text"), 400).alias("t")).select("doc_id", "t.*")


_STOP = ["the", "of", "and", "to", "a", "in"]


@BOOK.add("g21_scrub_query", r"""
WITH p AS (SELECT item_id, regexp_extract_all(text, '[0-9]+') AS removed, trim(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]+', ' ', 'g'), '[^\p{L}\p{N}\s]', ' ', 'g'), '\s+', ' ', 'g')) AS plain FROM benchmark),
w AS (SELECT *, string_split(plain, ' ') AS words FROM p),
f AS (SELECT *, array_to_string(list_filter(words, lambda x: NOT list_contains(['the', 'of', 'and', 'to', 'a', 'in'], lower(x))), ' ') AS short, list_filter(words, lambda x: list_contains(['the', 'of', 'and', 'to', 'a', 'in'], lower(x))) AS stops FROM w)
SELECT item_id, left(CASE WHEN length(short) < 6 THEN plain ELSE short END, 60) AS query, removed || stops AS removed FROM f
""")
def g21(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.scrub_query(F.col("text"), "[0-9]+", _STOP).alias("q")).select("item_id", "q.*")


@BOOK.add("g22_name_suffixes", r"""
WITH w AS (SELECT item_id, generate_subscripts(a, 1) AS w_at, unnest(a) AS w FROM (SELECT item_id, regexp_extract_all(text, '\p{Lu}\p{Ll}+') AS a FROM benchmark)),
s AS (SELECT item_id, w_at, i AS s_at, substr(w, i) AS name FROM w, range(1, 1000) r(i) WHERE i <= length(w) - 1),
f AS (SELECT item_id, name, min((w_at, s_at)) AS seen FROM s GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY seen)::INT AS pos, name FROM f
""")
def g22(spark, sf_dir):
    return S.name_suffixes(table(spark, sf_dir, "benchmark"), r"\p{Lu}\p{Ll}+", "item_id")
