"""Segmentation of documents into citable units, and projections of their text.

Patterns and vocabularies are parameters. Line anchors in patterns expect the
flags ``(?dm)``: lines end at ``\\n`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

START, STOP = "\x01", "\x02"
LAW_ARTICLE = r"(?dm)^\s*第\s*([0-9一二三四五六七八九十百]+(?:-[0-9]+)?)\s*條(?:之[0-9一二三四五六七八九十]+)?"
LAW_DELETED = r"^[（(]刪除[）)]$"


def tidy(text: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def squash(text: Column) -> Column:
    """Without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def segment_markers(docs: DataFrame, marker: str, deleted: str = LAW_DELETED, id_col: str = "doc_id", text_col: str = "text", keep_dropped: bool = False) -> DataFrame:
    """(doc_id, seg_no, marker, body): text from one heading marker to the next.

    ``marker`` has one group, the marker's name. Bodies are tidied to one line.
    Empty bodies and deleted shells are dropped after numbering; with
    ``keep_dropped`` they stay, told by ``kind``.
    """
    cut = F.split(F.regexp_replace(F.col(text_col), marker, f"{START}$1{STOP}"), START)
    parts = docs.select(F.col(id_col), F.posexplode(F.slice(cut, 2, F.greatest(F.size(cut) - 1, F.lit(0)))).alias("at", "part"))
    body = tidy(F.substring_index("part", STOP, -1))
    out = parts.select(id_col, (F.col("at") + 1).alias("seg_no"), F.substring_index("part", STOP, 1).alias("marker"), body.alias("body"))
    kind = F.when(F.col("body") == "", "empty").when(F.col("body").rlike(deleted), "deleted").otherwise("unit")
    out = out.withColumn("kind", kind)
    return out if keep_dropped else out.where(F.col("kind") == "unit").drop("kind")


def drop_noise_lines(text: Column, noise: str) -> Column:
    """Lines that match ``noise`` anywhere are removed."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~line.rlike(noise)), "\n")


def strip_line_numbers(text: Column, number: str = r"(?dm)^[0-9]{2}[ \t]*", least: int = 20) -> Column:
    """Line numbers go only where more than ``least`` lines begin with one."""
    return F.when(F.regexp_count(text, F.lit(number)) > least, F.regexp_replace(text, number, "")).otherwise(text)


def label_fields(text: Column, labels: list[str], skip: str = r"^[:：\s]+") -> Column:
    """map(label -> text up to the next label that occurs), labels by first position."""
    found = F.array(*[F.struct(F.instr(text, label).alias("at"), F.lit(label).alias("label")) for label in labels])
    found = F.array_sort(F.filter(found, lambda x: x["at"] > 0))

    def value(x: Column, i: Column) -> Column:
        begin = x["at"] + F.length(x["label"])
        stop = F.when(i + 1 < F.size(found), F.get(found, i + 1)["at"]).otherwise(F.length(text) + 1)
        return F.struct(x["label"].alias("key"), F.trim(F.regexp_replace(F.substring(text, begin, F.greatest(stop - begin, F.lit(0))), skip, "")).alias("value"))

    return F.map_from_entries(F.transform(found, value))


def split_sections(text: Column, main: str, reasons: str) -> Column:
    """struct(main, reasons): text between two headings and after the second; null where order is wrong."""
    a, b = F.regexp_instr(text, F.lit(main)), F.regexp_instr(text, F.lit(reasons))
    fine = (a > 0) & (b > a)
    head, tail = F.regexp_extract(text, main, 0), F.regexp_extract(text, reasons, 0)
    first = F.substring(text, a + F.length(head), F.greatest(b - a - F.length(head), F.lit(0)))
    return F.when(fine, F.struct(F.trim(first).alias("main"), F.trim(F.substring(text, b + F.length(tail), F.length(text))).alias("reasons")))


def points(docs: DataFrame, marker: str, id_col: str = "doc_id", text_col: str = "text", least: int = 10) -> DataFrame:
    """(doc_id, point_no, point): split at enumerators, each point with its marker.

    Points under ``least`` characters are dropped; the others keep their number.
    """
    cut = F.filter(F.split(F.regexp_replace(F.col(text_col), marker, f"{START}$0"), START), lambda p: F.trim(p) != "")
    out = docs.select(F.col(id_col), F.posexplode(F.transform(cut, lambda p: tidy(p))).alias("at", "point"))
    return out.where(F.length("point") >= least).select(id_col, (F.col("at") + 1).alias("point_no"), "point")


def merged_points(docs: DataFrame, marker: str, id_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """(doc_id, point_no, point): points under ``least`` characters join the one before.

    A short one at the head stands alone. Blocks are bounded by a document.
    """
    cut = F.filter(F.split(F.regexp_replace(F.col(text_col), marker, f"{START}$0"), START), lambda p: F.trim(p) != "")
    parts = F.transform(cut, lambda p: tidy(p))
    empty = F.array().cast("array<string>")

    def add(done: Column, p: Column) -> Column:
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(F.element_at(done, -1), F.lit(" "), p)))
        return F.when((F.size(done) > 0) & (F.length(p) < least), joined).otherwise(F.concat(done, F.array(p)))

    out = docs.select(F.col(id_col), F.posexplode(F.aggregate(parts, empty, add)).alias("at", "point"))
    return out.select(id_col, (F.col("at") + 1).alias("point_no"), "point")


def first_boundary(text: Column, patterns: list[str]) -> Column:
    """Earliest position of any pattern, null if none occurs."""
    return F.least(*[F.nullif(F.regexp_instr(text, F.lit(p)), F.lit(0)) for p in patterns], F.lit(None).cast("int"))


def context_prefix(parts: list[tuple[Column, int | None]], text: Column) -> Column:
    """Parts, cut to their sizes, and the text, joined by blanks; null parts are left out."""
    return F.concat_ws(" ", *[F.left(c, F.lit(n)) if n else c for c, n in parts], text)


def three_part_chunks(docs: DataFrame, main: str, reasons: str, marker: str, id_col: str = "doc_id", text_col: str = "text", least: int = 40) -> DataFrame:
    """(doc_id, part, point_no, point): the text section whole, the reasoning section in merged points."""
    cut = docs.select(id_col, split_sections(F.col(text_col), main, reasons).alias("s")).where("s is not null")
    head = cut.where(F.col("s.main") != "").select(id_col, F.lit("text").alias("part"), F.lit(1).alias("point_no"), tidy(F.col("s.main")).alias("point"))
    tail = merged_points(cut.select(id_col, F.col("s.reasons").alias("text")), marker, id_col, "text", least)
    return head.unionByName(tail.select(id_col, F.lit("reasoning").alias("part"), "point_no", "point"))


def name_fields(name: Column, groups: dict[str, str], many: str | None = None, separator: str = "[&＆]") -> Column:
    """struct of one regexp group per field, null where it doesn't match; ``many`` is split as well."""
    got = {k: F.nullif(F.regexp_extract(name, p, 1), F.lit("")) for k, p in groups.items()}
    fields = [c.alias(k) for k, c in got.items()]
    if many:
        fields += [F.split(got[many], separator).alias(f"{many}_list"), (F.size(F.split(got[many], separator)) > 1).alias("is_compound")]
    return F.struct(*fields)


def format_labels(text: Column, labels: dict[str, str], unknown: str = "unknown") -> Column:
    """Labels whose pattern occurs, joined by plus signs, else ``unknown``."""
    found = F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in labels.items()])), "+")
    return F.coalesce(F.nullif(found, F.lit("")), F.lit(unknown))


def first_digest(choices: dict[str, Column], most: int = 200) -> tuple[Column, Column]:
    """(digest, provenance): the first choice that isn't null or blank, cut at ``most``."""
    texts = {k: F.nullif(F.trim(c), F.lit("")) for k, c in choices.items()}
    source = F.lit(None).cast("string")
    for k in reversed(texts):
        source = F.when(texts[k].isNotNull(), F.lit(k)).otherwise(source)
    return F.left(F.coalesce(*texts.values()), F.lit(most)), source


def noise_share(raw: Column, clean: Column) -> Column:
    """Percent of the raw text's non-blank characters that cleaning took, one decimal, 0 for empty raw."""
    n, m = F.length(F.regexp_replace(raw, r"\s", "")), F.length(F.regexp_replace(clean, r"\s", ""))
    return F.when(n > 0, F.round((1 - m / n) * 100, 1)).otherwise(F.lit(0.0))


def citations(docs: DataFrame, name_pattern: str, article_pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, cite_no, name, article) of each pair that two patterns give in step (groups 1 and 2)."""
    pairs = F.arrays_zip(F.regexp_extract_all(F.col(text_col), F.lit(name_pattern), F.lit(1)).alias("name"), F.regexp_extract_all(F.col(text_col), F.lit(article_pattern), F.lit(2)).alias("article"))
    out = docs.select(F.col(id_col), F.posexplode(pairs).alias("at", "p"))
    return out.select(id_col, (F.col("at") + 1).alias("cite_no"), F.col("p.name").alias("name"), F.col("p.article").alias("article"))


def low_text_pages(pages: DataFrame, doc_col: str, page_col: str, text_col: str = "text", least: int = 20) -> DataFrame:
    """(doc, pages, reason): pages with fewer than ``least`` non-blank characters."""
    short = F.length(F.coalesce(F.regexp_replace(F.col(text_col), r"\s", ""), F.lit(""))) < least
    out = pages.where(short).groupBy(doc_col).agg(F.array_sort(F.collect_list(page_col)).alias("pages"))
    return out.withColumn("reason", F.concat(F.lit("little text on page "), F.array_join(F.col("pages").cast("array<string>"), ", ")))


def distinct_matches(text: Column, pattern: str) -> Column:
    """Sorted distinct matches, as in the report of compatibility characters."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, para_id, para): trimmed lines that aren't empty, p1 to pn."""
    lines = F.filter(F.transform(F.split(F.col(text_col), "\n+"), lambda p: F.trim(p)), lambda p: p != "")  # F.trim itself would take the index as what to trim
    return docs.select(F.col(id_col), F.posexplode(lines).alias("at", "para")).select(id_col, F.concat(F.lit("p"), F.col("at") + 1).alias("para_id"), "para")


def truncated(text: Column, most: int) -> Column:
    """struct(head, length, cut)."""
    return F.struct(F.left(text, F.lit(most)).alias("head"), F.length(text).alias("length"), (F.length(text) > most).alias("cut"))


def scrub_query(query: Column, remove: str, stop: list[str], punctuation: str = r"[^\p{L}\p{N}\s]", least: int = 6, most: int = 60) -> Column:
    """struct(query, removed): patterns out, punctuation to blanks, whole stop words out.

    Under ``least`` characters the query without patterns stays; cut at ``most``.
    """
    removed = F.regexp_extract_all(query, F.lit(remove), F.lit(0))
    plain = tidy(F.regexp_replace(F.regexp_replace(query, remove, " "), punctuation, " "))
    words = F.split(plain, " ")
    known = F.array(*[F.lit(s) for s in stop])
    short = F.array_join(F.filter(words, lambda w: ~F.array_contains(known, F.lower(w))), " ")
    stops = F.filter(words, lambda w: F.array_contains(known, F.lower(w)))
    return F.struct(F.left(F.when(F.length(short) < least, plain).otherwise(short), F.lit(most)).alias("query"), F.concat(removed, stops).alias("removed"))


def name_suffixes(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """(doc_id, pos, name): every suffix of ``least`` characters or more of each matched name, first seen first."""
    words = F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(0))
    long = docs.select(F.col(id_col), F.posexplode(words).alias("w_at", "w")).where(F.length("w") >= least)
    long = long.select(id_col, "w_at", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("w") - least + 1), lambda i: F.substring(F.col("w"), i, F.length("w")))).alias("s_at", "name"))
    first = long.groupBy(id_col, "name").agg(F.min(F.struct("w_at", "s_at")).alias("at"))
    return first.select(id_col, F.row_number().over(W.partitionBy(id_col).orderBy("at")).alias("pos"), "name")
