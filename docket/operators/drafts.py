"""Checks of drafted sections against their cited sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators.evidence import containing, scan_for, squashed
from docket.session import cut

DECIDED = ("has merit", "without merit")


def depunct(text: Column) -> Column:
    """Without white space and punctuation."""
    return F.regexp_replace(squashed(text), r"[\p{P}\p{S}]", "")


def citations_outside(sections: DataFrame, allowed: DataFrame, case_col: str) -> DataFrame:
    """``sections`` (citations) with outside and no_source: cited keys not allowed for the case."""
    ok = allowed.groupBy(case_col).agg(F.collect_set("ref_key").alias("_ok"))
    out = sections.join(ok, case_col, "left")
    empty = F.array().cast("array<string>")
    cited, known = F.coalesce("citations", empty), F.coalesce("_ok", empty)
    return out.select(*sections.columns, F.array_except(cited, known).alias("outside"), (F.size(F.array_intersect(cited, known)) == 0).alias("no_source"))


def text_citations(sections: DataFrame, pattern: str, own: str, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """(ids, cites): citations written in the text as name#article[-sub], distinct in order, self-references out.

    ``pattern`` has three groups: name, article, sub-number.
    """
    got = [F.regexp_extract_all(F.col(text_col), F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    zipped = F.arrays_zip(got[0].alias("n"), got[1].alias("a"), got[2].alias("s"))
    named = F.transform(F.filter(zipped, lambda x: ~x["n"].rlike(own)), lambda x: F.concat(x["n"], F.lit("#"), x["a"], F.when(x["s"] != "", F.concat(F.lit("-"), x["s"])).otherwise("")))
    return sections.select(*id_cols, F.array_distinct(named).alias("cites"))


def repair_names(names: DataFrame, known: DataFrame, leading: list[str], least: int = 2, suffix: int = 3) -> DataFrame:
    """(name, repaired): leading words stripped, else the longest known suffix, else the name itself.

    Works on distinct names only.
    """
    one = names.select("name").distinct()
    words = "|".join(sorted(leading, key=lambda w: (-len(w), w)))
    stripped = F.regexp_replace("name", f"^(?:{words})+(?=.{{{least},}})", "")
    base = one.select("name", stripped.alias("base"))
    ok = known.select(F.col("name").alias("k")).distinct()
    tails = base.select("name", F.explode(F.when(F.length("base") >= suffix, F.transform(F.sequence(F.lit(1), F.length("base") - suffix + 1), lambda i: F.substring("base", i, F.length("base")))).otherwise(F.array("base"))).alias("k"))
    best = tails.join(ok, "k").groupBy("name").agg(F.max_by("k", F.length("k")).alias("best"))
    whole = base.join(ok, F.col("base") == F.col("k"), "left")
    return whole.join(best, "name", "left").select("name", F.coalesce("k", "best", "name").alias("repaired"))


def fragments(quote: Column, ellipsis: str = r"…+|\.{3,}", least: int = 8) -> Column:
    """Pieces of a quote between ellipses, white space out, of ``least`` characters or more."""
    return F.filter(F.transform(F.split(quote, ellipsis), squashed), lambda p: F.length(p) >= least)


def verify_quotes(quotes: DataFrame, sources: DataFrame, case_col: str | None = None, least: int = 12, cut_at: int = 600) -> DataFrame:
    """(quote_id, result, found_in, cited_truncated): verbatim, misattributed, same_without_punctuation, not_found; short ones emphasis.

    ``quotes``: quote_id, quote, cited (keys); ``sources``: ref_key, text, both
    with the case if there is one. A quote is in a source if every fragment is.
    ``cited_truncated`` lists for a quote that wasn't found the cited sources of
    ``cut_at`` characters or more: they may have been cut there, and the quote may
    stand in what is missing. Without a case, pieces of both forms are sought in
    one scan of the sources if they are few enough (``evidence.scan_for``).
    """
    on = [case_col] if case_col else None
    keys = on or []
    long = quotes.where(F.length("quote") >= least)
    parts = long.select("quote_id", *keys, F.size(fragments(F.col("quote"))).alias("n"), F.posexplode(F.array_distinct(fragments(F.col("quote")))).alias("at", "piece"))
    body = squashed(F.col("text"))
    texts = sources.select("ref_key", *keys, body.alias("body"), depunct(body).alias("loose"))
    parts = parts.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("quote_id")))
    forms = {"body": parts, "loose": parts.withColumn("piece", depunct(F.col("piece"))).where(F.length("piece") > 0)}
    scanned = None if on else scan_for(texts, "ref_key", forms)
    scanned = scanned if scanned is None else cut(scanned)

    def whole(form: str) -> DataFrame:
        """(quote_id, ref_key) of the sources that hold all pieces of a quote."""
        if scanned is not None:
            found = forms[form].join(scanned.where(F.col("kind") == form), "piece")
        else:
            found = containing(forms[form], texts.withColumn("body", F.col(form)).drop("loose"), "piece", "body", on)
        found = found.select("quote_id", "ref_key", "at", "n").distinct()
        return found.groupBy("quote_id", "ref_key").agg(F.countDistinct("at").alias("have"), F.max("n").alias("n")).where("have = n").select("quote_id", "ref_key")

    hit = whole("body").join(long.select("quote_id", "cited"), "quote_id").withColumn("own", F.array_contains("cited", F.col("ref_key")))
    plain = whole("loose")
    a = hit.groupBy("quote_id").agg(F.max(F.col("own").cast("int")).alias("own"), F.min(F.when(F.col("own"), F.col("ref_key"))).alias("here"), F.min("ref_key").alias("there"))
    b = plain.groupBy("quote_id").agg(F.min("ref_key").alias("loose"))
    out = quotes.select("quote_id", F.length("quote").alias("size")).join(a, "quote_id", "left").join(b, "quote_id", "left")
    result = F.when(F.col("size") < least, "emphasis").when(F.col("own") == 1, "verbatim").when(F.col("there").isNotNull(), "misattributed").when(F.col("loose").isNotNull(), "same_without_punctuation").otherwise("not_found")
    found_in = F.when(F.col("own") == 1, F.col("here")).otherwise(F.coalesce("there", "loose"))
    out = out.select("quote_id", result.alias("result"), found_in.alias("found_in"))
    cited = quotes.select("quote_id", *keys, F.explode("cited").alias("ref_key"))
    full = sources.where(F.length("text") >= cut_at).select(*keys, "ref_key")
    long_ones = cited.join(full, [*keys, "ref_key"]).groupBy("quote_id").agg(F.array_sort(F.collect_set("ref_key")).alias("cut"))
    none = F.array().cast(dict(long_ones.dtypes)["cut"])
    return out.join(long_ones, "quote_id", "left").select("quote_id", "result", "found_in", F.when(F.col("result") == "not_found", F.coalesce("cut", none)).otherwise(none).alias("cited_truncated"))


def deferrals(text: Column, conclusion: Column, pattern: str, decided: tuple[str, ...] = DECIDED) -> Column:
    """The words that defer a finding while the conclusion is a decided one, else null."""
    return F.when(conclusion.isin(*decided), F.nullif(F.regexp_extract(text, pattern, 0), F.lit("")))


def headline_conflicts(heads: DataFrame, sections: DataFrame, case_col: str, dismissing: Column, merit: Column, open_: Column) -> DataFrame:
    """(case, conflict, numbers): a dismissing headline with sections that have merit, else with undecided ones."""
    pick = lambda c: F.array_sort(F.collect_list(F.when(c, F.col("no"))))
    per = sections.groupBy(case_col).agg(pick(merit).alias("merit"), pick(open_).alias("open"))
    out = heads.withColumn("_d", dismissing).join(per, case_col, "left")
    conflict = F.when(F.col("_d") & (F.size("merit") > 0), "merit").when(F.col("_d") & (F.size("open") > 0), "undecided")
    return out.select(case_col, conflict.alias("conflict"), F.when(conflict == "merit", F.col("merit")).when(conflict == "undecided", F.col("open")).alias("numbers"))


def outside_domain(value: Column, allowed: list[str]) -> Column:
    """A value that isn't null and isn't allowed."""
    return value.isNotNull() & ~value.isin(*allowed)


def forbidden_terms(text: Column, patterns: dict[str, str]) -> Column:
    """Array of struct(why, found): the first match of each pattern that occurs."""
    hit = [F.when(text.rlike(p), F.struct(F.lit(why).alias("why"), F.regexp_extract(text, p, 0).alias("found"))) for why, p in patterns.items()]
    return F.array_compact(F.array(*hit))


def route_words(text: Column, words: list[str], on_route: Column) -> Column:
    """Listed words that occur, on the route only."""
    found = F.filter(F.array(*[F.lit(w) for w in words]), lambda w: text.contains(w))
    return F.when(on_route, found).otherwise(F.array().cast("array<string>"))


def headline_check(head: Column, route: Column, dismiss: str, most: int = 60) -> Column:
    """empty, too long, or against the route in either direction; null if fine."""
    dismisses = head.rlike(dismiss)
    return F.when(head.isNull() | (F.trim(head) == ""), "empty").when(F.length(head) > most, "too long").when((route == "inadmissible") & ~dismisses, "route dismisses, headline does not").when((route == "substantive") & dismisses, "headline dismisses, route does not")


def alerts(rows: DataFrame, id_cols: list[str], warnings: dict[str, tuple[str, str]]) -> DataFrame:
    """(ids, pos, level, label, detail): each warning column that isn't null becomes a row, in fixed order."""
    parts = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("pos"), F.lit(level).alias("level"), F.lit(label).alias("label"), F.col(c).cast("string").alias("detail"))) for i, (c, (level, label)) in enumerate(warnings.items(), 1)]
    return rows.select(*id_cols, F.explode(F.array_compact(F.array(*parts))).alias("a")).select(*id_cols, "a.*")


def first_word_rule(text: Column, rules: list[tuple[str, str]], otherwise: str | None = None) -> Column:
    """The outcome of the first word in priority order that occurs."""
    out = F.lit(otherwise)
    for word, name in reversed(rules):
        out = F.when(text.contains(word), name).otherwise(out)
    return out
