"""Data-driven rules over a table of cases, and legal periods.

Rules are rows; each enabled rule becomes a column expression over the wide case
row, so one scan evaluates all rules for all cases. ``register_check`` adds a
check: a function of (rule, fields) that gives the outcome column. A rule that
can't be built or that doesn't fit its columns is unclear, the others stand.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException, SparkRuntimeException
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

@dataclass(frozen=True)
class Rule:
    code: str
    check: str
    fields: tuple[str, ...] = ()
    label: str = ""
    params: dict = field(default_factory=dict)
    partial_ok: bool = False
    enabled: bool = True
    basis: str | None = None
    curable: bool = False
    coverage_note: str | None = None


def outcome(status: Column | str, note: Column | str | None = None, value: Column | None = None, computed: Column | None = None) -> Column:
    """struct(status, note, value, computed), all text: ``value`` is what was looked at, ``computed`` what came of it."""
    status = F.lit(status) if isinstance(status, str) else status
    parts = {"note": F.lit(note) if note is None or isinstance(note, str) else note, "value": F.lit(None) if value is None else value, "computed": F.lit(None) if computed is None else computed}
    return F.struct(status.alias("status"), *[c.cast("string").alias(name) for name, c in parts.items()])


def _filled(value: Column) -> Column:
    return F.coalesce(F.trim(value.cast("string")) != "", F.lit(False))


def present(rule: Rule, get: Callable[[str], Column]) -> Column:
    v = get(rule.fields[0])
    return outcome(F.when(_filled(v), "present").otherwise("missing"), value=v)


def all_present(rule: Rule, get: Callable[[str], Column]) -> Column:
    """All, none, or some; some is partial where the rule allows it; the note lists what is missing."""
    missing = F.array_compact(F.array(*[F.when(~_filled(get(f)), F.lit(f)) for f in rule.fields]))
    some = "partial" if rule.partial_ok else "missing"
    status = F.when(F.size(missing) == 0, "present").when(F.size(missing) == len(rule.fields), "missing").otherwise(some)
    return outcome(status, F.nullif(F.array_join(missing, ", "), F.lit("")))


def array_min(rule: Rule, get: Callable[[str], Column]) -> Column:
    n = F.coalesce(F.size(get(rule.fields[0])), F.lit(0))
    n = F.greatest(n, F.lit(0))
    return outcome(F.when(n >= rule.params["least"], "present").when(n == 0, "missing").otherwise("partial"), n, computed=n)


def _told(v: Column) -> Column:
    """``v`` as a boolean, null if it isn't one; texts by the words a cast takes, since a failing cast costs an exception a row."""
    word = F.lower(F.trim(v.cast("string")))
    text = F.when(word.isin("t", "true", "y", "yes", "1"), True).when(word.isin("f", "false", "n", "no", "0"), False)
    return F.when(F.typeof(v) == "string", text).otherwise(v.try_cast("boolean"))


def flag_true(rule: Rule, get: Callable[[str], Column]) -> Column:
    v = get(rule.fields[0])
    told = _told(v)
    return outcome(F.when(told.isNull(), "unclear").when(told, "present").otherwise("missing"), value=v)


def flag_triggers(rule: Rule, get: Callable[[str], Column]) -> Column:
    v = get(rule.fields[0])
    told = _told(v)
    return outcome(F.when(told.isNull(), "unclear").when(told, "triggered").otherwise("no_match"), value=v)


def date_within(rule: Rule, get: Callable[[str], Column]) -> Column:
    p = appeal_period(get(rule.fields[0]), get(rule.fields[1]), rule.params.get("days", 30))
    return outcome(F.when(~p["ok"], "unclear").when(p["is_overdue"], "triggered").otherwise("no_match"), F.coalesce(p["reason"], p["overdue_days"].cast("string")), computed=p["deadline"])


def manual(rule: Rule, get: Callable[[str], Column]) -> Column:
    return outcome("need_human")


def regex(rule: Rule, get: Callable[[str], Column]) -> Column:
    v = get(rule.fields[0])
    return outcome(F.when(v.isNull(), "missing").when(v.rlike(rule.params["pattern"]), "present").otherwise("partial"), value=v)


def entity_kind(rule: Rule, get: Callable[[str], Column]) -> Column:
    """Organisations need a representative; a name with the marker is a person."""
    marker = rule.params["person_marker"]
    firms = F.filter(get(rule.fields[0]), lambda x: (x["kind"] == "organisation") & ~F.coalesce(x["name"].contains(marker), F.lit(False)))
    bare = F.filter(firms, lambda x: ~_filled(x["rep_name"]))
    n = F.coalesce(F.size(firms), F.lit(0))
    return outcome(F.when(n <= 0, "not_applicable").when(F.size(bare) > 0, "need_human").otherwise("no_match"), F.nullif(F.array_join(F.transform(bare, lambda x: x["name"]), ", "), F.lit("")))


def adult_age(rule: Rule, get: Callable[[str], Column]) -> Column:
    """Natural persons under age at the base date; the threshold is 18 from 2023-01-01, before it 20."""
    base = get(rule.fields[1]).try_cast("date")
    people = F.filter(get(rule.fields[0]), lambda x: x["kind"] == "natural")
    limit = F.when(base >= F.lit("2023-01-01").cast("date"), 18).otherwise(20)

    def age(birth: Column) -> Column:
        earlier = (F.month(base) < F.month(birth)) | ((F.month(base) == F.month(birth)) & (F.day(base) < F.day(birth)))
        return F.year(base) - F.year(birth) - earlier.cast("int")

    minors = F.filter(people, lambda x: F.coalesce(age(x["birth"].try_cast("date")) < limit, F.lit(False)))
    unknown = F.exists(people, lambda x: x["birth"].try_cast("date").isNull())
    status = F.when(base.isNull(), "unclear").when(F.size(minors) > 0, "need_human").when(unknown, "unclear").otherwise("no_match")
    return outcome(status, F.nullif(F.array_join(F.transform(minors, lambda x: x["name"]), ", "), F.lit("")))


CHECKS: dict[str, Callable] = {
    "present": present,
    "all_present": all_present,
    "array_min": array_min,
    "flag_true": flag_true,
    "flag_triggers": flag_triggers,
    "date_within": date_within,
    "manual": manual,
    "regex": regex,
    "entity_kind": entity_kind,
    "adult_age": adult_age,
}


def register_check(name: str, builder: Callable[[Rule, Callable[[str], Column]], Column]) -> None:
    """Makes a check known to run_rules."""
    CHECKS[name] = builder


def _compiles(cases: DataFrame, pattern: str) -> None:
    """Raises if the JVM's regular expressions don't take ``pattern``; no job runs for that."""
    try:
        cases.sparkSession._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException) as bad:
        raise SparkRuntimeException(f"bad pattern {pattern!r}") from bad


def _built(cases: DataFrame, rule: Rule) -> Column:
    """The rule's outcome on these columns, tried on no rows."""
    if rule.check not in CHECKS:
        return outcome("need_human", f"unknown check {rule.check}")
    if any(f not in cases.columns for f in rule.fields):
        return outcome("unclear", "a field is not there")
    try:
        got = CHECKS[rule.check](rule, lambda f: cases[f])
        cases.select(got)  # unfit types show here
        if "pattern" in rule.params:
            _compiles(cases, rule.params["pattern"])
    except (PySparkException, LookupError, TypeError, ValueError, AttributeError) as failed:
        return outcome("unclear", f"rule failed: {type(failed).__name__}")
    return got


def run_rules(cases: DataFrame, rules: list[Rule], case_col: str, confidence: dict[str, str] | None = None) -> DataFrame:
    """(case, code, label, basis, check, status, note, value, computed, curable, coverage_note, input_confidence): every enabled rule on every case.

    An unknown check asks a human; a rule that can't be built, doesn't fit the
    columns' types, or has a bad pattern is unclear, and never fails the run.
    Values that can't be read as what a check needs count as absent. ``confidence``
    names for a field the column with its confidence: a result is no surer than
    the least sure field it read.
    """
    outcomes, fixed = _outcomes(cases, rules, case_col, confidence)
    # the outcomes are a projection of their own: generated code, as a generator's argument they would be interpreted
    outcomes = outcomes.select(case_col, F.explode("_told").alias("_r")).select(case_col, "_r.*")
    names = cases.sparkSession.createDataFrame(fixed, "_n int, code string, label string, basis string, check string, curable boolean, coverage_note string")
    return outcomes.join(F.broadcast(names), "_n").select(case_col, "code", "label", "basis", "check", "status", "note", "value", "computed", "curable", "coverage_note", "input_confidence")


def _outcomes(cases: DataFrame, rules: list[Rule], case_col: str, confidence: dict[str, str] | None = None, keep: list[str] | None = None) -> tuple[DataFrame, list[tuple]]:
    """(case, keep..., _told), all outcomes of a row of ``cases`` in one array, and what is fixed of each rule."""
    told, fixed = [], []
    for r in rules:
        if not r.enabled:
            continue
        got = _built(cases, r)
        sure = [cases[confidence[f]] for f in r.fields if confidence and f in confidence]
        least = lowest_confidence(sure) if sure else F.lit(None).cast("string")
        told.append(F.struct(F.lit(len(told)).alias("_n"), *[got[k].alias(k) for k in ("status", "note", "value", "computed")], least.alias("input_confidence")))
        fixed.append((len(fixed), r.code, r.label, r.basis, r.check, r.curable, r.coverage_note))
    if not told:
        told = [F.struct(F.lit(-1).alias("_n"), *[F.lit(None).cast("string").alias(k) for k in ("status", "note", "value", "computed", "input_confidence")])]
    return cases.select(case_col, *(keep or []), F.array(*told).alias("_told")), fixed


def items_present(items: DataFrame, need: DataFrame, case_col: str, kind_col: str, label_col: str, cases: DataFrame, optional: bool = False) -> DataFrame:
    """(case, status, problems): required sub-fields of array elements by their kind.

    ``items``: one row an element with its sub-fields; ``need``: (kind, name). An
    unknown kind is a problem; no element is not_applicable if optional, else missing.
    """
    wanted = need.groupBy(F.col("kind").alias("_k")).agg(F.collect_list("name").alias("_need"))
    rows = items.join(wanted, items[kind_col] == F.col("_k"), "left")
    names = [c for c in items.columns if c not in (case_col, kind_col, label_col)]
    have = F.array_compact(F.array(*[F.when(_filled(F.col(c)), F.lit(c)) for c in names]))
    gone = F.array_sort(F.array_except("_need", have))
    problem = F.when(F.col("_k").isNull(), F.concat(F.col(label_col).cast("string"), F.lit(": unknown kind"))).when(F.size(gone) > 0, F.concat(F.col(label_col).cast("string"), F.lit(": "), F.array_join(gone, ", ")))
    per = rows.select(case_col, problem.alias("p")).groupBy(case_col).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("p")).alias("problems"))
    out = cases.select(case_col).join(per, case_col, "left")
    bad = F.size("problems")
    status = F.when(F.col("n").isNull(), "not_applicable" if optional else "missing").when(bad == 0, "present").when(bad < F.col("n"), "partial").otherwise("missing")
    return out.select(case_col, status.alias("status"), F.coalesce("problems", F.array().cast("array<string>")).alias("problems"))


def prior_case(cases: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """``cases`` with outcome: triggered if the key is known, unclear if it is incomplete."""
    seen = known.select(*keys).distinct().withColumn("_seen", F.lit(True))
    incomplete = F.lit(False)
    for k in keys:
        incomplete = incomplete | F.col(k).isNull()
    out = cases.join(seen, keys, "left")
    got = F.when(incomplete, outcome("unclear", "incomplete key")).when(F.col("_seen"), outcome("triggered", "an earlier case has this key")).otherwise(outcome("no_match", "only the given table was searched"))
    return out.withColumn("outcome", got).drop("_seen")


def first_value(sources: dict[str, Column]) -> Column:
    """struct(value, source) of the first source that isn't null."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(k).alias("source"))) for k, c in sources.items()])


def lowest_confidence(values: list[Column]) -> Column:
    """The lowest of high, medium, low; absent ones are left out, null if there is none."""
    level = lambda v: F.when(v == "high", 3).when(v == "medium", 2).when(v == "low", 1)
    least = F.array_min(F.array(*[level(v) for v in values]))
    return F.when(least == 1, "low").when(least == 2, "medium").when(least == 3, "high")


def rule_group(code: Column) -> Column:
    """format and procedure by the code's prefix; what is left is other, never lost."""
    return F.when(code.startswith("F"), "format").when(code.startswith("P"), "procedure").otherwise("other")


def summarize(results: DataFrame, case_col: str) -> DataFrame:
    """One row a case: verdict, suggestion, counts and a warning when a trigger rests on low confidence."""
    g = rule_group(F.col("code"))
    hit = (g == "procedure") & (F.col("status") == "triggered")
    low = hit & (F.col("input_confidence") == "low")
    out = results.groupBy(case_col).agg(
        F.count_if(hit).alias("triggered"),
        F.count_if((g == "format") & F.col("status").isin("missing", "partial")).alias("gaps"),
        F.count_if((g == "procedure") & (F.col("status") == "need_human")).alias("to_decide"),
        F.count_if(low).alias("weak"),
        F.array_sort(F.collect_list(F.when(hit | ((g == "format") & F.col("status").isin("missing", "partial")), F.col("code")))).alias("items"),
    )
    return _verdicts(out, case_col)


def _verdicts(counts: DataFrame, case_col: str) -> DataFrame:
    verdict = F.when(F.col("triggered") > 0, "blocked").when(F.col("gaps") > 0, "warning").when(F.col("to_decide") > 0, "need_human").otherwise("ok")
    suggestion = F.when(F.col("triggered") > 0, "inadmissible").when(F.col("gaps") > 0, "amend").otherwise("substantive")
    return counts.select(case_col, verdict.alias("verdict"), suggestion.alias("suggestion"), "triggered", "gaps", "to_decide", "items", (F.col("weak") > 0).alias("low_confidence"))


def case_verdicts(cases: DataFrame, rules: list[Rule], case_col: str, sure: str) -> DataFrame:
    """``summarize`` of all rules on ``cases``, whose column ``sure`` is the confidence of all its results.

    A row's outcomes are counted where they are made, so one short row a row of
    ``cases`` is grouped and none a rule.
    """
    rows, fixed = _outcomes(cases, rules, case_col, keep=[sure])
    codes = [(n, code) for n, code, *_ in fixed]

    def those(group: str, *statuses: str) -> Column:
        """The codes of a group whose outcome is one of ``statuses``."""
        # no function of a lambda: that would interpret the rules instead of generating code
        none = F.array().cast("array<string>")
        own = [F.when(F.col("_told")[n]["status"].isin(*statuses), F.array(F.lit(code))).otherwise(none) for n, code in codes if code[:1] == {"format": "F", "procedure": "P"}[group]]
        return F.concat(none, *own)

    counts = rows.select(case_col, sure, those("procedure", "triggered").alias("_hit"), those("format", "missing", "partial").alias("_gap"), F.size(those("procedure", "need_human")).alias("_ask"))
    hits = F.size("_hit")
    counts = counts.select(case_col, hits.alias("triggered"), F.size("_gap").alias("gaps"), F.col("_ask").alias("to_decide"), F.when(F.col(sure) == "low", hits).otherwise(0).alias("weak"), F.concat("_hit", "_gap").alias("items"))
    sums = [F.sum(c).alias(c) for c in ("triggered", "gaps", "to_decide", "weak")]
    return _verdicts(counts.groupBy(case_col).agg(*sums, F.sort_array(F.flatten(F.collect_list("items"))).alias("items")), case_col)


def effect(code: Column, status: Column) -> Column:
    """What a result means for the officer."""
    g = rule_group(code)
    return F.when(status.isin("present", "no_match", "not_applicable"), "pass").when((g == "format") & status.isin("missing", "partial"), "amend").when((g == "procedure") & (status == "triggered"), "inadmissible").otherwise("unknown")


def default_pick(results: DataFrame, case_col: str, pos: str) -> DataFrame:
    """(case, pick, decision): inadmissible before amend, computed before judged, then input order; none is substantive."""
    e = effect(F.col("code"), F.col("status"))
    colour = F.when(e == "inadmissible", 0).when(e == "amend", 1)
    key = F.struct(colour.alias("c"), (F.col("check") == "manual").alias("m"), F.col(pos).alias("p"))
    out = results.groupBy(case_col).agg(F.min_by(F.struct("code", e.alias("effect")), F.when(colour.isNotNull(), key)).alias("b"))
    return out.select(case_col, F.col("b.code").alias("pick"), F.coalesce("b.effect", F.lit("substantive")).alias("decision"))


def grounds(results: DataFrame, case_col: str, late_code: str) -> DataFrame:
    """(case, reasons, grounds, warnings): the late ground first; with it curable ones only warn."""
    late = F.col("code") == late_code
    rows = results.where(F.col("status").isin("triggered", "missing", "partial")).withColumn("_late", F.max(late.cast("int")).over(W.partitionBy(case_col)) == 1)
    order = F.struct((~late).alias("o"), F.col("code"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c, order))), lambda x: x["code"])
    return rows.groupBy(case_col).agg(pick(late | ~F.col("_late")).alias("reasons"), pick(F.lit(True)).alias("grounds"), pick(~late & F.col("_late")).alias("warnings"))


def template(parts: list[Column | str], empty: str = "-") -> Column:
    """Text with null-safe slots."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit(empty)) for p in parts])


def intake(files: DataFrame, case_col: str, name_col: str, allowed: list[str], readable: list[str] | None = None, text_col: str | None = None) -> DataFrame:
    """``files`` with extension, duplicate, accepted, parseable and error.

    Of the accepted ones those with a ``readable`` extension are parseable; the
    others are kept unread. A parseable file without text is kept too. ``error``
    says why a file is refused, not read, or empty, else it is null.
    """
    ext = F.lower(F.regexp_extract(F.regexp_replace(name_col, r"[?#].*$", ""), r"\.([A-Za-z0-9]+)$", 1))
    again = F.count(F.lit(1)).over(W.partitionBy(case_col, name_col)) > 1
    out = files.withColumn("extension", ext).withColumn("duplicate", again)
    out = out.withColumn("accepted", F.coalesce(F.col("extension").isin(*allowed), F.lit(False)) & ~F.col("duplicate"))
    out = out.withColumn("parseable", F.col("accepted") & F.col("extension").isin(*(allowed if readable is None else readable)))
    empty = F.lit(False) if text_col is None else ~_filled(F.col(text_col))
    error = F.when(F.col("duplicate"), "name repeated").when(~F.col("accepted"), "extension not allowed").when(~F.col("parseable"), "kept, not read").when(empty, "no text in it")
    return out.withColumn("error", error)


def confirmations(fields: DataFrame, results: DataFrame, rules: list[Rule], case_col: str, always: list[str], if_empty: list[str]) -> DataFrame:
    """(case, key): fields to confirm - weak ones, listed ones, and those behind rules that didn't pass."""
    behind = [(r.code, f.split(".")[0]) for r in rules for f in r.fields]
    used = results.sparkSession.createDataFrame(behind or [("", "")], "code string, key string")
    failed = results.where(~F.col("status").isin("present", "no_match", "not_applicable")).join(used, "code").select(case_col, "key")
    own = fields.where((F.col("confidence") == "low") | F.col("key").isin(*always) | (F.col("key").isin(*if_empty) & ~_filled(F.col("value")))).select(case_col, "key")
    return own.union(failed).distinct().join(fields.select(case_col, "key").distinct(), [case_col, "key"], "left_semi")


def case_confirmations(cases: DataFrame, rules: list[Rule], case_col: str, fields: dict[str, tuple[Column, Column]], always: list[str], if_empty: list[str]) -> DataFrame:
    """``confirmations`` where a case's fields lie in its row: for each key its columns of value and confidence.

    The keys are told within the row, so neither fields nor results are joined.
    """
    mine = [F.struct(v.cast("string").alias("v"), c.alias("c")).alias(f"_f{i}") for i, (v, c) in enumerate(fields.values())]
    rows, fixed = _outcomes(cases.select("*", *mine), rules, case_col, keep=[f"_f{i}" for i in range(len(mine))])
    used = {(r.code, f.split(".")[0]) for r in rules for f in r.fields}
    keys = []
    for i, key in enumerate(fields):
        behind = [n for n, code, *_ in fixed if (code, key) in used]
        ask = F.coalesce(F.col(f"_f{i}.c") == "low", F.lit(False)) | F.lit(key in always)
        if key in if_empty:
            ask = ask | ~_filled(F.col(f"_f{i}.v"))
        for n in behind:
            ask = ask | ~F.coalesce(F.col("_told")[n]["status"].isin("present", "no_match", "not_applicable"), F.lit(True))
        keys.append(F.when(ask, F.lit(key)))
    found = rows.where(F.col(case_col).isNotNull()).select(case_col, F.array(*keys).alias("_keys"))
    return found.select(case_col, F.explode("_keys").alias("key")).where("key is not null").distinct()


def appeal_period(served: Column, filed: Column, days: int = 30) -> Column:
    """The whole computation: from the day after service; not computable without both dates or filed before service."""
    s, f = served.try_cast("date"), filed.try_cast("date")
    start = F.date_add(s, 1)
    deadline = F.date_add(s, days)
    fine = s.isNotNull() & f.isNotNull() & (f >= s)
    day_n = F.datediff(f, s)
    over = F.greatest(F.datediff(f, deadline), F.lit(0))
    reason = F.when(s.isNull() | f.isNull(), "a date is missing").when(f < s, "filed before service")
    return F.struct(
        F.coalesce(fine, F.lit(False)).alias("ok"),
        F.when(fine, start).alias("start_from"),
        F.when(fine, deadline).alias("deadline"),
        F.when(fine, day_n).alias("day_n"),
        F.when(fine, over).alias("overdue_days"),
        F.when(fine, F.greatest(F.datediff(deadline, f), F.lit(0))).alias("remaining_days"),
        F.when(fine, over > 0).alias("is_overdue"),
        reason.alias("reason"),
    )


def amend_deadline(notice: Column, days: int = 20) -> Column:
    """The last of ``days`` days from the day after the notice."""
    return F.date_add(notice.cast("date"), days)


ROC_YEAR = 1911
#: The two published spellings, and the wide digits that may stand for digits.
ROC_SIGNS = r"(?U)^\s*(\d{2,3})\s*[-/.]\s*(\d{1,2})\s*[-/.]\s*(\d{1,2})\s*$"
ROC_WORDS = r"(?U)^\s*(?:民國)?\s*(\d{2,3})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*[日號]?\s*$"
WIDE_DIGITS = "０１２３４５６７８９"


def parse_roc(text: Column) -> Column:
    """ROC calendar text in either published spelling to a date; null if it isn't one, or no day of the calendar."""
    plain = F.translate(text, WIDE_DIGITS, "0123456789")

    def group(i: int) -> Column:
        found = [F.nullif(F.regexp_extract(plain, p, i), F.lit("")) for p in (ROC_SIGNS, ROC_WORDS)]
        return F.coalesce(*found)

    year = (group(1).try_cast("int") + F.lit(ROC_YEAR)).cast("string")
    return F.try_to_date(F.concat(F.lpad(year, 4, "0"), F.lit("-"), F.lpad(group(2), 2, "0"), F.lit("-"), F.lpad(group(3), 2, "0")), "yyyy-MM-dd")


def to_roc(date: Column) -> Column:
    d = date.cast("date")
    return F.when(d.isNotNull(), F.format_string("%03d-%02d-%02d", F.year(d) - ROC_YEAR, F.month(d), F.day(d)))
