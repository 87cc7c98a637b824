"""Name canonicalisation and corpus validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMALL_TABLE = 200_000
SMALL_BYTES = 64 << 20


def bounded(table: DataFrame, most: int = SMALL_TABLE, most_bytes: int = SMALL_BYTES) -> DataFrame:
    """A lookup table, broadcast only if it has ``most`` rows and ``most_bytes`` bytes as JSON at most."""
    head = table.limit(most + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    return F.broadcast(table) if head["n"] <= most and head["size"] <= most_bytes else table


def canonical_lookup(rows: DataFrame, value_col: str, table: DataFrame, key) -> DataFrame:
    """``rows`` with canonical and matched by tiers over ``table`` (alias, target).

    (1) the value's key is an alias, (2) the raw value is, (3) an alias' key
    equals the value's key, (4) the value is a target already; else the value
    stays, unmatched. Null and blank values count as matched. ``key`` makes the
    matching key of a column.
    """
    names = bounded(table.groupBy("alias").agg(F.min("target").alias("target")))
    keyed = names.withColumn("_k3", key(F.col("alias"))).groupBy("_k3").agg(F.min_by("target", "alias").alias("t3"))
    targets = table.select(F.col("target").alias("t4")).distinct()
    out = rows.withColumn("_k", key(F.col(value_col)))
    out = out.join(names.select(F.col("alias").alias("_a1"), F.col("target").alias("t1")), F.col("_k") == F.col("_a1"), "left")
    out = out.join(names.select(F.col("alias").alias("_a2"), F.col("target").alias("t2")), F.col(value_col) == F.col("_a2"), "left")
    out = out.join(bounded(keyed), F.col("_k") == F.col("_k3"), "left")
    out = out.join(bounded(targets), F.col(value_col) == F.col("t4"), "left")
    blank = F.coalesce(F.trim(value_col), F.lit("")) == ""
    tier = F.when(blank, 0).when(F.col("t1").isNotNull(), 1).when(F.col("t2").isNotNull(), 2).when(F.col("t3").isNotNull(), 3).when(F.col("t4").isNotNull(), 4)
    canonical = F.when(blank, F.col(value_col)).otherwise(F.coalesce("t1", "t2", "t3", "t4", value_col))
    return out.select(*rows.columns, canonical.alias("canonical"), tier.isNotNull().alias("matched"), tier.alias("tier"))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """The first occurrence of ``old`` only, as plain text."""
    at = F.locate(old, text) if isinstance(old, str) else F.instr(text, old)
    return F.when((at > 0) & (F.length(old) > 0), F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))).otherwise(text)


def rename_units(units: DataFrame, table: DataFrame, key, name_col: str = "law", article_col: str = "article", text_col: str = "text") -> DataFrame:
    """Canonical names into units: the old one stays as *_raw, ref_key is rebuilt, the text's first mention follows."""
    found = canonical_lookup(units, name_col, table, key)
    kept = [c for c in units.columns if c not in (name_col, text_col, "ref_key")]
    return found.select(
        *kept,
        F.col(name_col).alias(f"{name_col}_raw"),
        F.col("canonical").alias(name_col),
        F.concat_ws("#", "canonical", F.col(article_col).cast("string")).alias("ref_key"),
        replace_first(F.col(text_col), F.col(name_col), F.col("canonical")).alias(text_col),
        "matched",
    )


def rename_nested(parents: DataFrame, children: DataFrame, on: str, parent_col: str, child_col: str, parent_table: DataFrame, child_table: DataFrame, key) -> DataFrame:
    """Children with their parent's canonical name and their own."""
    top = canonical_lookup(parents.select(on, parent_col), parent_col, parent_table, key).select(on, F.col("canonical").alias(f"{parent_col}_canonical"))
    low = canonical_lookup(children, child_col, child_table, key).withColumnRenamed("canonical", f"{child_col}_canonical").drop("matched", "tier")
    return low.join(top, on)


def _piece(text: Column, size: Column, i: Column, n: Column, shift: Column | None = None) -> Column:
    """The i-th of n pieces of a text of that size, or what stands in ``text`` at its place moved by ``shift``."""
    a, b = F.floor(i * size / n).cast("int"), F.floor((i + 1) * size / n).cast("int")
    at = a if shift is None else a + shift
    return F.when((at >= 0) & (at + b - a <= F.length(text)), F.substring(text, at + 1, b - a))


def near_names(values: DataFrame, known: DataFrame, least: int = 5, ratio: float = 0.34, top: int = 3) -> DataFrame:
    """(value, suggestion, distance, pos): known names within one character of length and ``ratio`` of edit distance.

    Names meet on pieces: with d edits allowed a known name is cut into d + 1
    pieces, of which one stands in any name within d edits unchanged, moved by d
    places at most. So no pair is missed, and a name meets only those that share
    a piece at about its place with it, never all of its length. ``least`` is 2 or
    more, ``ratio`` under one half.
    """
    if least < 2 or not 0 <= ratio < 0.5:
        raise ValueError("pieces would be empty")
    edits = lambda size: F.floor(ratio * (size + 1)).cast("int")
    k = known.select(F.col("value").alias("suggestion")).distinct().where(F.length("suggestion") >= least - 1).withColumn("size", F.length("suggestion"))
    cut_up = F.transform(F.sequence(F.lit(0), edits(F.col("size"))), lambda i: F.struct(i.alias("i"), _piece(F.col("suggestion"), F.col("size"), i, edits(F.col("size")) + 1).alias("piece")))
    k = k.select("suggestion", "size", F.explode(cut_up).alias("p")).select("suggestion", "size", "p.*")
    v = values.select("value").distinct().where(F.length("value") >= least)
    v = v.select("value", F.explode(F.array(*[F.length("value") + d for d in (-1, 0, 1)])).alias("size")).where(F.col("size") >= least - 1).withColumn("d", edits(F.col("size")))

    def moved(i: Column) -> Column:
        return F.transform(F.sequence(-F.col("d"), F.col("d")), lambda s: F.struct(i.alias("i"), _piece(F.col("value"), F.col("size"), i, F.col("d") + 1, s).alias("piece")))

    found = F.array_distinct(F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.col("d")), moved)), lambda p: p["piece"].isNotNull()))
    v = v.select("value", "size", F.explode(found).alias("p")).select("value", "size", "p.*")
    pairs = v.join(k, ["size", "i", "piece"]).select("value", "suggestion").distinct().withColumn("distance", F.levenshtein("value", "suggestion"))
    pairs = pairs.where((F.col("distance") > 0) & (F.col("distance") / F.greatest(F.length("value"), F.length("suggestion")) <= ratio))
    order = W.partitionBy("value").orderBy("distance", "suggestion")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= top).select("value", "suggestion", "distance", "pos")


def triage(values: DataFrame, known: DataFrame, emit_info: bool = True) -> DataFrame:
    """(value, n, level, suggestion, distance) of names that aren't known: near one is a warning, else info."""
    counted = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    unknown = counted.join(known.select("value").distinct(), "value", "left_anti")
    best = near_names(unknown, known, top=1).select("value", "suggestion", "distance")
    out = unknown.join(best, "value", "left").withColumn("level", F.when(F.col("suggestion").isNotNull(), "warning").otherwise("info"))
    out = out.select("value", "n", "level", "suggestion", "distance")
    return out if emit_info else out.where(F.col("level") == "warning")


def alias_candidates(values: DataFrame, known: DataFrame, key) -> DataFrame:
    """(value, status, candidate, auto_safe): exact, char_only (keys agree), needs_review (near), no_authority."""
    v = values.select("value").distinct().withColumn("k", key(F.col("value")))
    k = known.select("value").distinct().withColumn("k", key(F.col("value"))).groupBy("k").agg(F.min("value").alias("same_key"))
    exact = known.select(F.col("value").alias("exact")).distinct()
    joined = v.join(exact, v["value"] == exact["exact"], "left").join(k, "k", "left")
    rest = joined.where(F.col("exact").isNull() & F.col("same_key").isNull()).select("value")
    best = near_names(rest, known, top=1).select("value", "suggestion")
    out = joined.join(best, "value", "left")
    status = F.when(F.col("exact").isNotNull(), "exact").when(F.col("same_key").isNotNull(), "char_only").when(F.col("suggestion").isNotNull(), "needs_review").otherwise("no_authority")
    return out.select("value", status.alias("status"), F.coalesce("exact", "same_key", "suggestion").alias("candidate"), status.isin("exact", "char_only").alias("auto_safe"))


def validate_units(units: DataFrame, key_col: str, order_col: str, checks: dict[str, Column]) -> DataFrame:
    """(key, order, problem): each named check that holds, and keys that an earlier row has."""
    # rows without a key are spread: they are only told to be without one
    salt = F.when(F.col(key_col).isNull(), F.xxhash64(order_col))
    again = F.row_number().over(W.partitionBy(key_col, salt).orderBy(order_col)) > 1
    told = [F.when(F.col(key_col).isNull(), "missing_key"), F.when(F.col(key_col).isNotNull() & F.col("_again"), "duplicate_key")]
    told += [F.when(c, F.lit(name)) for name, c in checks.items()]
    rows = units.withColumn("_again", again)
    return rows.select(key_col, order_col, F.explode(F.array_compact(F.array(*told))).alias("problem"))


def names_in_use(candidates: DataFrame, known: DataFrame, group_col: str) -> DataFrame:
    """(group, name) of candidates that are known, without those that end another surviving one of the group."""
    kept = candidates.select(group_col, "name").distinct().join(known.select("name").distinct(), "name", "left_semi")
    other = kept.select(F.col(group_col).alias("_g"), F.col("name").alias("_o"))
    longer = (F.col(group_col) == F.col("_g")) & (F.col("_o") != F.col("name")) & F.col("_o").endswith(F.col("name"))
    return kept.join(other, longer, "left_anti")


def hint_precedence(cases: DataFrame, first: DataFrame, second: DataFrame, case_col: str, labels: tuple[str, str]) -> DataFrame:
    """(case, hints, source): a case's names from the first source, else from the second, with the source's label."""

    def gathered(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(case_col).agg(F.array_sort(F.collect_set("name")).alias(name))

    out = cases.select(case_col).distinct().join(gathered(first, "a"), case_col, "left").join(gathered(second, "b"), case_col, "left")
    empty = F.array().cast("array<string>")
    source = F.when(F.size(F.coalesce("a", empty)) > 0, labels[0]).when(F.size(F.coalesce("b", empty)) > 0, labels[1])
    return out.select(case_col, F.when(source == labels[0], F.col("a")).otherwise(F.coalesce("b", empty)).alias("hints"), source.alias("source"))
