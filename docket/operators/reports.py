"""Corpus reports, tallies, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators.ordering import in_order


def corpus_report(units: DataFrame, by: list[str]) -> DataFrame:
    """Counts by each column and in total, in one pass; ``grp`` names the grouping."""
    named = F.lit("total")
    for c in reversed(by):
        named = F.when(F.grouping(c) == 0, c).otherwise(named)
    value = F.coalesce(*[F.col(c).cast("string") for c in by])
    sets = units.groupingSets([[F.col(c)] for c in by] + [[]], *by)
    return sets.agg(named.alias("grp"), F.count(F.lit(1)).alias("n")).select("grp", value.alias("value"), "n")


def tally(rows: DataFrame, case_col: str, value_col: str, unknown: str = "unknown") -> DataFrame:
    """(case, value, n) for each case and, with a null case, over all."""
    named = rows.select(F.col(case_col), F.coalesce(value_col, F.lit(unknown)).alias(value_col))
    counted = named.groupBy(case_col, value_col).agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(value_col).agg(F.sum("n").alias("n")).select(F.lit(None).cast(dict(rows.dtypes)[case_col]).alias(case_col), value_col, "n")
    return counted.union(whole)


def quality_report(rows: DataFrame, by: str, complete: Column, bad_name: Column, points: str, bad_most: int = 5) -> DataFrame:
    """One row a group: complete, min/median/max of points, the first bad names.

    The median is element n // 2 of the sorted points. It comes from counts of
    each value, and the bad names from a top-n, so no group's rows are gathered.
    """
    of_value = rows.groupBy(by, F.col(points).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(complete).alias("_fine"))
    known = F.when(F.col("_v").isNotNull(), F.col("_n")).otherwise(0)
    upto = F.sum(known).over(W.partitionBy(by).orderBy(F.col("_v").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0))
    half = F.floor(F.sum(known).over(W.partitionBy(by)) / 2)
    hist = of_value.withColumn("_upto", upto).withColumn("_half", half)
    median = F.min(F.when(F.col("_upto") > F.col("_half"), F.col("_v")))
    told = hist.groupBy(by).agg(F.sum("_n").alias("n"), F.sum("_fine").alias("complete"), F.min("_v").alias("least"), median.alias("median"), F.max("_v").alias("most"))
    nth = F.row_number().over(W.partitionBy(by).orderBy("_name"))
    bad = rows.where(~complete).select(F.col(by).alias("_by"), bad_name.alias("_name")).withColumnRenamed("_by", by).withColumn("_nth", nth).where(F.col("_nth") <= bad_most)
    bad = bad.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list("_name")).alias("bad"))
    out = told.join(bad, told[by].eqNullSafe(bad["_by"]), "left")
    kind = dict(bad.dtypes)["bad"]
    return out.select(by, "n", "complete", "least", "median", "most", F.coalesce("bad", F.array().cast(kind)).alias("bad"))


def by_period(rows: DataFrame, period: Column, substantive: Column, indexed: list) -> DataFrame:
    """(period, n, substantive, other, indexed) a period, oldest first to read; ``indexed`` lists those that are searched."""
    out = rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.count_if(substantive).alias("substantive"))
    return out.select("period", "n", "substantive", (F.col("n") - F.col("substantive")).alias("other"), F.col("period").isin(*indexed).alias("indexed"))


def compound_cases(parts: DataFrame, case_col: str, clause: str, result: str) -> DataFrame:
    """(case, clauses, results) of cases with more than one clause or more than one result."""
    out = parts.groupBy(case_col).agg(F.array_sort(F.collect_set(clause)).alias("clauses"), F.array_sort(F.collect_set(result)).alias("results"))
    return out.where((F.size("clauses") > 1) | (F.size("results") > 1))


def with_total(rows: DataFrame, by: str, aggs: list[Column]) -> DataFrame:
    """Aggregates by a column with a total row, by rollup."""
    return rows.rollup(by).agg(*aggs)


def newest_first(rows: DataFrame, time_col: str, id_col: str) -> DataFrame:
    """``rows`` with pos: newest first, nulls as the oldest, ids break ties."""
    return in_order(rows, F.col(time_col).desc_nulls_last(), F.col(id_col))


def first_seen(rows: DataFrame, key: str, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Distinct keys in first-seen order."""
    one = rows.groupBy(*(by or []), key).agg(F.min(F.struct(*order)).alias("_at"))
    if not by:
        return in_order(one, F.col("_at"), F.col(key)).drop("_at")
    return one.select(*by, key, F.row_number().over(W.partitionBy(*by).orderBy("_at", key)).alias("pos"))


def side_verdict(rows: DataFrame, case_col: str, kind_col: str, kinds: list[str], low: Column) -> DataFrame:
    """Counts of each kind, of low ones, and a verdict by precedence."""
    out = rows.groupBy(case_col).agg(*[F.count_if(F.col(kind_col) == k).alias(k) for k in kinds], F.count_if(low).alias("low"))
    a, b = kinds[:2]
    verdict = F.when(F.col(a) == 0, f"no {a}").when(F.col(b) == 0, f"no {b}").when(F.col("low") > 0, "check").otherwise("ok")
    return out.withColumn("verdict", verdict)


def frequency(rows: DataFrame, col: str) -> DataFrame:
    """(value, n, pos): most common first."""
    out = rows.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return in_order(out, F.desc("n"), F.col("value"))
