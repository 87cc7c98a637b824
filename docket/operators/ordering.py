"""Numbering a whole table in order without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.session import cut

ROW_BITS = 33  # of monotonically_increasing_id: the row in its partition


def in_order(rows: DataFrame, *order: Column | str, pos: str = "pos", parts: int | None = None) -> DataFrame:
    """``rows`` with pos: 1, 2, ... in the given order, as a long.

    Rows are dealt by ranges and sorted in their partitions, which are written
    once, so that a second reading can't deal them differently. A partition's
    first number is the number of rows in those before it: one row a partition
    enters that sum. Rows that are equal in the order are numbered in any order;
    give enough columns. An empty table gives an empty one. ``parts`` is the number
    of ranges, else the session's.
    """
    dealt = rows.repartitionByRange(*([parts] if parts else []), *order).sortWithinPartitions(*order)
    marked = cut(dealt.withColumn("_mark", F.monotonically_increasing_id()))
    part, place = F.shiftright("_mark", ROW_BITS), F.col("_mark").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    sizes = marked.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    out = marked.join(F.broadcast(offsets), part == F.col("_part"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns if c != pos], (F.col("_before") + place + 1).alias(pos))


def in_group_order(rows: DataFrame, group: list[str], *order: Column | str, pos: str = "pos") -> DataFrame:
    """``rows`` with pos: 1, 2, ... in each group, in the given order; no group is sorted in one task. Groups aren't null."""
    placed = in_order(rows, *group, *order, pos="_place")
    first = placed.groupBy(*group).agg(F.min("_place").alias("_first"))
    kept = [F.col(f"`{c}`") for c in rows.columns if c != pos]
    return placed.join(first, group).select(*kept, (F.col("_place") - F.col("_first") + 1).alias(pos))
