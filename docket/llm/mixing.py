"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 60-bit hash of its id. A source's target fixes how often
all its documents are taken whole (``base_copies``) and how many further words
remain as a budget; the budget becomes one hash threshold of the source: a
document is taken once more if its hash is at or under it. The threshold comes
from sums of sizes by (source, hash bucket): the bucket in which the budget
runs out is refined by its next bits only, twice, so no sort of documents is
needed and the decision is a filter. Everything is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.columns import numbered
from docket.session import cut

WORDS = r"[^\x20\x09-\x0D]+"
LEVEL_BITS = (12, 12, 36)


def word_count(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def id_hash(key: Column) -> Column:
    """The first 60 bits of the MD5 of the id's text; null counts as an own id."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Targets from (source, source_size): share of all sizes by weight, capped.

    Sources by code point, null last, take the weights in turn. A target stops
    at ``cap`` times its source's size; what is over goes to the others by
    weight until none is above. With sources sorted by cap/weight the level at
    which the water stands is the first (rest of total)/(rest of weights) that
    the source's own cap doesn't undercut. One row per source enters.
    """
    whole = W.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rn", F.row_number().over(whole))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(cap)))
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = W.orderBy("ratio", "rn")
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    ranked = ranked.withColumn("level", level)
    own = F.when(F.col("ratio") >= F.col("level"), F.struct(F.col("ratio"), F.col("rn"), F.col("level")))
    first = F.min(own).over(W.partitionBy())["level"]
    return ranked.withColumn("at", first).select("source", "source_size", F.when(F.col("at").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("at") * F.col("weight"))).alias("target"))


def source_thresholds(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, base_copies, threshold) of ``sized`` (source, size, h).

    ``threshold`` is the largest hash that is taken once more, -1 for none. The
    hash at which the budget runs out is taken if that ends nearer the budget.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    plan = targets.withColumn("base_copies", whole)
    plan = plan.withColumn("left", F.col("target") - F.col("base_copies") * F.col("source_size"))
    state, used = plan.select(F.col("source").alias("s"), F.col("left"), F.lit(0).cast("long").alias("prefix")), 0
    for bits in LEVEL_BITS:
        rest = 60 - used - bits
        rows = sized.select("source", "size", F.shiftright("h", 60 - used).alias("head"), F.shiftright("h", rest).alias("bucket"))
        # the first level's prefix is 0 for all rows; later only the boundary bucket passes the join
        rows = rows.join(state, F.col("source").eqNullSafe(F.col("s")) & (F.col("head") == F.col("prefix")), "inner")
        hist = rows.groupBy("s", "left", "bucket").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
        hist = hist.withColumn("upto", upto).withColumn("under", F.col("upto") - F.col("n"))
        edge = hist.where((F.col("under") <= F.col("left")) & (F.col("left") < F.col("upto")))
        used += bits
        if used < 60:
            state = edge.select("s", (F.col("left") - F.col("under")).alias("left"), F.col("bucket").alias("prefix"))
        else:
            nearer = F.col("upto") + F.col("under") <= 2 * F.col("left")
            state = edge.select("s", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("threshold"))
    joined = plan.join(state, F.col("source").eqNullSafe(F.col("s")), "left")
    return joined.select("source", "source_size", "target", "base_copies", F.coalesce("threshold", F.lit(-1)).cast("long").alias("threshold"))


NEW = ["mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken"]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``docs`` with mix_size, mix_source_size, mix_target, mix_copies, mix_taken.

    ``mix_copies`` is how often the mix takes the document, ``mix_taken`` its
    words times that. Null text has size 0. A null source is a source of its
    own, sorted last; a null id is an id of its own. Rows that share an id share
    its hash and are decided alike. A source without words has target 0. An
    empty table gives an empty table. Input columns named like the new ones are
    replaced; others pass unchanged, whatever their names are.
    """
    data, place = numbered(docs)
    out = _mixed(data, place[id_col], place[text_col], place[source_col], weights, share, cap)
    return out.select(*[F.col(d).alias(c) for c, d in place.items() if c not in NEW], *NEW)


def _mixed(data: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """``data`` with the new columns; its own are named d0, d1, ..."""
    keyed = cut(data.select(F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), id_hash(F.col(id_col)).alias("h")))
    sums = cut(keyed.groupBy("source").agg(F.sum("size").alias("source_size")).coalesce(1))
    plan = cut(source_thresholds(keyed, source_targets(sums, weights, share, cap)).coalesce(1))
    plan = plan.select(F.col("source").alias("mix_s"), F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), "base_copies", "threshold")
    out = data.withColumn("mix_size", word_count(F.col(text_col)))
    out = out.join(plan, F.col(source_col).eqNullSafe(F.col("mix_s")), "left")
    copies = F.col("base_copies") + (id_hash(F.col(id_col)) <= F.col("threshold")).cast("int")
    out = out.withColumn("mix_copies", copies).withColumn("mix_taken", F.col("mix_size") * F.col("mix_copies"))
    return out.select(*data.columns, *NEW)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: each document as often as it is taken, in the columns of ``docs``."""
    data, place = numbered(docs)
    out = _mixed(data, place[id_col], place[text_col], place[source_col], weights, share, cap)
    times = F.when(F.col("mix_copies") > 0, F.sequence(F.lit(1), F.col("mix_copies"))).otherwise(F.array().cast("array<int>"))
    return out.select(*place.values(), F.explode(times)).select(*[F.col(d).alias(c) for c, d in place.items()])
