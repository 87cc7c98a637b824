"""Line dedup by content-defined chunks of lines.

A line ends at a line break or at the end of a sentence, so a paragraph on one
line has several. A rolling hash is taken over each two neighbouring lines, and a
boundary lies behind them where it is divisible by ``DIVISOR``: what lies between
two boundaries is a chunk, and chunks shift with their lines, whatever stands
around them.

Rolling hashes that occur again, later by document id and place, mark repeated
lines. Where they follow one another they make up a repeated passage: the chunks
in it and what of its first and last lines lies outside them. A passage goes

- if it holds a chunk of ``LEAST_LINES`` lines or more, or
- if it has more than ``WORDS`` words, though its few lines hold no boundary; a
  line of more than ``WORDS`` words is compared by itself too.

So every repeated passage of whole lines and of over ``WORDS`` words goes whole.
Rolling hashes have 96 bits, and the bytes of all lines under one are compared by
128 bits of their SHA-256; lines that only share a hash stay. Rows go by 64 bits of
their id and text; should two rows share them, a second hash tells, and all is keyed
anew by another seed. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.columns import numbered
from docket.session import cut

LINE_END = r"(?<=\n)|(?<=[.!?] )"
MARK = "\x01"
DIVISOR = 2
LEAST_LINES = 2
WORDS = 50
SEEDS = 4


def lines_of(text: Column) -> Column:
    """The lines with what ends them: joined they are the text again.

    Ends are marked and the text is split at the marks, many times faster than
    by a pattern, which is left for texts that have the mark themselves.
    """
    marked = text
    for end in ("\n", ". ", "! ", "? "):
        marked = F.replace(marked, F.lit(end), F.lit(end + MARK))
    return F.when(text.contains(MARK), F.split(text, LINE_END)).otherwise(F.split(marked, MARK))


def _words(line: Column) -> Column:
    """Number of words, by the six ASCII blanks; a line without a word has 0."""
    return F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))


def _least_id(docs: DataFrame, id_col: str, id_type: str) -> Column:
    """An id to compare by, null the smallest."""
    if id_type in ("bigint", "int"):
        return F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    return F.struct(F.col(id_col).isNotNull(), F.col(id_col))


def line_units(hashed: DataFrame) -> DataFrame:
    """(row, id, pos, n, a, b, words, next_words): each two neighbouring lines (n = 2) and each long line (n = 1) with its hash.

    ``hashed``: (row, id, h, words), arrays of one value a line.
    """
    h, words, n = F.col("h"), F.col("words"), F.size("h")
    at = lambda c, i: F.get(c, i)

    def unit(i: Column, lines: int, *keys: Column) -> Column:
        more = at(words, i + 1) if lines == 2 else F.lit(0)
        return F.struct(i.alias("pos"), F.lit(lines).alias("n"), F.xxhash64(*keys).alias("a"), F.hash(*keys).alias("b"), at(words, i).alias("words"), more.alias("next_words"))

    pairs = F.when(n > 1, F.transform(F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0))), lambda i: unit(i, 2, at(h, i), at(h, i + 1)))).otherwise(F.array())
    long = F.filter(F.transform(words, lambda w, i: F.when(w > WORDS, unit(i, 1, at(h, i)))), lambda u: u.isNotNull())
    return hashed.select("row", "id", F.inline(F.concat(pairs, long)))


def row_key(id_: Column, text: Column, seed: int) -> Column:
    """64 bits that stand for a row; where two different rows share them another seed is taken."""
    return F.xxhash64(id_, text) if seed == 0 else F.xxhash64(F.lit(seed), id_, text)


def repeated_units(hashed: DataFrame, repeats: bool) -> DataFrame:
    """(row, pos, n, a, b, words, next_words, first) of the units that occur more than once; ``first`` is true of the one that stays.

    The smallest id keeps a unit; of several texts with that id the one with the
    smallest hash, of several places the first. Counts are summed before they are
    shuffled, and only a unit's smallest id is carried, so a unit that a third of
    all texts have is no group that anything gathers.
    """
    if repeats:
        hashed = hashed.dropDuplicates(["row"])  # rows equal in id and text are one here: each gets what is found for it
    units = line_units(hashed)
    repeated = units.groupBy("a", "b").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first_id")).where("times > 1").drop("times")
    met = units.join(repeated, ["a", "b"]).withColumn("keeps", F.col("id") == F.col("first_id")).drop("id", "first_id")
    if not hashed.groupBy("id").agg((F.min("row") < F.max("row")).alias("several")).where("several").isEmpty():
        least = met.where("keeps").groupBy("a", "b").agg(F.min("row").alias("first_row"))
        met = met.join(least, ["a", "b"]).withColumn("keeps", F.col("keeps") & (F.col("row") == F.col("first_row"))).drop("first_row")
    nth = F.row_number().over(W.partitionBy("row", "a", "b").orderBy("pos", "n"))
    return met.repartition("row").withColumn("first", F.col("keeps") & (nth == 1)).drop("keeps")


def removed_passages(marked: DataFrame, divisor: int, least: int) -> DataFrame:
    """(row, start, stop) of the repeated passages that go, from units as ``repeated_units`` gives them."""
    again = marked.where("not first")
    run = F.col("pos") - F.row_number().over(W.partitionBy("row").orderBy("pos"))
    edge = F.when(F.pmod("a", F.lit(divisor)) == 0, F.col("pos"))
    chains = again.where("n = 2").withColumn("run", run).groupBy("row", "run").agg(
        F.min("pos").alias("start"),
        (F.max("pos") + 2).alias("stop"),
        (F.sum("words") + F.max_by("next_words", "pos")).alias("words"),
        (F.max(edge) - F.min(edge)).alias("between"),
    )
    gone = chains.where((F.col("words") > WORDS) | (F.col("between") >= least)).select("row", "start", "stop")
    return gone.union(again.where("n = 1").select("row", "pos", F.col("pos") + 1))


def joined_gaps(gone: DataFrame) -> DataFrame:
    """(row, cuts): for each row the removed lines as ordered array of struct(start, stop) that neither meet nor overlap."""
    upto = F.max("stop").over(W.partitionBy("row").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    fresh = gone.withColumn("new", F.coalesce((F.col("start") > upto).cast("int"), F.lit(1)))
    group = F.sum("new").over(W.partitionBy("row").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, 0))
    merged = fresh.withColumn("group", group).groupBy("row", "group").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR, least: int = LEAST_LINES) -> DataFrame:
    """``docs`` with the text without repeated passages, and removed_lines.

    A null text stays null, an empty one empty; a text that only repeats others
    becomes empty, and its row stays. The smallest id keeps a repeated passage, at
    its first place; a null id is the smallest. Of different texts with that id,
    or without any, the one with the smallest hash keeps it. Rows equal in id
    and text stay repeated. An empty table gives an empty one. An input column
    removed_lines is replaced; others pass, whatever their names are.
    """
    docs = docs.drop("removed_lines")
    data, place = numbered(docs)
    id_col, text_col = place[id_col], place[text_col]
    for seed in range(SEEDS):
        row, check = row_key(F.col(id_col), F.col(text_col), seed), F.xxhash64(F.lit("check"), F.col(text_col), F.col(id_col))
        lines = data.where(F.col(text_col).isNotNull()).select(_least_id(data, id_col, dict(data.dtypes)[id_col]).alias("id"), row.alias("row"), check.alias("check"), lines_of(F.col(text_col)).alias("l"))
        hashed = cut(lines.select("id", "row", "check", F.transform("l", lambda u: F.xxhash64(u)).alias("h"), F.transform("l", _words).alias("words")), "zstd")
        rows = hashed.groupBy("row").agg(F.count(F.lit(1)).alias("n"), (F.min("check") < F.max("check")).alias("clash"))
        twice = rows.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.max("clash"), F.lit(False)).alias("clash")).first()
        if not twice["clash"]:
            break
    else:
        raise RuntimeError("row keys clash under every seed")
    marked = cut(repeated_units(hashed.drop("check"), twice["most"] > 1), "zstd")

    def assembled(marked: DataFrame) -> DataFrame:
        """The rows with their lines, what to compare, and what to cut."""
        gone = joined_gaps(removed_passages(marked, divisor, least))
        compare = marked.groupBy("row").agg(F.collect_list(F.struct("pos", "n", "a", "b")).alias("units"))
        both = compare.join(gone, "row", "left").withColumnRenamed("row", "of_row")
        held = data.withColumn("row", row).join(both, F.col("row") == F.col("of_row"), "left")
        return cut(held.select(*[F.col(c) for c in place.values() if c != text_col], lines_of(F.col(text_col)).alias(text_col), "units", "cuts"), "zstd")

    held = assembled(marked)
    # digests of the bytes of all that share a hash
    whole = held.where("units is not null").select(F.col(text_col).alias("l"), F.inline("units"))
    bytes_of = F.when(F.col("n") == 1, F.get("l", "pos")).otherwise(F.concat(F.get("l", "pos"), F.lit(MARK), F.get("l", F.col("pos") + 1)))
    digest = whole.select("a", "b", F.sha2(bytes_of, 256).alias("sha")).select("a", "b", F.xxhash64("sha").alias("x"), F.xxhash64("sha", F.lit(1)).alias("y"))
    unequal = digest.groupBy("a", "b").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max))]).where("lo_x < hi_x OR lo_y < hi_y").select("a", "b")
    if not unequal.isEmpty():
        held = assembled(cut(marked.join(cut(unequal), ["a", "b"], "left_anti")))
    # what lies before, between and after the cuts
    text, cuts = F.col(text_col), F.col("cuts")
    start = lambda i: F.coalesce(F.get(cuts, i)["start"], F.lit(2**30))
    stop = lambda i: F.coalesce(F.get(cuts, i - 1)["stop"], F.lit(0))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts)), lambda i: F.slice(text, stop(i) + 1, start(i) - stop(i))))
    touched = cuts.isNotNull()
    out = [(F.array_join(F.when(touched, left).otherwise(text), "") if d == text_col else F.col(d)).alias(c) for c, d in place.items()]
    gone = F.aggregate(cuts, F.lit(0), lambda n, c: n + c["stop"] - c["start"])
    return held.select(*out, F.coalesce(gone, F.lit(0)).alias("removed_lines"))
