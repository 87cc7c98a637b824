"""Claim pairing and evidence linking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators.ordering import in_group_order, in_order
from docket.session import cut

GRAM = 16


def squashed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def containing(needles: DataFrame, hays: DataFrame, needle: str, hay: str, on: list[str] | None = None, gram: int = GRAM) -> DataFrame:
    """Rows of ``needles`` joined to the rows of ``hays`` whose text contains theirs.

    With keys in ``on`` it is an equi-join and a test. Without, a haystack is cut
    into blocks of g characters side by side and a needle into all its
    overlapping pieces of g: a needle of 2g - 1 characters or more has a whole
    block wherever it lies, so no pair is missed, and a haystack gives one row
    for g characters. Found pairs are tested. g is ``gram``, or less for needles
    too short for it; there is one pass of blocks for each g in use.
    """
    if on:
        return needles.join(hays, on).where(F.col(hay).contains(F.col(needle)))
    wanted = needles.where(F.length(needle) > 0).withColumn("_g", F.least(F.lit(gram), F.floor((F.length(needle) + 1) / 2).cast("int")))
    sizes = sorted(r[0] for r in wanted.select("_g").distinct().collect())
    if not sizes:
        return needles.join(hays, F.lit(False))
    keyed = hays.withColumn("_row", F.xxhash64(hay))  # equal texts share it, and are found together
    pick = lambda col, g, pattern, group: F.when(F.col("_g") == g, F.regexp_extract_all(F.col(col), F.lit(pattern), F.lit(group)))
    pieces = F.coalesce(*[pick(needle, g, f"(?s)(?=(.{{{g}}}))", 1) for g in sizes])
    asked = wanted.select(F.col(needle).alias("_n"), F.explode(F.array_distinct(pieces)).alias("_p")).distinct()
    blocks = [keyed.select("_row", F.explode(F.array_distinct(F.regexp_extract_all(F.col(hay), F.lit(f"(?s).{{{g}}}"), F.lit(0)))).alias("_p")) for g in sizes]
    found = blocks[0]
    for more in blocks[1:]:
        found = found.union(more)
    pairs = found.join(asked, "_p").select("_row", "_n").distinct()
    near = wanted.drop("_g").join(pairs, F.col(needle) == F.col("_n")).join(keyed, "_row")
    return near.where(F.col(hay).contains(F.col(needle))).drop("_n", "_row")


def match_one_to_one(proposals: DataFrame, left_ids: DataFrame, right_ids: DataFrame, case_col: str) -> DataFrame:
    """(case, pos, left_id, right_id, status, pair_no): proposals in order, accepted one-to-one.

    A proposal with an id that its case doesn't have is ``unknown id``, one with
    an id of an accepted pair ``not one-to-one``. Partitions are sorted and walked
    once; of the case at hand only the ids of its accepted pairs are held.
    """
    known = proposals.join(left_ids.select(case_col, "left_id").distinct().withColumn("_l", F.lit(True)), [case_col, "left_id"], "left")
    known = known.join(right_ids.select(case_col, "right_id").distinct().withColumn("_r", F.lit(True)), [case_col, "right_id"], "left")
    known = known.withColumn("known", F.col("_l").isNotNull() & F.col("_r").isNotNull())
    kinds = dict(known.dtypes)

    columns = [case_col, "pos", "left_id", "right_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, left, right = None, set(), set()
        for g in batches:
            status, number = [], []
            for case, a, b, ok in zip(g[case_col], g["left_id"], g["right_id"], g["known"], strict=True):
                if case != here:
                    here, left, right = case, set(), set()
                taken = a in left or b in right
                status.append("unknown id" if not ok else "not one-to-one" if taken else "accepted")
                if status[-1] == "accepted":
                    left.add(a)
                    right.add(b)
                number.append(len(left) if status[-1] == "accepted" else None)
            yield g[columns].assign(status=status, pair_no=pd.array(number, dtype="Int32"))

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns) + ", status string, pair_no int"
    dealt = known.repartition(case_col).sortWithinPartitions(*columns)
    return dealt.select(*columns, "known").mapInPandas(run, schema)


def match_in_rounds(proposals: DataFrame, left_ids: DataFrame, right_ids: DataFrame, case_col: str) -> DataFrame:
    """``match_one_to_one`` by rounds of joins, for cases too large for one task.

    A proposal that comes before all others of its left id and of its right id is
    accepted whatever the rest: no earlier one can take either. The others of
    accepted ids drop out and the next round begins, until none is left, which
    gives the same pairs as taking proposals in order. Rounds are as many as the
    longest chain of proposals that wait for one another. Repeated proposals
    count once each; rows without a case are left out.
    """
    ids = lambda df, c: df.select(case_col, c).distinct()
    rows = proposals.select(case_col, "pos", "left_id", "right_id").where(F.col(case_col).isNotNull())
    known = rows.join(ids(left_ids, "left_id").withColumn("_l", F.lit(True)), [case_col, "left_id"], "left").join(ids(right_ids, "right_id").withColumn("_r", F.lit(True)), [case_col, "right_id"], "left")
    placed = cut(in_order(known.withColumn("known", F.col("_l").isNotNull() & F.col("_r").isNotNull()), case_col, "pos", "left_id", "right_id", pos="_n"))
    left = placed.where("known").select(case_col, "left_id", "right_id", "_n")
    accepted: DataFrame | None = None
    while not left.isEmpty():
        first = [left.groupBy(case_col, c).agg(F.min("_n").alias("_n")) for c in ("left_id", "right_id")]
        won = cut(left.join(first[0], [case_col, "left_id", "_n"], "left_semi").join(first[1], [case_col, "right_id", "_n"], "left_semi"))
        left = cut(left.join(won.select(case_col, "left_id"), [case_col, "left_id"], "left_anti").join(won.select(case_col, "right_id"), [case_col, "right_id"], "left_anti"))
        accepted = won if accepted is None else accepted.unionByName(won)
    if accepted is None:
        numbered = placed.select(case_col, "_n", F.lit(1).alias("pair_no")).where("false")
    else:
        numbered = in_group_order(accepted.select(case_col, "_n"), [case_col], "_n", pos="pair_no")
    out = placed.join(numbered.select("_n", F.col("pair_no").cast("int").alias("pair_no")), "_n", "left")
    status = F.when(~F.col("known"), "unknown id").when(F.col("pair_no").isNull(), "not one-to-one").otherwise("accepted")
    return out.select(case_col, "pos", "left_id", "right_id", status.alias("status"), "pair_no")


#: Pieces that one automaton holds at most, and their characters.
MOST_PIECES, MOST_CHARS = 50_000, 8_000_000


def scan_for(texts: DataFrame, key: str, wanted: dict[str, DataFrame]) -> DataFrame | None:
    """(key, kind, piece) for every piece found in a text, all kinds in one scan; None if there are too many pieces.

    ``wanted``: for each kind, which is a text column of ``texts``, its pieces
    (piece). They are counted first; within MOST_PIECES and MOST_CHARS an automaton
    for each kind goes to the tasks, and each text runs through it once.
    """
    pieces = {kind: df.select("piece").where(F.length("piece") > 0).distinct() for kind, df in wanted.items()}
    held: dict[str, list[str]] = {}
    for kind, df in pieces.items():
        size = df.limit(MOST_PIECES + 1).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("piece")), F.lit(0)).alias("chars")).first()
        if size["n"] > MOST_PIECES or size["chars"] > MOST_CHARS:
            return None
        held[kind] = [r["piece"] for r in df.collect()]
    kinds = dict(texts.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automata = {}
        for kind, some in held.items():
            automata[kind] = ahocorasick.Automaton()
            for piece in some:
                automata[kind].add_word(piece, piece)
            automata[kind].make_automaton()
        for batch in batches:
            rows = []
            for kind, some in held.items():
                if some:
                    for at, text in zip(batch[key], batch[kind], strict=True):
                        rows += [(at, kind, piece) for piece in {found for _, found in automata[kind].iter(text or "")}]
            yield pd.DataFrame(rows, columns=[key, "kind", "piece"])

    return texts.select(key, *held).mapInPandas(run, f"{key} {kinds[key]}, kind string, piece string")


def unpaired(claims: DataFrame, pairs: DataFrame, on: list[str]) -> DataFrame:
    """Claims that no accepted pair has."""
    return claims.join(pairs, on, "left_anti")


def locate_quotes(quotes: DataFrame, units: DataFrame, quote: str, unit: str, quote_id: str, unit_id: str, order: str, on: list[str] | None = None, size: int = 20, least: int = 8) -> DataFrame:
    """(quote_id, unit_id): first unit that has the quote's first ``size`` non-blank characters, else null."""
    q = quotes.select(*(on or []), quote_id, F.left(squashed(F.col(quote)), F.lit(size)).alias("_q"))
    u = units.select(*(on or []), unit_id, F.col(order).alias("_o"), squashed(F.col(unit)).alias("_u"))
    found = containing(q.where(F.length("_q") >= least), u, "_q", "_u", on)
    first = found.groupBy(quote_id).agg(F.min_by(unit_id, F.struct("_o", unit_id)).alias(unit_id))
    return quotes.select(quote_id).join(first, quote_id, "left")


def attach_issues(claims: DataFrame, issues: DataFrame, claim_id: str, sides: list[str], issue_id: str, on: list[str]) -> DataFrame:
    """``claims`` with the issue whose side names them."""
    long = issues.select(*on, issue_id, F.explode(F.array(*[F.col(s) for s in sides])).alias(claim_id)).where(F.col(claim_id).isNotNull())
    return claims.join(long, [*on, claim_id], "left")


def selected_sources(hits: DataFrame, claims: DataFrame, case_col: str, claim_col: str, most: int = 400) -> tuple[DataFrame, DataFrame]:
    """(sources, claims without a source). Selected hits, one row a key, first seen first, with the sides that have it."""
    rows = hits.where("selected")
    first = rows.groupBy(case_col, "ref_key").agg(F.min(F.struct("pos", claim_col)).alias("seen"), F.array_sort(F.collect_set("side")).alias("sides"), F.left(F.min_by("text", F.struct("pos", claim_col)), F.lit(most)).alias("text"))
    numbered = first.withColumn("source_no", F.row_number().over(W.partitionBy(case_col).orderBy("seen", "ref_key"))).drop("seen")
    return numbered, claims.join(rows, [case_col, claim_col], "left_anti")


def plain_name(c: Column, label: str) -> Column:
    """Without blanks, colons and a leading label."""
    return F.regexp_replace(F.regexp_replace(c, r"[\s:：]+", ""), f"^(?:{label})", "")


def party_match(cases: DataFrame, names: DataFrame, on: list[str], respondent: str, label: str) -> DataFrame:
    """``cases`` with status: no_match if a row of ``names`` (on..., name) has the respondent's plain name, need_human if none, unclear without one.

    Names meet by key and plain name, so a group of any size costs one row a name.
    """
    known = names.select(*on, plain_name(F.col("name"), label).alias("_p")).distinct().withColumn("_same", F.lit(True))
    out = cases.withColumn("_p", plain_name(F.col(respondent), label)).join(known, [*on, "_p"], "left")
    status = F.when(F.col(respondent).isNull() | (F.trim(respondent) == ""), "unclear").when(F.col("_same"), "no_match").otherwise("need_human")
    return out.select(*[F.col(c) for c in cases.columns], status.alias("status"))


def overlay(results: DataFrame, advice: DataFrame, on: list[str]) -> DataFrame:
    """Model advice (verdict, quote) over rule results (status).

    An unknown verdict is suspicious; suspicious without a quote is insufficient.
    It may only move an open result to need_human, never a settled one.
    """
    out = results.join(advice, on, "left")
    verdict = F.when(F.col("verdict").isNull(), None).when(~F.col("verdict").isin("clear", "suspicious", "insufficient"), "suspicious").otherwise(F.col("verdict"))
    final = F.when((verdict == "suspicious") & (F.trim(F.coalesce("quote", F.lit(""))) == ""), "insufficient").otherwise(verdict)
    settled = F.col("status").isin("triggered", "no_match", "not_applicable")
    return out.select(*results.columns, final.alias("ai_verdict"), F.when((final == "suspicious") & ~settled, "need_human").otherwise(F.col("status")).alias("final_status"))


def coverage(results: DataFrame, notes: DataFrame, case_col: str, code_col: str) -> DataFrame:
    """(case, total, explained, missing): results with and without a note."""
    out = results.join(notes.select(case_col, code_col).distinct().withColumn("_has", F.lit(True)), [case_col, code_col], "left")
    return out.groupBy(case_col).agg(F.count(F.lit(1)).alias("total"), F.count("_has").alias("explained"), F.array_sort(F.collect_list(F.when(F.col("_has").isNull(), F.col(code_col)))).alias("missing"))


def completed_sections(claims: DataFrame, sections: DataFrame, case_col: str, order: str, placeholder: str) -> DataFrame:
    """A section for every claim in claim order, renumbered; a placeholder where none was drafted."""
    out = claims.join(sections.select(case_col, "claim_id", F.col("text").alias("drafted")), [case_col, "claim_id"], "left")
    number = F.row_number().over(W.partitionBy(case_col).orderBy(order, "claim_id"))
    return out.select(case_col, "claim_id", number.alias("no"), F.coalesce("drafted", F.lit(placeholder)).alias("text"), F.col("drafted").isNull().alias("is_placeholder"))


def prefixed(first: DataFrame, later: DataFrame, case_col: str) -> DataFrame:
    """Rule-made sections first, the others renumbered after them."""
    both = first.withColumn("_part", F.lit(0)).unionByName(later.withColumn("_part", F.lit(1)))
    number = F.row_number().over(W.partitionBy(case_col).orderBy("_part", "no"))
    return both.withColumn("new_no", number).drop("_part")
