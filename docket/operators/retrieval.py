"""Retrieval for many queries at once: BM25, cosine, fusion, selection.

Hits are (query_id, ref_key, score); k, weights and thresholds are parameters.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators import blockmax
from docket.operators.canonical import bounded
from docket.operators.scoring import best_hits
from docket.operators.vectors import comparable, cosine_inside, unit
from docket.session import cut, ship_package

K1, B = 1.2, 0.75
MIN_VECTOR, MIN_LEXICAL = 0.60, 0.35
STRONG_VECTOR, STRONG_NORM, STRONG_LEXICAL = 0.70, 0.999, 15.0
PER_RANK = 2
LOWEST_RANK = 4
AUTO_RANKS = (1, 2, 3)
TASK_DOCS = 4000


def words(text: Column) -> Column:
    """Lower-cased words."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def bigrams(text: Column) -> Column:
    """Overlapping pairs of the characters of each run of CJK text; a run of one stays one."""
    runs = F.regexp_extract_all(text, F.lit(r"\p{IsHan}+"), F.lit(0))
    cut = F.transform(runs, lambda t: F.when(F.length(t) < 2, F.array(t)).otherwise(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, 2))))
    return F.flatten(cut)


def postings(docs: DataFrame, id_col: str = "ref_key", text_col: str = "text", tokens=words) -> DataFrame:
    """(id, term, tf, dl)."""
    long = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("t"))
    long = long.select(id_col, F.size("t").alias("dl"), F.explode("t").alias("term"))
    return long.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def top_k(hits: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The best k of each query, ties by ref_key."""
    order = W.partitionBy("query_id").orderBy(F.desc(by), "ref_key")
    return hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=words, k1: float = K1, b: float = B, decimals: int = 6, inside: tuple[str, DataFrame] | None = None) -> DataFrame:
    """(query_id, ref_key, score, pos) of Okapi BM25 over docs (ref_key, text) and queries (query_id, text).

    ``inside`` = (column of docs, rows of query_id and that column) ranks for a
    query only documents with one of its values; statistics cover all documents. The
    value is part of the join, so a posting meets only queries that may have it.

    Documents are tokenised once, into one row a document with its terms that some
    query has. Scores are summed where that row lies (``scoring.best_hits``): no posting
    is shuffled or sorted, and only each task's best k a query leave it.
    """
    asked = asked_terms(queries, tokens)
    post = asked_postings(docs, asked, tokens, [inside[0]] if inside else [])
    return ranked(post, asked, k, k1, b, decimals, inside)


def asked_terms(queries: DataFrame, tokens=words) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def asked_postings(docs: DataFrame, asked: DataFrame, tokens=words, extra: list[str] | None = None) -> DataFrame:
    """(ref_key, extra..., n, dl, found): one row a document, n its rows in ``docs`` and found its terms in ``asked`` with their tf."""
    extra = extra or []
    terms = bounded(asked.select("term").distinct().withColumn("asked", F.lit(True)))
    none = F.array(F.lit(None).cast("string"))
    # a task counts the words of TASK_DOCS documents, wherever they were stored, and its postings stay there
    dealt = docs.select("ref_key", *extra, "text").repartition(max(1, -(-docs.count() // TASK_DOCS)), "ref_key")
    long = dealt.select("ref_key", *extra, tokens(F.col("text")).alias("t"))
    long = long.select("ref_key", *extra, F.size("t").alias("dl"), F.explode(F.coalesce(F.concat(none, "t"), none)).alias("term"))
    long = long.join(terms, "term", "left").where(F.col("asked") | F.col("term").isNull())
    counted = long.groupBy("ref_key", *extra, "term").agg(F.count(F.lit(1)).cast("int").alias("tf"), F.first("dl").alias("dl"))
    term = F.when(F.col("term").isNotNull(), F.struct("term", "tf"))
    n = F.max(F.when(F.col("term").isNull(), F.col("tf")))
    rows = counted.groupBy("ref_key", *extra).agg(n.alias("n"), F.first("dl").alias("dl"), F.collect_list(term).alias("found"))
    return cut(rows.sortWithinPartitions(*extra) if extra else rows)


def ranked(post: DataFrame, asked: DataFrame, k: int, k1: float = K1, b: float = B, decimals: int = 6, inside: tuple[str, DataFrame] | None = None) -> DataFrame:
    """The best k of each query over ``asked_postings``; ``inside`` as in bm25, its column one of theirs."""
    n, avgdl = post.agg(F.coalesce(F.sum("n"), F.lit(0)), F.avg("dl")).first()
    value = [F.col(inside[0]).alias("value")] if inside else []
    # a document's row opens where it lies
    here = post.select("ref_key", "dl", *value, F.explode("found").alias("t")).select("ref_key", "t.term", "t.tf", "dl", *(["value"] if inside else []))
    df = here.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df, "term").select("query_id", "term", idf.alias("idf"))
    unit = [*(["value"] if inside else []), "ref_key"]
    allowed = inside[1].select("query_id", F.col(inside[0]).alias("value")) if inside else None
    return top_k(best_hits(here, weights, k, float(avgdl or 1.0), k1, b, decimals, unit, allowed), k)


def bm25_of_many(docs: DataFrame, queries: DataFrame, k: int = 10, tokens=words) -> DataFrame:
    """``bm25`` for a table of queries that grows with the documents: (query_id, ref_key, score, pos).

    Keys and query ids are whole numbers; rows without one only count in the statistics.
    Documents are lists of hashed terms and are asked by blocks that can still reach a
    query's k-th best (``blockmax``), which leaves out most products but no hit. Terms are
    compared by 64-bit hashes.
    """
    lists = cut(hashed_postings(docs, tokens), "zstd")
    stats = lists.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows, n, texts, total = lists.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "texts", "total")]).first()
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.explode(F.transform(F.array_distinct(tokens(F.col("text"))), lambda w: F.xxhash64(w))).alias("term"))
    asked = asked.groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    known = lists.where("id is not null").select("id", "words", "terms", "counts")
    found = blockmax.search(known, rows, cut(blockmax.weighted(asked, stats, n), "zstd"), (total / texts if texts else 0.0) or 1.0, k, zeros=True)
    kinds = dict(docs.dtypes) | dict(queries.dtypes)
    return found.select(F.col("query_id").cast(kinds["query_id"]), F.col("doc_id").cast(kinds["ref_key"]).alias("ref_key"), "score", F.col("rank").alias("pos"))


def hashed_postings(docs: DataFrame, tokens=words) -> DataFrame:
    """(id, words, terms, counts, n, texts, total): one row a key, its terms by hash with their tf; n rows in ``docs``, of which ``texts`` have ``total`` words."""
    ship_package(docs.sparkSession)
    # a task counts the words of TASK_DOCS documents, wherever they were stored
    dealt = docs.select(F.col("ref_key").cast("long").alias("id"), "text").repartition(max(1, -(-docs.count() // TASK_DOCS)), "id")
    hashed = dealt.select("id", F.transform(tokens(F.col("text")), lambda w: F.xxhash64(w)).alias("t"))
    return hashed.mapInArrow(_counted, "id long, words long, terms array<long>, counts array<int>, n long, texts long, total long")


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows by key: keys are equal within a task only."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    rows = pa.Table.from_batches(held).combine_chunks()
    ids, lists = rows.column("id").combine_chunks(), rows.column("t").combine_chunks()
    names = ids.dictionary_encode("encode")
    doc, n_docs = names.indices.to_numpy(), len(names.dictionary)
    size = lists.value_lengths().fill_null(0).to_numpy()
    text = lists.is_valid().to_numpy(zero_copy_only=False)
    vocabulary, code = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    # one number a document and term, so that one sort counts them
    both, tf = np.unique(np.repeat(doc.astype(np.int64), size) * len(vocabulary) + code, return_counts=True)
    of = both // max(1, len(vocabulary))
    offsets = pa.array(np.searchsorted(of, np.arange(n_docs + 1)), pa.int32())
    terms = pa.ListArray.from_arrays(offsets, pa.array(vocabulary[both % max(1, len(vocabulary))], pa.int64()))
    counts = pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int32()))
    # a key's length is that of its first text
    words = np.zeros(n_docs, np.int64)
    words[doc[text][::-1]] = size[text][::-1]
    sums = [np.bincount(doc, weights, n_docs).astype(np.int64) for weights in (None, text, size)]
    for at in range(0, n_docs, 1000):
        columns = [names.dictionary, pa.array(words), terms, counts, *map(pa.array, sums)]
        yield pa.RecordBatch.from_arrays([c.slice(at, 1000) for c in columns], names=["id", "words", "terms", "counts", "n", "texts", "total"])


def cosine(units: DataFrame, queries: DataFrame, k: int = 10, decimals: int = 6, block_bytes: int = 64 << 20, skip_self: bool = False) -> DataFrame:
    """(query_id, ref_key, score, pos): exact cosine of every unit with every query.

    Queries (query_id, vector) go to the tasks in blocks of at most about
    ``block_bytes``, by length of the vector; for each block units are read once,
    multiplied with it as matrices, and only a batch's best k a query leave it.
    With several blocks each one's hits are written before the next is fetched,
    so the driver holds one block at a time. ``skip_self`` leaves out a unit whose
    key is the query's id. Vectors that are null, zero, hold a null or non-finite
    component or have another length than the query take no part. Filter units
    before, then only those are scored. For searches again and again over the same
    units see ``vectors.write_cells``.
    """
    q = queries.where(comparable(F.col("vector"))).select("query_id", F.size("vector").alias("dim"), unit(F.col("vector")).alias("vector"))
    u = units.where(comparable(F.col("vector"))).select("ref_key", F.col("vector").cast("array<double>").alias("vector"))
    sizes = [(r["dim"], max(1, -(-r["dim"] * r["count"] * 8 // block_bytes))) for r in q.groupBy("dim").count().orderBy("dim").collect()]  # one row a length
    kinds = dict(q.dtypes) | dict(u.dtypes)
    schema = f"query_id {kinds['query_id']}, ref_key {kinds['ref_key']}, score double"
    alone = sum(blocks for _, blocks in sizes) == 1
    out = None
    for dim, blocks in sizes:
        for block in range(blocks):
            part = q.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).collect()
            if not part:
                continue
            found = _matrix_hits(u.where(F.size("vector") == dim), [r["query_id"] for r in part], [r["vector"] for r in part], k, decimals, skip_self, schema)
            found = found if alone else cut(found)
            out = found if out is None else out.union(found)
    return top_k(units.sparkSession.createDataFrame([], schema) if out is None else out, k)


def _matrix_hits(units: DataFrame, ids: list, vectors: list, k: int, decimals: int, skip_self: bool, schema: str) -> DataFrame:
    """Each batch's best k units for each query of a block."""
    who = np.array(ids, dtype=object)
    ask = np.array(vectors, dtype=np.float64)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values("ref_key", kind="stable")
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                x = np.array(part["vector"].tolist())
                score = np.round((ask @ x.T) / np.linalg.norm(x, axis=1), decimals)
                if skip_self:
                    score[who[:, None] == part["ref_key"].to_numpy(dtype=object)[None, :]] = -np.inf
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]  # ties to smaller keys
                found = np.take_along_axis(score, best, axis=1).ravel()
                rows = pd.DataFrame({"query_id": np.repeat(who, best.shape[1]), "ref_key": part["ref_key"].to_numpy()[best.ravel()], "score": found})
                yield rows[found > -np.inf]

    return units.mapInPandas(run, schema)


def min_max(hits: DataFrame, by: str = "score") -> DataFrame:
    """``hits`` with norm in its query; all equal, or one row, is 1."""
    over = W.partitionBy("query_id")
    lo, hi = F.min(by).over(over), F.max(by).over(over)
    return hits.withColumn("norm", F.when(hi == lo, F.lit(1.0)).otherwise((F.col(by) - lo) / (hi - lo)))


def merged(lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer merge: (query_id, ref_key, bm25_raw, bm25_norm, vec_raw, vec_norm, in_lexical, in_vector)."""
    a = min_max(lexical).select("query_id", "ref_key", F.col("score").alias("bm25_raw"), F.col("norm").alias("bm25_norm"), F.lit(True).alias("in_lexical"))
    v = min_max(vector).select("query_id", "ref_key", F.col("score").alias("vec_raw"), F.col("norm").alias("vec_norm"), F.lit(True).alias("in_vector"))
    out = a.join(v, ["query_id", "ref_key"], "full")
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("bm25_raw", "bm25_norm", "vec_raw", "vec_norm")]
    return out.select("query_id", "ref_key", *zero, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("in_lexical", "in_vector")])


def fuse(lexical: DataFrame, vector: DataFrame, weight: float = 0.5, min_vector: float = MIN_VECTOR, min_lexical: float = MIN_LEXICAL, keep_all: bool = False) -> DataFrame:
    """Weighted fusion; a row stays if its raw cosine or its lexical norm reaches its threshold."""
    rows = merged(lexical, vector)
    by_vector, by_lexical = F.col("vec_raw") >= min_vector, F.col("in_lexical") & (F.col("bm25_norm") >= min_lexical)
    side = F.when(F.col("in_lexical") & F.col("in_vector"), "both").when(F.col("in_lexical"), "lexical").otherwise("vector")
    rows = rows.select(
        "*",
        F.round(weight * F.col("bm25_norm") + (1 - weight) * F.col("vec_norm"), 4).alias("score"),
        side.alias("side"),
        F.array_compact(F.array(F.when(by_vector, "vector"), F.when(by_lexical, "lexical"))).alias("passed"),
    )
    return rows if keep_all else rows.where(F.size("passed") > 0)


def fusion_report(lexical: DataFrame, vector: DataFrame, **options) -> DataFrame:
    """One row a query: raw ranges of each side, candidates, kept, dropped."""
    rows = fuse(lexical, vector, keep_all=True, **options)

    def of(side: str, col: str) -> list[Column]:
        x = F.when(F.col(f"in_{side}"), F.col(col))
        return [F.min(x).alias(f"{side}_min"), F.max(x).alias(f"{side}_max")]

    kept = F.count_if(F.size("passed") > 0)
    return rows.groupBy("query_id").agg(*of("lexical", "bm25_raw"), *of("vector", "vec_raw"), F.count(F.lit(1)).alias("candidates"), kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped"))


def hybrid(docs: DataFrame, queries: DataFrame, units: DataFrame, vectors: DataFrame, k: int = 8, weight: float = 0.5, inside: tuple[str, DataFrame] | None = None, **options) -> DataFrame:
    """BM25 and cosine with 2k each, fused, the best k; ``inside`` as in bm25, also a column of units."""
    lexical = bm25(docs, queries, 2 * k, inside=inside)
    near = cosine_inside(units, vectors, inside, 2 * k) if inside else cosine(units, vectors, 2 * k)
    return top_k(fuse(lexical, near, weight, **options), k)


def two_pass(docs: DataFrame, queries: DataFrame, units: DataFrame, vectors: DataFrame, inside: tuple[str, DataFrame], k: int = 8, k_inside: int = 5, **options) -> DataFrame:
    """Hybrid hits over the whole corpus, and more inside each query's values, with scope.

    A key of both passes keeps the first one's row. Documents are tokenised once for
    both, and values filter before scores are summed, so the second pass costs what
    lies inside them.
    """
    asked = asked_terms(queries)
    post = asked_postings(docs, asked, extra=[inside[0]])
    first = cut(top_k(fuse(ranked(post, asked, 2 * k), cosine(units, vectors, 2 * k), **options), k))
    second = top_k(fuse(ranked(post, asked, 2 * k_inside, inside=inside), cosine_inside(units, vectors, inside, 2 * k_inside), **options), k_inside)
    extra = second.join(first.select("query_id", "ref_key"), ["query_id", "ref_key"], "left_anti")
    return first.withColumn("scope", F.lit("corpus")).unionByName(extra.withColumn("scope", F.lit("hinted")))


def interleave(hits: DataFrame) -> DataFrame:
    """``hits`` with fused_pos and placed_by: two queues of a query's rows take turns.

    One queue has rows with a cosine, best first, the other rows with a lexical
    norm. The vector queue begins. A key already taken is skipped and the turn
    stays; an empty queue leaves its turn to the other; rows in neither queue
    come last. A query's rows are bounded by its two searches' k.
    """
    small = hits.select("query_id", "ref_key", "vec_raw", "bm25_norm")

    def run(keys: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("ref_key")
        queues = {"vector": list(g[g.vec_raw > 0].sort_values("vec_raw", ascending=False, kind="stable").ref_key), "lexical": list(g[g.bm25_norm > 0].sort_values("bm25_norm", ascending=False, kind="stable").ref_key)}
        taken: dict = {}
        turn, other = "vector", "lexical"
        while queues["vector"] or queues["lexical"]:
            side = turn if queues[turn] else other
            key = queues[side].pop(0)
            if key in taken:
                continue
            taken[key] = side
            turn, other = other, turn
        for key in g.ref_key:
            taken.setdefault(key, "rest")
        return pd.DataFrame({"query_id": keys[0], "ref_key": list(taken), "fused_pos": range(1, len(taken) + 1), "placed_by": list(taken.values())})

    kinds = dict(small.dtypes)
    placed = small.groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, ref_key {kinds['ref_key']}, fused_pos int, placed_by string")
    return hits.join(placed, ["query_id", "ref_key"])


def rank_groups(hits: DataFrame, order: str = "fused_pos") -> DataFrame:
    """``hits`` with authority_rank (missing is 4) and relevance_rank in it."""
    rank = F.coalesce("authority_rank", F.lit(LOWEST_RANK)).alias("authority_rank")
    rows = hits.select(*[c for c in hits.columns if c != "authority_rank"], rank)
    return rows.withColumn("relevance_rank", F.row_number().over(W.partitionBy("query_id", "authority_rank").orderBy(order, "ref_key")))


def applies(doc_type: Column, law: Column, hints: Column, universal: list[str]) -> Column:
    """Only laws are restricted: to the hints if there are any, and the universal ones."""
    return (doc_type != "law") | (F.size(hints) == 0) | law.isin(*universal) | F.array_contains(hints, law)


def strong(hits_apply: Column, law: Column, hints: Column) -> Column:
    by_words = (F.size(hints) > 0) & (F.col("bm25_norm") >= STRONG_NORM) & (F.col("bm25_raw") >= STRONG_LEXICAL) & F.array_contains(hints, law)
    return hits_apply & ((F.col("vec_raw") >= STRONG_VECTOR) | by_words)


def auto_select(hits: DataFrame, universal: list[str], per_rank: int = PER_RANK) -> DataFrame:
    """``hits`` (doc_type, law, hints, authority_rank, relevance_rank, scores) with selected and blocked_by."""
    fits = applies(F.col("doc_type"), F.col("law"), F.col("hints"), universal)
    is_strong = strong(fits, F.col("law"), F.col("hints"))
    group = F.col("authority_rank").isin(*AUTO_RANKS)
    inside = group & (F.col("relevance_rank") <= per_rank)
    selected = inside & is_strong
    reason = F.when(inside & ~fits, "law not of this case").when(inside & ~is_strong, "score too low")
    return hits.select("*", fits.alias("applies"), is_strong.alias("strong"), selected.alias("selected"), reason.alias("blocked_by"))


def display_order(hits: DataFrame, preferred: list[str]) -> DataFrame:
    """``hits`` with display_pos: in rank 1 preferred laws first; only after selection."""
    first = F.when(F.col("authority_rank") == 1, F.coalesce(F.array_position(F.array(*[F.lit(x) for x in preferred]), F.col("law")), F.lit(0))).otherwise(F.lit(0))
    place = F.when(first > 0, first).otherwise(F.lit(len(preferred) + 1))
    return hits.withColumn("display_pos", F.row_number().over(W.partitionBy("query_id", "authority_rank").orderBy(place, "relevance_rank")))


def nested_groups(hits: DataFrame) -> DataFrame:
    """One row a query: its rank groups in order, each with its hits in display order."""
    one = hits.groupBy("query_id", "authority_rank").agg(F.array_sort(F.collect_list(F.struct("display_pos", "ref_key", "selected"))).alias("hits"))
    group = F.struct("authority_rank", (F.col("authority_rank") <= 3).alias("auto"), "hits")
    return one.groupBy("query_id").agg(F.array_sort(F.collect_list(group)).alias("groups"))


def rank_coverage(hits: DataFrame, ranks: tuple[int, ...] = (1, 2, 3, 4)) -> DataFrame:
    out = hits.groupBy("query_id").agg(F.array_sort(F.collect_set("authority_rank")).alias("hit"), F.count_if("selected").alias("selected"), F.count_if(F.col("blocked_by").isNotNull()).alias("blocked"))
    return out.select("query_id", "hit", F.array_except(F.array(*[F.lit(r) for r in ranks]), F.col("hit")).alias("missing"), "selected", "blocked")


def precedents(near: DataFrame, queries: DataFrame, corpus: DataFrame, least: float = 0.80, misses: int = 3) -> DataFrame:
    """One row a query: matched and adopted among near hits (outcome), rebuttals by use, corpus size, near misses and best score if none.

    ``near``: hits with outcome and rebuttal (null for none). Rebuttals of matched
    hits are struct(text, used), most used first, then the nearest hit's first.
    """
    size = corpus.agg(F.count(F.lit(1)).alias("corpus"))
    strong_hits = near.where(F.col("score") >= least)
    good = strong_hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("matched"), F.count_if(F.col("outcome") == 1).alias("adopted"))
    tries = near.groupBy("query_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.when(F.col("pos") <= misses, F.struct("pos", "ref_key")))).alias("tried"))
    said = strong_hits.where("rebuttal is not null").groupBy("query_id", "rebuttal").agg(F.count(F.lit(1)).alias("used"), F.min("pos").alias("seen"))
    said = said.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("used")).alias("o"), "seen", F.col("rebuttal").alias("text"), "used"))).alias("said"))
    out = queries.select("query_id").join(good, "query_id", "left").join(tries, "query_id", "left").join(said, "query_id", "left").crossJoin(F.broadcast(size))
    none = F.col("matched").isNull()
    kind = dict(near.dtypes)
    rebuttals = F.coalesce(F.transform("said", lambda x: F.struct(x["text"].alias("text"), x["used"].alias("used"))), F.array().cast(f"array<struct<text:{kind['rebuttal']},used:bigint>>"))
    empty = F.array().cast(f"array<{kind['ref_key']}>")
    return out.select("query_id", F.coalesce("matched", F.lit(0)).alias("matched"), F.coalesce("adopted", F.lit(0)).alias("adopted"), "corpus", rebuttals.alias("rebuttals"), F.when(none, F.transform("tried", lambda x: x["ref_key"])).otherwise(empty).alias("near_misses"), F.when(none, F.col("best")).alias("best"))


def refresh(previous: DataFrame, fresh: DataFrame, only: DataFrame) -> DataFrame:
    """Fresh rows of the listed queries and of queries not seen before; earlier rows of the others."""
    kept = previous.join(only.select("query_id"), "query_id", "left_anti")
    old = previous.select("query_id").distinct()
    new = fresh.join(old.join(only.select("query_id"), "query_id", "left_anti"), "query_id", "left_anti")
    return kept.withColumn("reused", F.lit(True)).unionByName(new.withColumn("reused", F.lit(False)))


def case_summary(queries: DataFrame, hits: DataFrame, case_col: str = "case_id") -> DataFrame:
    """One row a case, queries without hits included."""
    per = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("selected").alias("selected"))
    rows = queries.select(case_col, "query_id").join(per, "query_id", "left")
    return rows.groupBy(case_col).agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("selected"), F.lit(0)).alias("selected"),
        F.count_if(F.coalesce("selected", F.lit(0)) == 0).alias("without_basis"),
    )


def conflicts(hits: DataFrame, letter: str, ruling: str) -> DataFrame:
    """(query_id, letters, rulings) of queries that hit both kinds."""
    of = lambda kind: F.array_sort(F.collect_set(F.when(F.col("doc_type") == kind, F.col("ref_key"))))
    out = hits.groupBy("query_id").agg(of(letter).alias("letters"), of(ruling).alias("rulings"))
    return out.where((F.size("letters") > 0) & (F.size("rulings") > 0))


def evaluate(expected: DataFrame, hits: DataFrame, within: int) -> DataFrame:
    """(query_id, best_rank, passed) of labelled queries (query_id, ref_key): the first expected key's rank."""
    ranks = expected.join(hits.select("query_id", "ref_key", "pos"), ["query_id", "ref_key"], "left")
    out = ranks.groupBy("query_id").agg(F.min("pos").alias("best_rank"))
    return out.select("query_id", "best_rank", F.coalesce(F.col("best_rank") <= within, F.lit(False)).alias("passed"))


def merge_hits(hits: DataFrame, order: str = "pos") -> DataFrame:
    """One row a key over all queries, a selected one first; law or other; by authority."""
    first = W.partitionBy("ref_key").orderBy(F.desc("selected"), order, "query_id")
    rows = hits.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("kind", F.when(F.col("doc_type") == "law", "law").otherwise("other"))
