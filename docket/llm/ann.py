"""Approximate nearest neighbours by inner product: multiprobe p-stable hashing.

Inner product becomes distance by one more coordinate (all vectors get the
largest norm). A table hashes a vector by Gaussian projections cut into cells of
one width; a bucket is a tuple of cells. A query visits buckets in the order of
the probability that a neighbour lies there: given the query's projection, a
neighbour at the expected similarity has a normally distributed one, so a cell's
probability is a difference of normal distributions and a bucket's their product.
It stops when the visited probability reaches the target. Candidates of all
tables are ranked by exact inner products on the original vectors.

Equal vectors are hashed and compared once and stand for all their rows. A bucket
beyond ``CHUNK`` vectors is dealt into chunks, and the queries that visit it into
blocks of ``QUERY_BLOCK``; its vectors are copied for the blocks that visit it
only. One task's group is so bounded and nothing is left out. A query that finds
too few neighbours is searched against all vectors in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.groups import key_groups
from docket.session import cut

TABLES = 2
WIDTH = 2.0
TARGET = 0.98
BUCKET = 512
CHUNK = 4096
QUERY_BLOCK = 8192
HELD_ROWS = 2_000_000
SAMPLE_QUERIES = 200

_ERF = np.vectorize(math.erf, otypes=[float])


def _normal(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + _ERF(x / math.sqrt(2)))


def functions_for(n: int) -> int:
    """Projections in a table, one at least, so that its buckets hold about BUCKET of n vectors."""
    return max(1, math.ceil(math.log2(max(n, 1) / BUCKET) / 1.6))


def projections(dim: int, m: int, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions (m, dim + 1) and offsets of one table, by a fixed seed."""
    rng = np.random.default_rng(1000 + table)
    return rng.standard_normal((m, dim + 1)), rng.uniform(0, WIDTH, m)


def _next(key: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """A bucket's number with one more cell; two buckets that share a number only add candidates."""
    with np.errstate(over="ignore"):
        return (key + cells.astype(np.int64) + 1) * np.int64(-7046029254386353131)


def buckets_of(x: np.ndarray, norm: float, m: int, table: int) -> np.ndarray:
    """Bucket of each row; rows are lifted to the largest norm and scaled to 1."""
    a, b = projections(x.shape[1], m, table)
    lifted = np.hstack([x / norm, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1) / norm**2))[:, None]])
    cells = np.floor((lifted @ a.T + b) / WIDTH)
    key = np.zeros(len(x), dtype=np.int64)
    for j in range(m):
        key = _next(key, cells[:, j])
    return key


def probes_of(q: np.ndarray, similarity: float, m: int, table: int, target: float) -> list[np.ndarray]:
    """For each row its buckets, likeliest first, up to the target probability.

    Cells are added one function at a time. Of the beginnings so far the least
    likely go that together have no more than a share of half of what the target
    leaves over, so the list stays short however many functions there are.
    """
    a, b = projections(q.shape[1], m, table)
    unit = q / np.linalg.norm(q, axis=1, keepdims=True)
    mean = similarity * (unit @ a[:, :-1].T) + b
    spread = math.sqrt(max(1e-6, 1 - similarity**2))
    reach = math.ceil(3.2 * spread / WIDTH) + 1
    cells = np.floor(mean / WIDTH)[:, :, None] + np.arange(-reach, reach + 1)
    prob = _normal(((cells + 1) * WIDTH - mean[:, :, None]) / spread) - _normal((cells * WIDTH - mean[:, :, None]) / spread)
    spare = (1 - target) / 2 / m
    out = []
    for i in range(len(q)):
        p, key = np.ones(1), np.zeros(1, np.int64)
        for j in range(m):
            key = _next(key[:, None], cells[i, j]).ravel()
            p = (p[:, None] * prob[i, j]).ravel()
            order = np.argsort(-p, kind="stable")
            upto = np.cumsum(p[order])
            order = order[: int(np.searchsorted(upto, upto[-1] - spare)) + 1]
            p, key = p[order], key[order]
        out.append(key[: int(np.searchsorted(np.cumsum(p), target)) + 1])
    return out


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null or zero, all components finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _hash(reps: DataFrame, make_keys, tables: int) -> DataFrame:
    """(table, bucket, rep) for each table and each bucket that ``make_keys(matrix, table)`` gives."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 500):
                part = b.iloc[at : at + 500]
                x = np.array(part["v"].tolist(), dtype=np.float64)
                for t in range(tables):
                    keys = make_keys(x, t)
                    yield pd.DataFrame({"table": np.int32(t), "bucket": np.concatenate(keys), "rep": np.repeat(part["rep"].to_numpy(), [len(k) for k in keys])})

    return reps.select("rep", "v").mapInPandas(run, "table int, bucket long, rep long")


def _candidates(points: DataFrame, probes: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """(query, rep, score): in each bucket the best k vectors for each query that visits it.

    ``points`` and ``probes``: (table, bucket, rep); ``reps``: (rep, v).
    """
    here = points.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    visits = probes.groupBy("table", "bucket").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("blocks"))
    sizes = cut(here.join(visits, ["table", "bucket"]))  # buckets that hold vectors and are visited
    both = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    p = points.join(sizes, ["table", "bucket"])
    p = p.select("table", "bucket", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int").alias("chunk"), both("blocks").alias("block"), F.lit(0).alias("asks"), "rep")
    q = probes.join(sizes, ["table", "bucket"])
    q = q.select("table", "bucket", both("chunks").alias("chunk"), F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int").alias("block"), F.lit(1).alias("asks"), "rep")
    keys = ["table", "bucket", "chunk", "block"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for group in key_groups(batches, keys):
            asks = group["asks"].to_numpy() == 1
            if asks.all() or not asks.any():
                continue
            rep, x = group["rep"].to_numpy()[~asks], np.array(group["v"][~asks].tolist(), dtype=np.float64)
            who, all_q = group["rep"].to_numpy()[asks], np.array(group["v"][asks].tolist(), dtype=np.float64)
            order = np.argsort(rep)
            rep, x = rep[order], x[order]
            for at in range(0, len(who), 512):
                score = all_q[at : at + 512] @ x.T
                n = min(k, len(rep))
                best = np.argsort(-score, axis=1, kind="stable")[:, :n]
                held.append(pd.DataFrame({"query": np.repeat(who[at : at + 512], n), "rep": rep[best].ravel(), "score": np.take_along_axis(score, best, axis=1).ravel()}))
            if sum(map(len, held)) > HELD_ROWS:
                held = [_trimmed(held, k)]
        if held:
            yield _trimmed(held, k)

    dealt = p.union(q).join(reps, "rep").select(*keys, "asks", "rep", "v").repartition(*keys).sortWithinPartitions(*keys, "asks")
    return dealt.mapInPandas(run, "query long, rep long, score double")


def _trimmed(held: list[pd.DataFrame], k: int) -> pd.DataFrame:
    """Each query's best k of what a task found in its buckets; more can't be among the best k of all."""
    rows = pd.concat(held, ignore_index=True).drop_duplicates(["query", "rep"])
    rows = rows.iloc[np.lexsort((rows["rep"], -rows["score"], rows["query"]))]
    return rows[rows.groupby("query").cumcount().to_numpy() < k]


def _best(found: DataFrame, who: str, ties: list[str], k: int) -> DataFrame:
    order = W.partitionBy(who).orderBy(F.desc("score"), *ties)
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def expected_similarity(reps: DataFrame, k: int, norm: float) -> float:
    """Similarity at which to look: the tenth percentile of the k-th neighbours' of SAMPLE_QUERIES vectors.

    The sampled vectors are compared with all in one pass, of which each batch's
    best leave it, so the figure is that of the table at every size.
    """
    drawn = reps.select("v", F.xxhash64("rep").alias("h")).orderBy("h").limit(SAMPLE_QUERIES).toPandas()
    if len(drawn) < 3:
        return 0.5
    q = np.array(drawn["v"].tolist(), dtype=np.float64)
    q /= np.linalg.norm(q, axis=1, keepdims=True) * norm

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = np.full((len(q), k + 1), -np.inf)
        for b in batches:
            for at in range(0, len(b), 4096):
                x = np.array(b["v"].iloc[at : at + 4096].tolist(), dtype=np.float64)
                best = -np.partition(-np.hstack([best, q @ x.T]), k, axis=1)[:, : k + 1]
        found = best > -np.inf
        yield pd.DataFrame({"q": np.nonzero(found)[0], "sim": best[found]})

    nth = F.row_number().over(W.partitionBy("q").orderBy(F.desc("sim")))
    near = reps.select("v").mapInPandas(run, "q long, sim double").withColumn("nth", nth).where(F.col("nth") <= k + 1)
    last = near.groupBy("q").agg(F.min("sim").alias("sim")).toPandas()["sim"]
    return float(np.clip(np.percentile(last, 10), 0.05, 0.98))


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, tables: int = TABLES, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query row, itself left out.

    Vectors that are null, zero, not finite, or of another length than most, and
    rows with a null id, take no part. Rows equal in id and vector are candidates
    and queries each, as often as they are there. With fewer than k other rows
    all are returned. Ties go to the smaller id. An empty table gives an empty
    result; other columns are not read.
    """
    vector, key = F.col(f"`{vector_col}`"), F.col(f"`{id_col}`")
    rows = vectors.where(usable(vector) & key.isNotNull()).select(key.cast("long").alias("id"), F.transform(vector, lambda x: x.cast("double")).alias("v"), is_query.alias("asks"))
    # rows are numbered in the order of their ids, so ties by row, and by a group's first row, are ties by id
    rows = cut(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("row", F.monotonically_increasing_id()))
    usual = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if usual is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    rows = rows.where(F.size("v") == usual["dim"])
    least = rows.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("id", "row"))).where(F.col("nth") <= k + 1)
    reps = cut(least.groupBy("v").agg(F.min("row").alias("rep"), F.array_sort(F.collect_list(F.struct("id", "row"))).alias("own")))
    asking = cut(rows.where("asks").join(reps.select("v", "rep"), "v").select("id", "row", "rep"))
    asked = reps.join(asking.select("rep").distinct(), "rep", "left_semi").select("rep", "v")
    vector_of = reps.select("rep", "v")
    n = reps.count()
    norm = math.sqrt(reps.agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).first()[0])
    m = functions_for(n)
    similarity = expected_similarity(reps, k, norm)
    each = 1 - (1 - target) ** (1 / tables)  # by each table, so that all together reach the target
    points = cut(_hash(reps, lambda x, t: [np.array([b]) for b in buckets_of(x, norm, m, t)], tables))
    probes = cut(_hash(asked, lambda x, t: probes_of(x, similarity, m, t, each), tables))
    found = _candidates(points, probes, vector_of, k + 1).groupBy("query", "rep").agg(F.max("score").alias("score"))
    found = cut(_best(found, "query", ["rep"], k + 1).select("query", "rep", "score"))
    enough = found.groupBy("query").count().where(F.col("count") >= min(k + 1, n)).select(F.col("query").alias("rep"))
    short = cut(asked.join(enough, "rep", "left_anti"))
    if short.count():
        one = lambda df: df.select(F.lit(0).alias("table"), F.lit(0).cast("long").alias("bucket"), "rep")
        whole = _candidates(one(reps), one(short), vector_of, k + 1)
        found = cut(found.union(_best(whole, "query", ["rep"], k + 1).select("query", "rep", "score")).groupBy("query", "rep").agg(F.max("score").alias("score")))
    spread = found.join(reps.select("rep", "own"), "rep").select("query", "score", F.explode("own").alias("hit")).select("query", "score", "hit.id", "hit.row")
    lists = _best(spread, "query", ["id", "row"], k + 1).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "row", "score"))).alias("near"))
    out = asking.join(lists, asking["rep"] == lists["query"])
    near = F.slice(F.filter("near", lambda x: x["row"] != F.col("row")), 1, k)
    out = out.select(F.col("id").alias("query_id"), F.posexplode(near).alias("rank", "hit"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
