"""Exact vector search: matrix products in bounded groups, and a stored table of cells with radii.

Two vectors are comparable if they have the same length, no null, NaN or infinite
component, and aren't zero. Scores are cosines rounded to ``decimals``; ties go to
the smaller key.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.functions.groups import key_groups
from docket.operators.ordering import in_order
from docket.session import cut, ship_package

#: Units and queries whose product one group takes.
UNIT_CHUNK, QUERY_CHUNK = 4096, 1024


def comparable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def unit(v: Column) -> Column:
    d = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(d, lambda x: x / norm)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each query with pos, ties by ref_key."""
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "ref_key")
    return hits.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k)


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped_top_k(units: DataFrame, queries: DataFrame, by: list[str], k: int, decimals: int = 6, skip_self: bool = False) -> DataFrame:
    """(query_id, ref_key, score): each query's best k in each group that it shares with units, by the columns ``by``.

    ``units`` (by..., ref_key, vector) and ``queries`` (by..., query_id, vector).
    A group's units are dealt into chunks and its queries too, and a pair of
    chunks is one task's group, so no value of ``by`` is gathered whole.
    """
    keys = [*by, "_dim"]
    u = units.where(comparable(F.col("vector"))).withColumn("_dim", F.size("vector"))
    q = queries.where(comparable(F.col("vector"))).withColumn("_dim", F.size("vector"))
    sizes = u.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / UNIT_CHUNK).cast("int").alias("_units"))
    sizes = cut(sizes.join(q.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("_asks")), keys))
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    kinds = dict(q.dtypes) | dict(u.dtypes)
    u = u.join(sizes, keys).select(*keys, own("ref_key", "_units").alias("_u"), every("_asks").alias("_q"), F.lit(0).alias("_ask"), "ref_key", F.lit(None).cast(kinds["query_id"]).alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    q = q.join(sizes, keys).select(*keys, every("_units").alias("_u"), own("query_id", "_asks").alias("_q"), F.lit(1).alias("_ask"), F.lit(None).cast(kinds["ref_key"]).alias("ref_key"), "query_id", F.col("vector").cast("array<double>").alias("vector"))
    group = [*keys, "_u", "_q"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, group):
            asks = g["_ask"].to_numpy() == 1
            if asks.all() or not asks.any():
                continue
            there, who = g[~asks], g["query_id"].to_numpy(dtype=object)[asks]
            key = there["ref_key"].to_numpy(dtype=object)
            score = np.round(_matrix(g["vector"][asks]) @ _matrix(there["vector"]).T, decimals)
            if skip_self:
                score[who[:, None] == key[None, :]] = -np.inf
            n = min(k, len(key))
            at = np.argsort(-score, axis=1, kind="stable")[:, :n]  # units are sorted, so ties go to smaller keys
            found = np.take_along_axis(score, at, axis=1).ravel()
            rows = pd.DataFrame({"query_id": np.repeat(who, n), "ref_key": key[at.ravel()], "score": found})
            yield rows[found > -np.inf]

    ship_package(units.sparkSession)
    dealt = u.unionByName(q).repartition(*group).sortWithinPartitions(*group, "_ask", "ref_key")
    return dealt.select(*group, "_ask", "ref_key", "query_id", "vector").mapInPandas(run, f"query_id {kinds['query_id']}, ref_key {kinds['ref_key']}, score double")


def cosine_inside(units: DataFrame, queries: DataFrame, inside: tuple[str, DataFrame], k: int = 10, decimals: int = 6) -> DataFrame:
    """(query_id, ref_key, score, pos): a query's best units among those with one of its values in a column.

    ``inside`` = (column of units, rows of query_id and that column).
    """
    column, values = inside
    asked = queries.select("query_id", "vector").join(values.select("query_id", column).distinct(), "query_id")
    return best(grouped_top_k(units.select(column, "ref_key", "vector"), asked, [column], k, decimals), k)


# --- stored cells -------------------------------------------------------------------

#: Vectors that centres are fitted on, and the rounds.
SAMPLE, ROUNDS = 20_000, 8
MOST_CELLS = 4096
#: Vectors of a cell that are stored, bounded and scored together.
BLOCK = 512
#: Blocks that a query scores first.
FIRST_BLOCKS = 4
SLACK = 2e-6
#: A deletion of more units raises, unless its caller allows more.
DELETE_MOST = 500


def _centres(x: np.ndarray, n: int) -> np.ndarray:
    """Unit centres of spherical k-means; empty cells keep their centre."""
    centres = x[:: max(1, len(x) // n)][:n].copy()
    for _ in range(ROUNDS):
        of = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, of, x)
        length = np.linalg.norm(sums, axis=1)
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def write_cells(units: DataFrame, path: str, sample: int = SAMPLE) -> None:
    """Stores units (ref_key, vector, other columns) by cell, in blocks of increasing distance to the cell's centre.

    ``vectors`` has the rows with dim, cell and block, dealt and sorted by them, so
    a search reads the row groups of its blocks. ``blocks`` has each block's least
    and greatest distance to the centre, ``centres`` the centres, at most
    MOST_CELLS a length, fitted on at most ``sample`` units. Units that are not
    comparable aren't stored; every other one is. ``gone`` has the keys deleted
    since the store was written.
    """
    ship_package(units.sparkSession)
    spark = units.sparkSession
    rows = units.where(comparable(F.col("vector"))).withColumn("dim", F.size("vector"))
    sizes = {r["dim"]: r["count"] for r in rows.groupBy("dim").count().collect()}  # one row a length
    share = max(1, sum(sizes.values()) // max(1, sample))
    drawn = rows.where(F.pmod(F.xxhash64("ref_key", F.lit(9)), F.lit(share)) == 0).select("dim", unit(F.col("vector")).alias("vector")).limit(2 * sample).toPandas()
    centres = {}
    for dim, n in sizes.items():
        x = np.array(drawn["vector"][drawn["dim"] == dim].tolist(), dtype=np.float64).reshape(-1, dim)
        if not len(x):
            x = np.eye(1, dim)
        centres[dim] = _centres(x, int(min(MOST_CELLS, len(x), max(1, round(n**0.5)))))

    def place(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, some in b.groupby("dim"):
                x, c = _matrix(some["vector"]), centres[int(dim)]
                near = x @ c.T
                cell = np.argmax(near, axis=1)
                at = np.sqrt(np.maximum(0, 2 - 2 * near[np.arange(len(x)), cell]))
                yield some.assign(cell=cell.astype(np.int32), distance=at)

    kinds = dict(rows.dtypes)
    placed = rows.select("ref_key", "dim", "vector").mapInPandas(place, f"ref_key {kinds['ref_key']}, dim int, vector {kinds['vector']}, cell int, distance double")
    # a cell's rows are numbered in ranges, so that no cell is sorted in one task
    numbered = in_order(placed, "dim", "cell", "distance", "ref_key", pos="place")
    first = numbered.groupBy("dim", "cell").agg(F.min("place").alias("first"))
    numbered = numbered.join(first, ["dim", "cell"]).withColumn("block", F.floor((F.col("place") - F.col("first")) / BLOCK).cast("long"))
    others = [c for c in units.columns if c not in ("ref_key", "vector")]
    numbered = numbered.select("dim", "cell", "block", "distance", "ref_key", "vector")
    if others:
        numbered = numbered.join(units.select("ref_key", *others).dropDuplicates(["ref_key"]), "ref_key", "left")
    kept = cut(numbered)
    kept.repartitionByRange("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "ref_key").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/vectors")
    blocks = kept.groupBy("dim", "cell", "block").agg(F.min("distance").alias("inner"), F.max("distance").alias("outer"), F.count(F.lit(1)).alias("n"))
    blocks.write.mode("overwrite").parquet(f"{path}/blocks")
    listed = [(dim, i, v.tolist()) for dim, found in centres.items() for i, v in enumerate(found)]
    spark.createDataFrame(listed, "dim int, cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    units.select("ref_key").where("false").write.mode("overwrite").parquet(f"{path}/gone")


def _live(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows that weren't deleted."""
    return spark.read.parquet(f"{path}/vectors").join(spark.read.parquet(f"{path}/gone"), "ref_key", "left_anti")


def delete_units(spark: SparkSession, path: str, keys: DataFrame, dry_run: bool = True, most: int | None = DELETE_MOST) -> int:
    """Takes the units with a key in ``keys`` (ref_key) out of the store, and returns how many rows it has of them.

    More than ``most`` raise and nothing is deleted; a dry run only counts. Keys are
    noted beside the blocks, whose distances stay bounds of what is left in them.
    """
    found = cut(_live(spark, path).select("ref_key").join(keys.select("ref_key").distinct(), "ref_key", "left_semi"))
    n = found.count()
    if most is not None and n > most:
        raise ValueError(f"{n} units match, more than {most}")
    if n and not dry_run:
        found.distinct().write.mode("append").parquet(f"{path}/gone")
    return n


def _reach(queries: DataFrame, path: str) -> DataFrame:
    """(query_id, dim, cell, block, n, nearest): the least distance at which a vector of each block may lie from each query.

    By the triangle inequality, from the query's distance to the centre and the
    block's range. Queries stay where they are; they meet the cells' centres of
    their length as rows, at most MOST_CELLS each.
    """
    spark = queries.sparkSession
    asked = queries.where(comparable(F.col("vector"))).select("query_id", F.size("vector").alias("dim"), unit(F.col("vector")).alias("q"))
    centres = spark.read.parquet(f"{path}/centres")
    held: dict[int, np.ndarray] = {}
    for r in centres.orderBy("dim", "cell").collect():  # MOST_CELLS a length
        held.setdefault(r["dim"], []).append(r["centre"])
    held = {dim: np.array(found) for dim, found in held.items()}
    kind = dict(asked.dtypes)["query_id"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, some in b.groupby("dim"):
                if int(dim) not in held:
                    continue
                far = np.sqrt(np.maximum(0, 2 - 2 * np.array(some["q"].tolist()) @ held[int(dim)].T))
                n = far.shape[1]
                yield pd.DataFrame({"query_id": np.repeat(some["query_id"].to_numpy(), n), "dim": np.int32(dim), "cell": np.tile(np.arange(n, dtype=np.int32), len(some)), "far": far.ravel()})

    ship_package(spark)
    met = asked.mapInPandas(run, f"query_id {kind}, dim int, cell int, far double")
    blocks = spark.read.parquet(f"{path}/blocks")
    return met.join(blocks, ["dim", "cell"]).select("query_id", "dim", "cell", "block", "n", F.greatest(F.lit(0.0), F.col("far") - F.col("outer"), F.col("inner") - F.col("far")).alias("nearest"))


def search_cells(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, decimals: int = 6, where: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """((query_id, ref_key, score, pos), (query_id, blocks, read)): the exact nearest units, and the blocks there are and that were read.

    A query scores its most promising blocks first, then only those that can
    hold a cosine of its k-th or more. ``where`` is a condition on the stored rows;
    only those that meet it are hits.
    """
    vectors = _live(spark, path)
    vectors = vectors if where is None else vectors.where(where)
    reach = cut(_reach(queries, path))
    block = ["dim", "cell", "block"]
    order = F.row_number().over(W.partitionBy("query_id").orderBy("nearest", F.desc("n"), "cell", "block"))
    begun = cut(reach.withColumn("_n", order).where(F.col("_n") <= FIRST_BLOCKS).drop("_n"))
    asked = queries.select("query_id", "vector")

    def scored(blocks: DataFrame) -> DataFrame:
        wanted = blocks.select(*block).distinct()
        return grouped_top_k(vectors.join(wanted, block, "left_semi").select(*block, "ref_key", "vector"), blocks.select("query_id", *block).join(asked, "query_id"), block, k, decimals)

    first = cut(best(scored(begun), k))
    least = first.where(F.col("pos") == k).select("query_id", F.col("score").alias("least"))
    rest = reach.join(begun.select("query_id", *block), ["query_id", *block], "left_anti").join(least, "query_id", "left")
    rest = cut(rest.where(F.col("least").isNull() | (1 - F.col("nearest") * F.col("nearest") / 2 + SLACK >= F.col("least"))).drop("least"))
    hits = best(first.drop("pos").unionByName(scored(rest)), k)
    read = begun.unionByName(rest).groupBy("query_id").agg(F.count(F.lit(1)).alias("read"))
    return hits, reach.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks")).join(read, "query_id")
