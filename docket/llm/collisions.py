"""Near-duplicate vectors by collision counts on sorted one-dimensional projections.

Vectors are compared only inside one label, by cosine. Two unit vectors at the
threshold lie a known distance apart, so their Gaussian projections differ by a
normal variable of that spread. From this follow all parameters:

* a few coarse projections cut into cells give a vector one block key a table;
  their number follows the label's size and how evenly its vectors spread over
  cells, the number of tables the recall wanted at the threshold;
* inside a block ``PROJECTIONS`` other projections are sorted one by one. The
  window of ``WINDOW`` spreads around each vector in the sorted order holds those
  it collides with, and collisions are counted for each pair;
* the count that a pair at the threshold reaches with probability ``COUNT_RECALL``
  is asked for, and pairs that reach it are verified by their exact cosine.

Equal vectors of a label are compared once and stand for all their rows. A block
beyond ``CHUNK`` vectors is dealt into chunks whose pairs are tasks of their own,
so a task's group is bounded and nothing is left out. Pairs never leave a task: it
gives for each vector the links found there and one spanning edge. A pair that
meets in several tables is counted in the first one only.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.ann import usable
from docket.llm.components import connected_components
from docket.llm.groups import key_groups
from docket.session import cut, ship_package

CELL = 1.6
BLOCK = 512
MOST_CELLS = 16
TABLE_RECALL = 0.97
PROJECTIONS = 24
WINDOW = 2.0
COUNT_RECALL = 0.995
CHUNK = 1024
SEED = 77


def _normal(z: float) -> float:
    return 0.5 * (1 + math.erf(z / math.sqrt(2)))


def same_cell(spread: float, width: float) -> float:
    """Probability that two projections fall in one cell if their difference is normal with that spread."""
    if spread <= 0:
        return 1.0
    z = width / spread
    return 2 * _normal(z) - 1 - 2 / (z * math.sqrt(2 * math.pi)) * (1 - math.exp(-z * z / 2))


def tables_for(cells: int, spread: float) -> int:
    """Tables so that a pair at the threshold shares a block of ``cells`` projections in one of them."""
    hit = same_cell(spread, CELL) ** cells
    return 1 if hit > TABLE_RECALL else math.ceil(math.log(1 - TABLE_RECALL) / math.log(1 - hit))


def needed_count(projections: int = PROJECTIONS, window: float = WINDOW, recall: float = COUNT_RECALL) -> int:
    """The largest count that a pair at the threshold reaches with probability ``recall``."""
    p, reached = 2 * _normal(window) - 1, 0.0
    for count in range(projections, 0, -1):
        reached += math.comb(projections, count) * p**count * (1 - p) ** (projections - count)
        if reached >= recall:
            return count
    return 0


@cache
def _directions(dim: int, n: int, stream: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, dim, stream])
    return rng.standard_normal((n, dim)), rng.uniform(0, CELL, n)


def _rows(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors, each scaled by its largest component, and their lengths."""
    x = np.array(vectors.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x, np.sqrt((x * x).sum(axis=1))


def block_keys(unit: np.ndarray, cells: int, tables: int) -> np.ndarray:
    """(vectors, tables): the block of each vector in each table."""
    keys = np.full((len(unit), tables), cells, dtype=np.int64)
    for t in range(tables if cells else 0):
        a, shift = _directions(unit.shape[1], MOST_CELLS, t + 1)
        found = np.floor((unit @ a[:cells].T + shift[:cells]) / CELL).astype(np.int64)
        with np.errstate(over="ignore"):
            for j in range(cells):
                keys[:, t] = (keys[:, t] ^ (found[:, j] + 1)) * np.int64(-7046029254386353131)
                keys[:, t] ^= keys[:, t] >> np.int64(29)
    return keys


def colliding_pairs(unit: np.ndarray, half: float, needed: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a < b) that lie within ``half`` of each other on ``needed`` projections or more."""
    n = len(unit)
    lines = unit @ _directions(unit.shape[1], PROJECTIONS, 0)[0].T
    counts = np.zeros(n * n, dtype=np.uint8)
    for j in range(lines.shape[1]):
        order = np.argsort(lines[:, j], kind="stable")
        run = lines[order, j]
        after = np.searchsorted(run, run + half, side="right") - np.arange(n) - 1
        first = np.repeat(np.arange(n), after)
        second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(after) - after, after)
        a, b = order[first], order[second]
        counts[np.minimum(a, b) * n + np.maximum(a, b)] += 1
    return np.divmod(np.nonzero(counts >= max(needed, 1))[0], n)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component."""
    root = np.arange(n)
    while True:
        now = root.copy()
        np.minimum.at(now, a, root[b])
        np.minimum.at(now, b, root[a])
        now = now[now]
        if (now == root).all():
            return root
        root = now


def _representatives(vectors: DataFrame, vector: str) -> DataFrame:
    """(label, dim, v, rep, least, copies): one row a different vector of a label."""
    equal = vectors.groupBy("label", F.col(vector).alias("v")).agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return cut(equal.select("label", F.size("v").alias("dim"), "v", F.monotonically_increasing_id().alias("rep"), "least", "copies"))


def _first_cells(reps: DataFrame) -> DataFrame:
    """(label, dim, rep, cell): the cell of each vector on one projection."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for dim, part in b.groupby("dim"):
                x, length = _rows(part["v"])
                a, shift = _directions(int(dim), MOST_CELLS, 1)
                cell = np.floor((x @ a[0] / length + shift[0]) / CELL).astype(np.int64)
                yield pd.DataFrame({"label": part["label"], "dim": part["dim"], "rep": part["rep"], "cell": cell})

    return reps.select("label", "dim", "rep", "v").mapInPandas(run, "label string, dim int, rep long, cell long")


def _plan(reps: DataFrame) -> DataFrame:
    """(label, dim, cells): how many projections make a block key, so that blocks hold about BLOCK vectors.

    Two vectors of the label share a cell as often as the counts of one
    projection's cells say.
    """
    cells = _first_cells(reps).groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).cast("double").alias("n"))
    sizes = cells.groupBy("label", "dim").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("n")) / (F.sum("n") * F.sum("n"))).alias("meet"))
    wanted = F.ceil(F.log(F.col("n") / BLOCK) / -F.log(F.least("meet", F.lit(0.95))))
    return sizes.where("n > 1").select("label", "dim", F.greatest(F.lit(0), F.least(F.lit(MOST_CELLS), wanted)).cast("int").alias("cells"))


def _blocks(reps: DataFrame, plan: DataFrame, spread: float) -> DataFrame:
    """(label, dim, place, block, rep, earlier): each vector's block in each table, and those in the tables before."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (dim, cells), part in b.groupby(["dim", "cells"]):
                x, length = _rows(part["v"])
                keys = block_keys(x / length[:, None], int(cells), tables_for(int(cells), spread))
                for t in range(keys.shape[1]):
                    yield pd.DataFrame({"label": part["label"], "dim": part["dim"], "place": np.int32(t), "block": keys[:, t], "rep": part["rep"], "earlier": list(keys[:, :t])})

    known = reps.join(plan, ["label", "dim"]).select("label", "dim", "cells", "rep", "v")
    return known.mapInPandas(run, "label string, dim int, place int, block long, rep long, earlier array<long>")


def _found(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, root, n): in each task's group the rows that a vector links to, and the first member of its component."""
    spread = math.sqrt(2 - 2 * threshold)
    points = cut(_blocks(reps, _plan(reps), spread))
    key = ["label", "dim", "place", "block"]
    sizes = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    own = points.join(sizes, key).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select(*key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "earlier")
    group = [*key, "low", "high"]
    half, needed = WINDOW * spread, needed_count()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, group):
            if len(g) < 2:
                continue
            x, length = _rows(g["v"])
            a, b = colliding_pairs(x / length[:, None], half, needed)
            own = g["own"].to_numpy()
            if g["low"].iloc[0] != g["high"].iloc[0]:
                across = own[a] != own[b]
                a, b = a[across], b[across]
            cosine = np.concatenate([np.zeros(0)] + [np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)])
            near = cosine / (length[a] * length[b]) >= threshold
            a, b = a[near], b[near]
            if g["place"].iloc[0]:
                earlier = np.array(g["earlier"].tolist())
                fresh = ~(earlier[a] == earlier[b]).any(axis=1)
                a, b = a[fresh], b[fresh]
            if not len(a):
                continue
            copies, n = g["copies"].to_numpy(), np.zeros(len(g), dtype=np.int64)
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            at, rep = np.nonzero(n)[0], g["rep"].to_numpy()
            yield pd.DataFrame({"rep": rep[at], "root": rep[_roots(len(g), a, b)[at]], "n": n[at]})

    full = dealt.join(reps.select("rep", "copies", "v"), "rep").repartition(*group).sortWithinPartitions(*group)
    return full.select(*group, "own", "rep", "earlier", "copies", "v").mapInPandas(run, "rep long, root long, n long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: rows linked directly, smallest id reachable, whether it is its own.

    Rows link if their labels are equal and not null and their vectors' cosine is
    ``threshold`` or more. Vectors that are null, empty, zero or hold a null or a
    non-finite component link with nothing, nor do vectors of different lengths
    with each other. Repeated rows are rows of their own and link with each
    other, also under one id. A null id gives no component's number: its row has
    the smallest id of the others, or null, and isn't kept. Other columns are not
    read; an empty table gives an empty result.
    """
    ship_package(vectors.sparkSession)
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("string").alias("label"), F.col(f"`{vector_col}`").alias("v"))
    takes_part = usable(F.col("v")) & F.col("label").isNotNull()
    reps = _representatives(rows.where(takes_part), "v")
    found = cut(_found(reps, threshold))
    joined = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    members = joined.select(F.col("node").alias("rep"), "component")
    least = members.join(reps.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("smallest"))
    places = members.join(least, "component").select("rep", "smallest")
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    known = reps.join(places, "rep", "left").join(links, "rep", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("smallest", "least").alias("smallest"))
    out = rows.withColumn("label", F.when(takes_part, F.col("label"))).join(known, ["label", "v"], "left")
    component = F.coalesce("smallest", "id")
    return out.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
