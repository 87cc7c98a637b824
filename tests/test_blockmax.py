"""Many queries at once: what a task holds, and how the first levels are dealt."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import functions as F

from docket.operators import blockmax, retrieval


def block(n=300, terms=400, vocabulary=2000):
    rng = np.random.default_rng(3)
    term = np.concatenate([rng.choice(vocabulary, terms, replace=False) for _ in range(n)]).astype(np.int64) * 977
    idf = rng.uniform(0.1, 9, vocabulary)
    weight = rng.integers(1, 3, len(term)) * idf[term // 977]
    return np.arange(n) * 20, np.full(n, terms), term, weight


def test_queries_are_held_once_a_pair():
    """Each task held 12 bytes for each of four million weights, and three times that while it asked; two tasks' memory failed an executor."""
    ids, sizes, term, weight = block()
    queries = blockmax.Queries(ids, sizes, term, weight)
    assert len(pickle.dumps(queries)) < 6 * len(term)
    assert (queries.term[queries.pair] == term).all() and (queries.weight[queries.pair] == weight).all()
    part = queries.part(slice(100, 203))
    assert part.ids.tolist() == ids[100:203].tolist() and part.first[1] == 400
    assert (part.term[part.pair] == term[40_000:81_200]).all() and (part.weight[part.pair] == weight[40_000:81_200]).all()
    assert [s.start for s in queries.slices(1000)] == list(range(0, 300, 2)) and max(s.stop for s in queries.slices(10**9)) == 300


def test_first_levels_are_asked_slices_of_the_queries(spark, monkeypatch):
    """One task read the whole table for the first level and asked all queries there, while the other cores waited."""
    lists = spark.range(3000, numPartitions=6).select("id", F.lit(3).cast("long").alias("words"), F.expr("array(id % 7, 100 + id % 50, 1000 + id)").alias("terms"), F.expr("array(1, 1, 1)").alias("counts"))
    asked = lists.where("id % 30 = 0").select(F.col("id").alias("query_id"), "terms", F.expr("array(0.5D, 2D, 5D)").alias("weights"))
    rows = lambda: sorted(map(tuple, blockmax.search(lists, 3000, asked, 3.0, 4, first=100).collect()))
    levels = blockmax._levels(lists, 3000, 100)
    assert [n for _, n in levels] == [4, 2, 1, 1] and levels[0][0].rdd.getNumPartitions() == 1
    assert levels[0][0].inputFiles()  # written by itself, so no task reads the whole for it
    assert sum(docs.count() for docs, _ in levels) == 3000
    found = rows()
    assert len(found) == 400 and all(r[3] > 1 or r[0] == r[1] for r in found)
    monkeypatch.setattr(blockmax, "SLICES", 1)
    assert rows() == found


def test_scores_that_round_to_zero(spark):
    lists = spark.range(20, numPartitions=2).select("id", F.lit(1).cast("long").alias("words"), F.expr("array(5L)").alias("terms"), F.expr("array(1)").alias("counts"))
    asked = spark.createDataFrame([(1, [5], [1e-9])], "query_id long, terms array<long>, weights array<double>")
    rows = lambda zeros: [r["doc_id"] for r in blockmax.search(lists, 20, asked, 1.0, 3, first=2, zeros=zeros).orderBy("rank").collect()]
    assert rows(True) == [0, 1, 2] and rows(False) == []


def test_a_table_of_queries_leaves_out_products(spark, monkeypatch):
    """Every query met every document that has one of its words: a table of pages against the documents took 2.9 microseconds a pair."""
    monkeypatch.setattr(retrieval, "TASK_DOCS", 300)
    words = lambda i: " ".join([f"Common{i % 3}"] * (i % 4) + [f"w{i % 11} w{i % 17}, w{i} t{i % 29}"] * (1 + i % 2))
    rows = [(i, words(i)) for i in range(900)] + [(5, words(5)), (6, None), (950, None), (951, ""), (952, "--")]
    docs = spark.createDataFrame(rows, "ref_key long, text string").repartition(5)
    asked = spark.createDataFrame([(i, f"{words(i)} W{i + 1} w{i}") for i in range(60)] + [(3, "w3 w4"), (60, None), (61, "nowhere"), (62, "--")], "query_id int, text string")
    told = lambda df: sorted((r["query_id"], r["pos"], r["ref_key"], round(r["score"], 5)) for r in df.collect())
    scored = []
    monkeypatch.setattr(retrieval, "best_hits", lambda *a: scored.append(1))
    got = retrieval.bm25_of_many(docs, asked, 4)
    assert dict(got.dtypes) == {"query_id": "int", "ref_key": "bigint", "score": "double", "pos": "int"} and not scored
    got = told(got)
    monkeypatch.undo()
    # a text that is null has no length, as in SQL
    plain = told(retrieval.bm25(docs.where("ref_key <> 6 OR text is not null"), asked, 4))
    assert [g[:3] for g in got if g[0] != 5] == [p[:3] for p in plain if p[0] != 5] and len(got) == 240
    assert retrieval.bm25_of_many(docs.limit(0), asked).count() == 0 and retrieval.bm25_of_many(docs, asked.limit(0)).count() == 0
