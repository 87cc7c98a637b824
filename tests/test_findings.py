"""One small case for each finding of a review that was right."""

from __future__ import annotations

import datetime as dt

import duckdb
import numpy as np

from docket.llm import simhash
from docket.llm.components import connected_components
from docket.operators import evidence as E
from docket.operators import lexindex
from docket.operators import retrieval as R
from docket.operators import scoring
from docket.operators import segmentation as S
from docket.plans import registry


def test_paragraphs_keep_digits_at_their_ends(spark):
    docs = spark.createDataFrame([(1, "0990 Wien 0\n 1 apple 1 \n\n22")], "doc_id long, text string")
    rows = S.paragraphs(docs).orderBy("para_id").collect()
    assert [(r["para_id"], r["para"]) for r in rows] == [("p1", "0990 Wien 0"), ("p2", "1 apple 1"), ("p3", "22")]


def by_sql(name: str, **paths: str) -> list[tuple]:
    """The rows that a query's SQL gives on these tables."""
    con = duckdb.connect()
    for table, path in paths.items():
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return con.execute(registry.oracle_sql()[name]).fetchall()


def test_run_admission_counts_whole_seconds_on_both_sides(spark, tmp_path):
    at = lambda minute, second, micro: dt.datetime(2024, 1, 1, 0, minute, second, micro)
    rows = [(5, 0, at(0, 0, 400_000)), (10, 0, at(20, 0, 600_000)), (15, 1, at(0, 0, 600_000)), (20, 1, at(20, 1, 400_000))]
    events = [(i, user, "click", ts, "{}", 1.0) for i, user, ts in rows] + [(7, 9, "view", at(0, 0, 0), "{}", 1.0)]
    path = f"{tmp_path}/events.parquet"
    con = duckdb.connect()
    con.execute("CREATE TABLE e (event_id BIGINT, user_id BIGINT, event_type VARCHAR, ts TIMESTAMP, props VARCHAR, value DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", events)
    con.execute(f"COPY e TO '{path}' (FORMAT parquet)")
    found = registry.queries()["l08_run_admission"](spark, str(tmp_path)).select("event_id", "reason", "allowed")
    got = sorted(tuple(r) for r in found.collect())
    assert got == sorted(by_sql("l08_run_admission", events=path))
    assert [(i, reason) for i, reason, _ in got if i in (10, 20)] == [(10, "running"), (20, "dead run")]


def test_similar_links_are_the_same_in_large_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, 128, dtype=np.uint8)
    rows = []
    for i in range(40):  # pairs that are alike share only the key of all
        wide = base if i < 2 else rng.integers(0, 256, 128, dtype=np.uint8)
        rows.append((i, bytearray(wide.tobytes()), 100 + 20 * (i % 2), [1, *(1000 * i + j for j in range(5))]))
    nodes = spark.createDataFrame(rows, "node long, wide binary, n long, keys array<long>")
    found = []
    for block in (4096, 8):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found.append(sorted(tuple(r) for r in connected_components(simhash.similar_links(nodes, 0.746)).collect()))
    assert found[0] == found[1] and {n for n, _ in found[0]} == {0, 1}


def test_bm25_in_small_blocks_and_chunks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(30)]
    text = lambda n: " ".join(rng.choice(words, n))
    docs = spark.createDataFrame([(f"d{i:03d}", f"v{i % 3}", text(1 + i % 25)) for i in range(150)], "ref_key string, law string, text string")
    asked = spark.createDataFrame([(i, text(9)) for i in range(11)], "query_id long, text string")
    allowed = asked.selectExpr("query_id", "concat('v', query_id % 2) AS law")
    found = []
    for weights, scores, products, k_docs in ((10**6, 4 * 10**6, 4 * 10**6, 4000), (20, 50, 30, 40)):
        monkeypatch.setattr(scoring, "BLOCK_WEIGHTS", weights)
        monkeypatch.setattr(scoring, "CHUNK_SCORES", scores)
        monkeypatch.setattr(scoring, "CHUNK_PRODUCTS", products)
        monkeypatch.setattr(R, "TASK_DOCS", k_docs)
        found.append([sorted(tuple(r) for r in R.bm25(docs, asked, 4, inside=inside).collect()) for inside in (None, ("law", allowed))])
    assert found[0] == found[1]
    assert len(found[0][0]) == 44 and {int(key[1:]) % 3 == q % 2 for q, key, _, _ in found[0][1]} == {True}


def test_party_match_joins_names_by_key(spark):
    cases = spark.createDataFrame([(1, 7, "Name: A B"), (2, 7, "AC"), (3, 8, "A B"), (4, 7, " "), (5, 7, None)], "id long, at long, who string")
    names = spark.createDataFrame([(7, "A:B"), (7, "Name:AB"), (9, "AC"), (7, None)], "at long, name string")
    rows = E.party_match(cases, names, ["at"], "who", "Name").orderBy("id").collect()
    assert [r["status"] for r in rows] == ["no_match", "need_human", "need_human", "unclear", "unclear"]


def test_index_search_hands_on_few_rows_of_a_run(spark, tmp_path):
    docs = spark.range(600).selectExpr("id AS ref_key", "concat('common w', id % 7) AS text")
    lexindex.write_segment(docs, f"{tmp_path}/index", 0)
    index = lexindex.Index(spark, f"{tmp_path}/index")
    asked = spark.range(3).selectExpr("id AS query_id", "concat('common w', id) AS text")
    weights = index.weights(asked)
    only = lexindex.term_filter(weights)
    runs = lexindex.bounds(index, weights, only)
    scored = lexindex._scored(index, weights, only, runs, 5, 6)  # 600 rows a query before
    tasks = scored.rdd.getNumPartitions()
    assert scored.count() <= 3 * 5 * tasks
    hits, _ = lexindex.search(index, asked, 5)
    assert sorted((r["query_id"], r["ref_key"]) for r in hits.collect()) == [(q, q + 7 * i) for q in range(3) for i in range(5)]
