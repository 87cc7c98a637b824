"""Stored index and vector cells: exact hits, what is skipped, and views that are kept up to date."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docket.operators import lexindex, retrieval, vectors


def corpus(spark, n=3000, seed=1, first=0):
    """Documents of a few topics in order, so that runs of documents differ in their words."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(first, first + n):
        topic = i * 12 // max(n, 1)
        words = [f"t{topic}w{int(x)}" for x in rng.zipf(1.5, 12) % 40] + [f"c{int(x)}" for x in rng.zipf(1.3, 12) % 60]
        rows.append((i, " ".join(words), f"v{i % 3}"))
    return spark.createDataFrame(rows, "ref_key long, text string, law string")


def brute_bm25(docs, queries, k):
    said = {r["ref_key"]: Counter(w for w in (r["text"] or "").lower().split()) for r in docs}
    n, avgdl = len(said), sum(sum(c.values()) for c in said.values()) / len(said)
    df = Counter(w for c in said.values() for w in c)
    out = []
    for q in queries:
        hits = []
        for key, c in said.items():
            score = 0.0
            for w in set(q["text"].lower().split()):
                if c[w]:
                    score += math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / avgdl))
            if score:
                hits.append((-round(score, 6), key))
        out += [(q["query_id"], key, -s, pos) for pos, (s, key) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def rows_of(df):
    return sorted((r["query_id"], r["ref_key"], r["score"], r["pos"]) for r in df.collect())


def close(got, want):
    assert [(a[0], a[1], a[3]) for a in got] == [(b[0], b[1], b[3]) for b in want]
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(got, want, strict=True))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "t3w1 t3w2 t3w5"), (2, "T7w1 c1 c2"), (3, "nowhere"), (4, "c1 c1 t0w4")], "query_id long, text string")


def test_index_is_exact_and_skips(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(lexindex, "RUN_DOCS", 16)
    monkeypatch.setattr(lexindex, "FIRST_RUNS", 2)
    docs = corpus(spark)
    lexindex.write_segment(docs, str(tmp_path), 0)
    index = lexindex.Index(spark, str(tmp_path))
    hits, report = lexindex.search(index, asked, 5)
    close(rows_of(hits), brute_bm25(docs.collect(), asked.collect(), 5))
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in report.collect()}
    assert 3 not in read
    assert read[1][1] <= read[1][0] and read[2][1] < 0.7 * read[2][0]


def test_terms_reach_the_scan(spark, asked, tmp_path):
    lexindex.write_segment(corpus(spark, 300), str(tmp_path), 0)
    index = lexindex.Index(spark, str(tmp_path))
    weights = index.weights(asked)
    plan = lexindex.term_filter(weights)(index.blocks().select("term", "top"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(term), In(term" in plan or "PushedFilters: [In(term" in plan
    assert "docs" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_index_filter_and_many_terms(spark, asked, tmp_path, monkeypatch):
    monkeypatch.setattr(lexindex, "LISTED_TERMS", 2)
    docs = corpus(spark, 900)
    lexindex.write_segment(docs, str(tmp_path), 0, "law")
    values = asked.select("query_id", F.lit("v1").alias("value"))
    hits, _ = lexindex.search(lexindex.Index(spark, str(tmp_path)), asked, 4, values)
    want = retrieval.bm25(docs, asked, 4, inside=("law", asked.select("query_id", F.lit("v1").alias("law"))))
    close(rows_of(hits), rows_of(want))


def test_segments(spark, asked, tmp_path):
    """Several segments, one with longer documents, one unfinished, one with nulls only; and none at all."""
    long = corpus(spark, 200, 5, 5000).withColumn("text", F.repeat(F.concat("text", F.lit(" ")), F.lit(9)))
    parts = [corpus(spark, 600, 2), long, spark.createDataFrame([(9000, None, None), (9001, "", "v1")], "ref_key long, text string, law string")]
    for i, p in enumerate(parts):
        lexindex.write_segment(p, str(tmp_path), i)
    lexindex.write_segment(corpus(spark, 50, 9, 7000), str(tmp_path / "other"), 0)
    (tmp_path / "blocks" / "segment=7").mkdir()
    hits, _ = lexindex.search(lexindex.Index(spark, str(tmp_path)), asked, 6)
    docs = [r for p in parts for r in p.collect()]
    close(rows_of(hits), brute_bm25(docs, asked.collect(), 6))
    with pytest.raises(ValueError, match="no index"):
        lexindex.Index(spark, str(tmp_path / "nothing"))


def test_view_equals_recomputation(spark, asked, tmp_path):
    """A small arrival keeps the stored hits, a large one of another kind forces a search."""
    small = corpus(spark, 30, 3, 10_000)
    flood = spark.createDataFrame([(20_000 + i, "t3w1 c1 " * 3, "v0") for i in range(2500)], "ref_key long, text string, law string")
    parts = [corpus(spark, 2000, 4), small, flood]
    lexindex.write_segment(parts[0], str(tmp_path), 0)
    view = lexindex.start_view(lexindex.Index(spark, str(tmp_path)), asked, 4)
    again = []
    for i in (1, 2):
        lexindex.write_segment(parts[i], str(tmp_path), i)
        view, report = lexindex.refresh_view(view, str(tmp_path), [i], asked, 4)
        again.append({r["query_id"] for r in report.collect() if r["recomputed"]})
        docs = [r for p in parts[: i + 1] for r in p.collect()]
        close(rows_of(lexindex.view_hits(view, 4)), brute_bm25(docs, asked.collect(), 4))
    assert 1 not in again[0] and 3 not in again[0]


def clustered(spark, n=4000, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((25, dim)) * 3
    x = centres[rng.integers(0, 25, n)] + rng.standard_normal((n, dim)) * 0.15
    rows = [(i, [float(c) for c in v], i % 4) for i, v in enumerate(x)]
    rows += [(90_001, None, 1), (90_002, [0.0] * dim, 1), (90_003, [float("nan")] * dim, 1), (90_004, [float("inf")] * dim, 1), (90_005, [1.0, 2.0], 1), (90_006, [None] * dim, 1)]
    return spark.createDataFrame(rows, "ref_key long, vector array<double>, label int"), x


def brute_cosine(x, labels, queries, k, label=None):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for key, q in queries:
        score = np.round(u @ (np.array(q) / np.linalg.norm(q)), 6)
        rows = sorted((-s, i) for i, s in enumerate(score) if label is None or labels[i] == label)[:k]
        out += [(key, i, -s, pos) for pos, (s, i) in enumerate(rows, 1)]
    return sorted(out)


def test_cells_are_exact_and_skip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 64)
    units, x = clustered(spark)
    vectors.write_cells(units, str(tmp_path), sample=800)
    asked = [(i, x[i * 7].tolist()) for i in range(12)]
    queries = spark.createDataFrame([*asked, (77, None), (78, [1.0, 2.0])], "query_id long, vector array<double>")
    hits, report = vectors.search_cells(spark, str(tmp_path), queries, 8)
    got = rows_of(hits)
    close([r for r in got if r[0] < 70], brute_cosine(x, None, asked, 8))
    assert [r[1] for r in got if r[0] == 78] == [90_005]
    blocks = report.where("query_id < 70").agg(F.sum("read"), F.sum("blocks")).first()
    assert blocks[0] < 0.4 * blocks[1]
    filtered, _ = vectors.search_cells(spark, str(tmp_path), queries.where("query_id < 70"), 5, where=F.col("label") == 2)
    close(rows_of(filtered), brute_cosine(x, [i % 4 for i in range(len(x))], asked, 5, 2))


def test_one_definition_of_comparable(spark):
    """Both cosines leave out the same units, and queries of several lengths are fine."""
    units, x = clustered(spark, 300)
    queries = spark.createDataFrame([(1, x[0].tolist()), (2, [3.0, 1.0]), (3, None), (4, [float("nan")] * 16)], "query_id long, vector array<double>")
    want = brute_cosine(x, None, [(1, x[0])], 5) + [(2, 90_005, round(5 / math.sqrt(50), 6), 1)]
    close(rows_of(retrieval.cosine(units, queries, 5)), want)
    close(rows_of(retrieval.cosine(units, queries, 5, block_bytes=8)), want)
    inside = ("label", spark.createDataFrame([(q, v) for q in (1, 2, 3, 4) for v in range(4)], "query_id long, label int"))
    close(rows_of(retrieval.cosine_inside(units, queries, inside, 5)), want)


def test_hot_value_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(vectors, "UNIT_CHUNK", 50)
    monkeypatch.setattr(vectors, "QUERY_CHUNK", 3)
    units, x = clustered(spark, 400)
    asked = [(i, x[i].tolist()) for i in range(9)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    inside = ("label", queries.select("query_id", F.lit(2).alias("label")))
    close(rows_of(retrieval.cosine_inside(units, queries, inside, 6)), brute_cosine(x, [i % 4 for i in range(400)], asked, 6, 2))


def test_empty_stores(spark, asked, tmp_path):
    units, _ = clustered(spark, 50)
    vectors.write_cells(units.where("false"), str(tmp_path / "v"))
    queries = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, vector array<double>")
    assert vectors.search_cells(spark, str(tmp_path / "v"), queries)[0].count() == 0
    lexindex.write_segment(corpus(spark, 5).where("false"), str(tmp_path / "t"), 0)
    assert lexindex.search(lexindex.Index(spark, str(tmp_path / "t")), asked)[0].count() == 0


def test_deleted_documents_leave_no_trace(spark, asked, tmp_path, monkeypatch):
    """Hits and statistics are those of the rest, over two deletions, an update, and after compaction."""
    monkeypatch.setattr(lexindex, "RUN_DOCS", 16)
    path = str(tmp_path)
    docs = corpus(spark, 900).union(spark.createDataFrame([(5000, None, "v0"), (5001, "", "v1")], "ref_key long, text string, law string"))
    lexindex.write_segment(docs, path, 0, "law")
    rows = {r["ref_key"]: r for r in docs.collect()}
    keys = lambda some: spark.createDataFrame([(k,) for k in some], "ref_key long")

    def check():
        index = lexindex.Index(spark, path)
        close(rows_of(lexindex.search(index, asked, 5)[0]), brute_bm25(rows.values(), asked.collect(), 5))
        assert index.docs == len(rows) == index.documents().count()
        counts = Counter(w for r in rows.values() for w in set((r["text"] or "").split()))
        assert {r["term"]: r["df"] for r in index.terms().collect()} == counts

    first = [k for k in rows if k % 4 == 1] + [5000]
    assert lexindex.delete(spark, path, keys([*first, first[0], None, 777777])) == len(first)
    with pytest.raises(ValueError, match="more than 10"):
        lexindex.delete(spark, path, keys(first), dry_run=False, most=10)
    check()  # neither a dry run nor one that raised
    assert lexindex.delete(spark, path, keys(first), dry_run=False) == len(first)
    assert lexindex.delete(spark, path, keys(first), dry_run=False) == 0
    for k in first:
        rows.pop(k)
    (tmp_path / "gone_keys" / "deletion=1").mkdir()  # left by a deletion that didn't finish
    new = spark.createDataFrame([(k, f"t3w1 c1 new{k}", "v2") for k in (2, 3, 9000)], "ref_key long, text string, law string")
    assert lexindex.replace(new, path, 1, "law") == 2
    rows.update({r["ref_key"]: r for r in new.collect()})
    check()
    lexindex.compact(spark, path, 0)
    assert lexindex.Index(spark, path).deletions == []
    check()
    assert lexindex.delete(spark, path, keys(list(rows)), dry_run=False, most=None) == len(rows)
    index = lexindex.Index(spark, path)
    assert index.docs == 0 and lexindex.search(index, asked)[0].count() == 0
    lexindex.compact(spark, path, 1)
    assert lexindex.Index(spark, path).documents().count() == 0


def test_replace_starts_an_index(spark, asked, tmp_path):
    docs = corpus(spark, 40)
    assert lexindex.replace(docs, str(tmp_path), 0) == 0
    close(rows_of(lexindex.search(lexindex.Index(spark, str(tmp_path)), asked, 3)[0]), brute_bm25(docs.collect(), asked.collect(), 3))


def test_view_follows_deletions(spark, asked, tmp_path):
    """Few deletions keep the stored hits; when too many went, the query is searched again; also after compaction."""
    path, docs = str(tmp_path), corpus(spark, 1500, 8)
    lexindex.write_segment(docs, path, 0)
    rows = {r["ref_key"]: r for r in docs.collect()}
    view = lexindex.start_view(lexindex.Index(spark, path), asked, 4)
    best = [r["ref_key"] for r in lexindex.view_hits(view, 12).where("query_id = 1").orderBy("pos").collect()]
    for gone, compacted, again in [(best[:1], False, False), (best[1:11], False, True), ([k for k in rows if k % 3 == 0], True, None)]:
        lexindex.delete(spark, path, spark.createDataFrame([(k,) for k in gone], "ref_key long"), dry_run=False, most=None)
        for k in gone:
            rows.pop(k, None)
        if compacted:
            lexindex.compact(spark, path, 0)
        view, report = lexindex.refresh_view(view, path, [], asked, 4)
        close(rows_of(lexindex.view_hits(view, 4)), brute_bm25(rows.values(), asked.collect(), 4))
        if again is not None:
            assert (1 in {r["query_id"] for r in report.collect() if r["recomputed"]}) == again
    changed = spark.createDataFrame([(k, "t3w1 t3w2 " + rows[k]["text"]) for k in list(rows)[:5]], "ref_key long, text string")
    assert lexindex.replace(changed, path, 1) == 5
    rows.update({r["ref_key"]: r for r in changed.collect()})
    view, _ = lexindex.refresh_view(view, path, [1], asked, 4)
    close(rows_of(lexindex.view_hits(view, 4)), brute_bm25(rows.values(), asked.collect(), 4))


def test_deleted_vectors(spark, tmp_path):
    """Hits are those among the rest; a store written anew has all again."""
    units, x = clustered(spark, 1200)
    path, asked = str(tmp_path), [(i, x[i * 7].tolist()) for i in range(6)]
    queries = spark.createDataFrame(asked, "query_id long, vector array<double>")
    vectors.write_cells(units, path, sample=400)
    gone = spark.createDataFrame([(i,) for i in range(0, 1200, 2)] + [(0,), (None,), (777_777,)], "ref_key long")
    assert vectors.delete_units(spark, path, gone, most=None) == 600
    with pytest.raises(ValueError, match="more than 500"):
        vectors.delete_units(spark, path, gone, dry_run=False)
    close(rows_of(vectors.search_cells(spark, path, queries, 4)[0]), brute_cosine(x, None, asked, 4))
    assert vectors.delete_units(spark, path, gone, dry_run=False, most=None) == 600
    assert vectors.delete_units(spark, path, gone, dry_run=False) == 0
    close(rows_of(vectors.search_cells(spark, path, queries, 4)[0]), brute_cosine(x, [i % 2 for i in range(1200)], asked, 4, 1))
    vectors.write_cells(units, path, sample=400)
    close(rows_of(vectors.search_cells(spark, path, queries, 4)[0]), brute_cosine(x, None, asked, 4))
