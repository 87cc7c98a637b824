import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docket.llm import ann, bm25
from docket.llm.queries import op7_multiprobe_neighbours, op8_bm25_top_k



def by_20():
    return F.pmod(F.col("vec_id"), F.lit(20)) == 0


def nearest(ids, x, q, k):
    score = x @ x[ids.index(q)]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
    return [ids[i] for i in order]


def recall(rows, ids, x, k=20):
    hits = total = 0
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append(r)
    for q in [i for i in ids if i % 20 == 0]:
        want, got = nearest(ids, x, q, k), sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in got] == list(range(1, len(want) + 1))
        hits, total = hits + len(set(want) & {r.vec_id for r in got}), total + len(want)
        for r in got:
            assert abs(r.score - float(x[ids.index(q)] @ x[ids.index(r.vec_id)])) < 1e-9
    return hits / total


def test_ann_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], dtype=float)
    assert recall(op7_multiprobe_neighbours(spark, sf_dir).collect(), ids, x) >= 0.99


def test_ann_recall_with_hashing(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 16)) * rng.uniform(0.5, 2, (3000, 1))
    x[1000:1500] = x[0]  # a large group of copies
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert ann.functions_for(2500) > 1
    assert recall(ann.search(frame, by_20()).collect(), list(range(3000)), x) >= 0.9


def test_ann_looks_where_the_kth_neighbour_is(spark):
    """The similarity is that of the table's own k-th neighbours, at every size."""
    rng = np.random.default_rng(9)
    for n in (60, 1000, 30_000):
        x = rng.standard_normal((n, 16))
        reps = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "rep long, v array<double>").repartition(5)
        norm = float(np.linalg.norm(x, axis=1).max())
        got = ann.expected_similarity(reps, 20, norm)
        u = x[:: max(1, n // 300)]
        true = -np.sort(-(u @ x.T) / (np.linalg.norm(u, axis=1, keepdims=True) * norm), axis=1)[:, 20]
        assert abs(got - np.clip(np.percentile(true, 10), 0.05, 0.98)) < 0.04


def test_ann_hashes_at_every_size():
    assert [ann.functions_for(n) for n in (0, 1, 500, 512, 5000)] == [1, 1, 1, 1, 3] and ann.functions_for(10**9) > 10
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 8))
    keys = ann.buckets_of(x, float(np.linalg.norm(x, axis=1).max()), 12, 0)
    assert len(set(keys.tolist())) > 50
    probes = ann.probes_of(x[:20], 0.9, 12, 0, 0.9)
    assert all(1 <= len(p) == len(set(p.tolist())) for p in probes) and sum(map(len, probes)) < 20 * 4000


def test_ann_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (40, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (1, [1.0, 0.0]), (20, [0.5, 0.5])]
    frame = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, rank string, score int")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.search(frame, by_20()).orderBy("query_id", "rank").collect()]
    # rows 1 and 20 are there twice: candidates twice, and 20 is a query twice that finds its other row
    one = [(20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 1, 0.5), (20, 4, 20, 0.5), (20, 5, 2, -0.5)]
    assert got == sorted([(0, 1, 1, 1.0), (0, 2, 1, 1.0), (0, 3, 20, 0.5), (0, 4, 20, 0.5), (0, 5, 2, -1.0), *one, *one])
    assert ann.search(frame.limit(0), by_20()).count() == 0


def plain_bm25(docs, queries, k):
    words = {i: Counter(bm25.words_of(t or "")) for i, t in docs}
    n, avg = len(docs), sum(sum(w.values()) for w in words.values()) / len(docs)
    df = Counter(t for w in words.values() for t in w)
    for q, text in queries:
        scored = []
        for i, w in words.items():
            dl = sum(w.values())
            s = sum(c * math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * w[t] * 2.2 / (w[t] + 1.2 * (0.25 + 0.75 * dl / avg)) for t, c in Counter(bm25.words_of(text or "")).items() if t in w)
            if s > 0:
                scored.append((-round(s, 6), i))
        yield q, sorted(scored)[:k]


def compare(rows, want):
    by = {}
    for r in rows:
        by.setdefault(r.query_id, []).append((r["rank"], r.doc_id, r.score))
    for q, best in want:
        got = sorted(by.get(q, []))
        assert [g[1] for g in got] == [b[1] for b in best]
        assert all(abs(g[2] + b[0]) < 2e-6 for g, b in zip(got, best, strict=True))


def test_bm25_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    compare(op8_bm25_top_k(spark, sf_dir).collect(), plain_bm25(docs, [d for d in docs if d[0] % 20 == 0], 10))


def test_bm25_shards_merge(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    compare(bm25.search(docs, asked, k=3, shard_words=10_000).collect(), plain_bm25(rows, [(r.query_id, r.text) for r in asked.collect()], 3))


def shard(docs):
    """A closed index of (id, text) rows, and weights of a text's terms."""
    index = bm25.ShardIndex()
    counts = [(i, Counter(bm25.words_of(t))) for i, t in docs]
    key = lambda w: int(np.uint64(bm25.xxhash.xxh64_intdigest(w)).view(np.int64))
    terms = [key(w) for _, c in counts for w in c]
    index.add(np.array([i for i, _ in counts]), np.array([sum(c.values()) for _, c in counts]), np.array([len(c) for _, c in counts]), np.array(terms, dtype=np.int64), np.array([n for _, c in counts for n in c.values()]))
    words = sum(sum(c.values()) for _, c in counts)
    index.close(words / len(docs))
    df = Counter(w for _, c in counts for w in c)

    def asked(text):
        c = Counter(bm25.words_of(text))
        return np.array([key(w) for w in c], dtype=np.int64), np.array([n * math.log1p((len(docs) - df[w] + 0.5) / (df[w] + 0.5)) for w, n in c.items()])

    return index, asked


def test_bm25_reads_few_blocks(spark):
    """Short queries on documents of very different words leave most blocks and postings unread, and stay exact."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"w{i}" for i in range(5000)])
    share = 1 / np.arange(1, 5001)
    docs = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 200), p=share / share.sum()))) for i in range(6000)]
    index, asked = shard(docs)
    queries = [(i, " ".join(rng.choice(vocabulary, 4, p=share / share.sum()))) for i in range(40)]
    want = dict(plain_bm25(docs, queries, 10))
    for q, text in queries:
        ids, score = index.top(*asked(text), 10)
        assert ids.tolist() == [i for _, i in want[q]] and np.allclose(score, [-s for s, _ in want[q]], atol=2e-6)
    assert index.blocks_read < 0.5 * index.blocks_total


def test_bm25_odd_rows(spark, odd, empty):
    asked = spark.createDataFrame([(1, "river cat"), (2, None), (3, ""), (None, "cat"), (4, "nowhere at all zzz")], "query_id long, text string")
    rows = bm25.search(odd, asked).collect()
    assert {r.query_id for r in rows} <= {1, 4} and [r.doc_id for r in rows if r.query_id == 1].count(1) == 2
    assert bm25.search(empty, asked).count() == 0
    assert bm25.search(odd, asked.limit(0)).count() == 0
