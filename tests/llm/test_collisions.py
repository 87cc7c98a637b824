"""Near-duplicate vectors against brute force."""

from __future__ import annotations

import math

import numpy as np
import pytest

from docket.llm import collisions
from docket.llm.queries import op13_collision_counting

SCHEMA = "vec_id long, embedding array<double>, label int, rep string, v string"


def brute(rows, threshold=0.98):
    def fine(v):
        return v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v) and any(v)

    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i):
            (_, v, a), (_, w, b) = rows[i][:3], rows[j][:3]
            if a is None or a != b or not fine(v) or not fine(w) or len(v) != len(w):
                continue
            x, y = np.array(v) / max(map(abs, v)), np.array(w) / max(map(abs, w))
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                links[i].append(j)
                links[j].append(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()]:
                if k not in group:
                    group.add(k)
                    todo.append(k)
        seen |= group
        least = min((rows[k][0] for k in group if rows[k][0] is not None), default=None)
        for k in group:
            out[k] = (rows[k][0], len(links[k]), least, rows[k][0] is not None and rows[k][0] == least)
    return sorted(map(str, out))


def planted(n, dim, seed, label):
    """Chains, dense groups and exact copies among random vectors."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, dim))
    for i in range(0, n // 3):
        step = rng.standard_normal(dim)
        base[i + n // 2] = base[i] + step / np.linalg.norm(step) * np.linalg.norm(base[i]) * rng.choice([0.0, 0.05, 0.12, 0.19, 0.25])
    for i in range(n // 10):
        base[n - 1 - i] = base[0] + rng.standard_normal(dim) * 0.03
    return [(int(i), v.tolist(), int(label(i)), "x", "y") for i, v in enumerate(base)]


def run(spark, rows, parts=5):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted(str(tuple(r)) for r in collisions.near_duplicates(df).collect())


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1),
        (8, [1.0, nan], 1), (9, [inf, 0.0], 1), (10, [], 1), (11, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.01], 1), (None, [5.0, 5.0], 7),
        (12, [1e308, 1e308], 3), (12, [1e308, 1e308], 3), (13, [1e-300, 1e-300], 3), (14, [-1.0, 0.0], 1), (0, [0.0, 1.0], 1),
    ]
    rows = [(*r, "x", "y") for r in rows]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == []


def test_against_brute_force_in_one_block(spark):
    rows = planted(400, 24, 1, lambda i: i % 3)
    got, want = run(spark, rows), brute(rows)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.98 * len(want)


def test_blocks_chunks_and_tables(spark, monkeypatch):
    """Small blocks and chunks: every link found is right, and 0.9 or more are found."""
    monkeypatch.setattr(collisions, "BLOCK", 16)
    monkeypatch.setattr(collisions, "CHUNK", 40)
    rows = planted(700, 24, 2, lambda i: 0 if i % 3 else 1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {r["id"]: r for r in collisions.near_duplicates(df).collect()}
    want = {int(t[0]): int(t[1]) for t in (s.strip("()").split(", ") for s in brute(rows))}
    assert all(got[i]["n_links"] <= n for i, n in want.items())
    assert sum(r["n_links"] for r in got.values()) >= 0.95 * sum(want.values())


def test_copies_are_not_compared(spark):
    """A group of copies that holds most rows is one vector."""
    rows = [(i, [1.0, 2.0, 3.0], 1, "x", "y") for i in range(3000)] + [(9000, [1.0, 2.0, 3.01], 1, "x", "y"), (9001, [-1.0, 2.0, 3.0], 1, "x", "y")]
    got = {r["id"]: r for r in collisions.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[5]["n_links"] == 3000 and got[9000]["n_links"] == 3000 and got[9001]["n_links"] == 0
    assert [i for i, r in got.items() if r["kept"]] == [0, 9001]


def test_parameters():
    """The count is calibrated: pairs at the threshold reach it, pairs of cosine 0.9 seldom do."""
    rng = np.random.default_rng(5)
    needed, half, dim = collisions.needed_count(), collisions.WINDOW * math.sqrt(0.04), 64

    def reach(cosine):
        hits = 0
        for _ in range(400):
            x, y = rng.standard_normal((2, dim))
            x /= np.linalg.norm(x)
            y -= (y @ x) * x
            y /= np.linalg.norm(y)
            hits += len(collisions.colliding_pairs(np.array([x, cosine * x + math.sqrt(1 - cosine**2) * y]), half, needed)[0])
        return hits / 400

    assert reach(0.98) > 0.95 and reach(0.9) < 0.1 and reach(0.2) == 0
    assert collisions.tables_for(0, 0.2) == 1 and collisions.tables_for(16, 0.2) < 30
    assert collisions.same_cell(0.2, 1.6) == pytest.approx(0.90, abs=0.01)


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    out = op13_collision_counting(spark, sf_dir)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted(str(tuple(r)) for r in out.collect()) == brute(rows)
