"""The prefix tree of conversations against a plain-Python twin."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pytest

from docket.llm import prefixtrie
from docket.llm.queries import op12_prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, p1 string, words string, stem string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def twin(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, said in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        family = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = tuple(own.get(family, [])[:h] + said[h:])
    members = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for node, who in members.items():
        under = [x for x in members if x[: len(node)] == node]
        childless = [x for x in under if not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in under)]
        words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) if x else 0
        ends = sorted(c for c in who if built[c] == node)
        out.append((
            min(who), len(node), min(members[node[:-1]]) if node else None, len(who), sum(len(x) == len(node) + 1 for x in under), len(childless),
            sum((len(members[x]) - 1) * words(x) for x in under), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
        ))
    return sorted(map(str, out))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA).repartition(5)
    return sorted(str(tuple(r)) for r in prefixtrie.conversation_trie(df).select(*COLUMNS).collect())


ODD = [
    (5, 1, "user", "hi there"), (5, None, None, None), (5, 2, "user", "hi there"), (5, 2, "user", "hi there"), (5, 2, "assistant", ""),
    (20, 1, "user", "hello you"), (20, 2, "assistant", "yes"), (20, 3, None, "no"), (21, 1, "user", "hello you"), (22, 9, "user", "x " * 4000),
    (23, 1, "user", "hello you"), (23, 2, "assistant", "yes"), (23, 3, None, "no"), (23, 4, "user", "why"), (None, 1, "user", "nobody"),
    (-7, 1, "user", "minus"), (-7, 2, "user", "minus"), (-40, 1, "user", "a"), (-41, 1, "user", "a"), (-41, 2, "us", "era"), (-42, 2, "user", "a"), (3, 0, "ä", "漢 字"),
]


def random_rows(seed, convs, longest, alphabet):
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(convs):
        for t in range(int(rng.integers(1, longest))):
            word = "w " * int(rng.integers(1, alphabet))
            rows.append((int(c * 7), t, "user", word))
    rows += [(100_000 + i, t, "user", f"same {t}") for i in range(150) for t in range(5)]  # copies hold a large share
    rows += [(200_000, t, "user", f"long {t % 7}") for t in range(400)]
    return rows


def test_odd(spark):
    assert run(spark, ODD) == twin(ODD)


def test_empty(spark):
    assert run(spark, []) == []


def test_one_conversation(spark):
    rows = [(40, 1, "user", "a"), (40, 2, "user", "b")]
    assert run(spark, rows) == twin(rows)


@pytest.mark.parametrize(("shard", "runs"), [(50_000, 1024), (40, 3), (3, 2)])
def test_shards_and_upper_nodes(spark, monkeypatch, shard, runs):
    monkeypatch.setattr(prefixtrie, "SHARD", shard)
    monkeypatch.setattr(prefixtrie, "RUN", runs)
    rows = random_rows(shard, 250, 7, 4)
    assert run(spark, rows) == twin(rows)


def test_double_array():
    """Every child is found by BASE and CHECK, and nothing else is."""
    rng = np.random.default_rng(3)
    parent, code, seen = [0], [0], set()
    for node in range(1, 400):
        while True:
            edge = (int(rng.integers(0, node)), int(rng.integers(1, 60)))
            if edge not in seen:
                break
        seen.add(edge)
        parent.append(edge[0])
        code.append(edge[1])
    base, check, slot = prefixtrie.double_array(np.array(parent), np.array(code))
    at = {int(s): i for i, s in enumerate(slot)}
    assert len(at) == 400
    for node in range(400):
        for c in range(1, 60):
            s = base[slot[node]] + c
            there = 0 < s < len(check) and check[s] == slot[node] and (node, c) in seen
            assert there == ((node, c) in seen)


def test_query(spark, sf_dir):
    rows = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    out = op12_prefix_trie(spark, sf_dir)
    assert out.columns == COLUMNS
    assert sorted(str(tuple(r)) for r in out.collect()) == twin(rows)
