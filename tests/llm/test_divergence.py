"""Source divergence audit against a plain-Python twin."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest

from docket.llm import divergence
from docket.llm.queries import op11_source_divergence

PATTERN = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def twin(rows, min_docs=10):
    """rows: (text, lang, source)."""
    docs = [(lang or "", source or "", PATTERN.findall((text or "").translate(LOWER))) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        seen = Counter(t for d in mine for t in set(d[2]))
        kept = {t for t, n in seen.items() if n >= min_docs}
        counts = {s: Counter(t for d in mine if d[1] == s for t in d[2] if t in kept) for s in {d[1] for d in mine}}
        counts_lang = sum(counts.values(), Counter())
        share = lambda c, t: 1 + 1000000000 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))
        apart = lambda p, q: (p - q) * (p - q) // (p + q)
        for s, c in counts.items():
            pairs = [(-sum(apart(share(c, t), share(o, t)) for t in kept), i) for i, o in counts.items() if i != s]
            terms = [(-apart(share(c, t), share(counts_lang, t)), t) for t in kept if c[t] and share(c, t) > share(counts_lang, t)]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (x[0], x[1].encode()))[:10])):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (x[0], x[1].encode())), 1):
                    out.append((lang, s, part, item, -value, rank))
    return sorted(map(str, out))


def run(df, min_docs=10):
    return sorted(str(tuple(r)) for r in divergence.audit(df, min_docs=min_docs).collect())


def made(seed, n, words, sources):
    rng = np.random.default_rng(seed)
    letters = "aAbBé漢ß🙂z"
    known = ["".join(rng.choice(list(letters), int(rng.integers(1, 6)))) for _ in range(words)]
    rows = []
    for _ in range(n):
        source = f"s{int(rng.zipf(1.5)) % sources}"
        text = " ".join(known[int(i) % words] for i in rng.zipf(1.3, int(rng.integers(0, 40))) % 100000)
        rows.append((text.replace(" ", ["-", " ", "\n", "1"][int(rng.integers(0, 4))]), ["en", "de", None][int(rng.integers(0, 3))], source))
    return rows


def test_odd(spark, odd, odd_rows):
    assert run(odd, 1) == twin([(r[1], r[2], r[3]) for r in odd_rows], 1)
    assert run(odd, 2) == twin([(r[1], r[2], r[3]) for r in odd_rows], 2)
    assert run(odd, 50) == twin([(r[1], r[2], r[3]) for r in odd_rows], 50)


def test_empty(empty):
    assert run(empty) == []


@pytest.mark.parametrize("small", [False, True])
def test_against_twin(spark, monkeypatch, small):
    """Also with several transducers, rounds, blocks and tiles, and with a task's counts sent often."""
    if small:
        for name, value in {"SHARD_TERMS": 7, "ROUND_BYTES": 9000, "BLOCK": 5, "TILE": 2, "HELD_TERMS": 20, "HELD_COUNTS": 50, "ROWS": 9, "STEP_BYTES": 100}.items():
            monkeypatch.setattr(divergence, name, value)
    rows = made(4, 400, 120, 7)
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert run(df, 3) == twin(rows, 3)


def test_transducer_is_minimal_and_numbers_terms():
    rng = np.random.default_rng(1)
    terms = sorted({bytes(rng.choice(list(b"abcde\xc3\xff"), int(rng.integers(1, 8))).tolist()) for _ in range(3000)})
    fst = divergence.unpack(divergence.pack(divergence.build_transducer(terms)))
    asked = terms + [b"abcdeabcde", b"zz", b"a" * 300]
    text = np.frombuffer(b" ".join(asked), np.uint8)
    length = np.array([len(t) for t in asked])
    start = np.cumsum(length + 1) - length - 1
    want = [i if i < len(terms) else (terms.index(t) if t in terms else -1) for i, t in enumerate(asked)]
    assert divergence.ordinals(fst, text, start, length).tolist() == want
    # minimal: as many states as different sets of endings
    prefixes = {t[:i] for t in terms for i in range(len(t) + 1)}
    by_prefix = {}
    for t in terms:
        for i in range(len(t) + 1):
            by_prefix.setdefault(t[:i], set()).add(t[i:])
    assert len(fst["final"]) == len({frozenset(by_prefix[p]) for p in prefixes})


def test_query(spark, sf_dir):
    rows = [(r["text"], r["lang"], r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    out = op11_source_divergence(spark, sf_dir)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(str(tuple(r)) for r in out.collect()) == twin(rows)
