import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from docket.llm import simhash
from docket.llm.components import connected_components
from docket.llm.queries import op9_simhash


def plain_fingerprint(text, width=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(pairs):
    root = {i: i for i, _ in pairs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in combinations(pairs, 2):
        if (x ^ y).bit_count() <= 4:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in pairs}


def test_fingerprints(odd_rows):
    for text in [r[1] for r in odd_rows] + ["A B C D", "a b c d", "É é x y z"]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = plain_components(docs)
    got = op9_simhash(spark, sf_dir).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{x:016x}", want[i]) for i, x in docs}


def test_links_lose_nothing_in_chunks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for x in base[:10].tolist():
        for _ in range(60):
            for b in rng.integers(0, 64, 3).tolist():
                x ^= 1 << b
            fps.add(x)
    monkeypatch.setattr(simhash, "BLOCK", 32)
    signed = sorted(int(np.uint64(x).view(np.int64)) for x in fps)
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.component for r in connected_components(simhash.fingerprint_links(frame)).collect()}
    want = plain_components([(x, x % 2**64) for x in signed])
    assert {x: roots.get(x, x) for x in signed} == want


def test_more_bands_for_more_fingerprints():
    assert simhash.bands(1000, 4) == 5
    assert simhash.bands(10**9, 4) > 6


def test_components_of_a_chain(spark):
    edges = spark.range(300).selectExpr("id + 1 AS u", "id AS v").union(spark.createDataFrame([(None, 5), (900, 900), (950, 951)], "u long, v long"))
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(301)) and got[951] == 950 and 900 not in got


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    zero = {r.doc_id for r in rows if r.fp == 0}
    assert len(rows) == 11 and {2, 3, 4} <= zero and {r.component_id for r in rows if r.fp == 0} == {2}
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns and kept.where(F.col("doc_id") == 1).count() == 1
    assert kept.where(F.col("doc_id").isin(3, 4)).count() == 0
    assert simhash.near_duplicates(empty).count() == 0 and simhash.representatives(empty).count() == 0


def test_representatives_of_shared_and_missing_ids(spark):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (None, text("b")), (None, text("c")), (7, text("c")), (8, text("d")), (8, text("e")), (8, text("e")), (9, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in simhash.representatives(docs).collect()]
    assert len(got) == 5 and set(got) == {(None, text("a")), (None, text("b")), (7, text("c")), (8, text("d")), (8, text("e"))}


def edited(rng, words, share):
    """A copy with that share of its words replaced, in runs."""
    out = list(words)
    while sum(a != b for a, b in zip(out, words, strict=True)) < share * len(words):
        at = int(rng.integers(0, len(out)))
        for i in range(at, min(at + 3, len(out))):
            out[i] = f"new{rng.integers(0, 10**9)}"
    return out


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def exact_survivors(texts):
    """The smallest id of each component of texts with a similarity of 0.8 or more, by all pairs that share a shingle."""
    sets = {i: shingle_set(t or "") for i, t in texts.items()}
    places = {}
    for i, found in sets.items():
        for x in found:
            places.setdefault(x, []).append(i)
    root = {i: i for i in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sorted(texts):
        common = {}
        for x in sets[i]:
            for j in places[x]:
                if j < i:
                    common[j] = common.get(j, 0) + 1
        for j, n in common.items():
            if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return {top(i) for i in texts}


def test_similar_texts_go_and_others_stay(spark, monkeypatch):
    rng = np.random.default_rng(11)
    texts = []
    for _ in range(25):
        base = [f"word{i}" for i in rng.integers(0, 3000, int(rng.integers(80, 600)))]
        texts.append(base)
        texts += [edited(rng, base, share) for share in (0.005, 0.01, 0.02, 0.05, 0.2)]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = exact_survivors(dict(enumerate(texts)))
    for block, size in ((4096, 16_000_000), (8, 2_000)):
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "SET_BYTES", size)
        kept = {r.doc_id for r in simhash.representatives(docs).collect()}
        gone, should = set(range(len(texts))) - kept, set(range(len(texts))) - want
        assert gone <= should and len(gone) >= 0.95 * len(should) > 0


def test_a_line_that_all_texts_share(spark, monkeypatch):
    """A hot block: unrelated texts stay though their smallest hash is the same, copies of one another go."""
    monkeypatch.setattr(simhash, "BLOCK", 20)
    rng = np.random.default_rng(5)
    line = "this is the line that stands in each and every one of these texts for ever".split()
    texts = {i: " ".join(line + [f"w{x}" for x in rng.integers(0, 5000, 60)]) for i in range(120)}
    texts |= {200 + i: texts[i] + " more" for i in range(0, 120, 3)}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.representatives(docs).collect()} == exact_survivors(texts) == set(range(120))


def test_documents_against_exact_similarity(spark):
    """On the documents: nothing goes that has no near-duplicate by exact similarity, and 0.95 of those that should go do."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    gone = set(texts) - {r.doc_id for r in simhash.representatives(docs).collect()}
    should = set(texts) - exact_survivors(texts)
    assert gone <= should and len(gone) >= 0.95 * len(should) > 0


def test_estimate_of_similarity():
    rng = np.random.default_rng(3)
    off = []
    for share in (0.6, 0.7, 0.8, 0.9, 1.0):
        for _ in range(20):
            n = 400
            both = rng.integers(0, 2**63, int(2 * share * n / (1 + share)), dtype=np.uint64)
            sides = [np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64)]) for _ in range(2)]
            fp = [np.packbits(2 * np.unpackbits(simhash._mixed(s).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=int) > n, bitorder="little").view("<u8") for s in sides]
            found = simhash.similarity_of(np.bitwise_count(fp[0] ^ fp[1]).sum(), np.array([float(n)]), float(n))[0]
            off.append(found - len(both) / (2 * n - len(both)))
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.035
