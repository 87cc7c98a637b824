import math
import zlib
from itertools import combinations

import numpy as np
import pytest

from docket.llm import toxicity
from docket.llm.queries import op2_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in op2_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    held = [(r.toxic, got[r.doc_id]) for r in labels if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert all(g.held_out for _, g in held)
    assert sum(g.predicted for y, g in held if y == 1) >= 0.9 * sum(y == 1 for y, _ in held)
    assert sum(g.predicted for y, g in held if y == 0) <= 0.05 * sum(y == 0 for y, _ in held)


def naive(s, t):
    """The kernel by its definition: all triples of both strings."""

    def features(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                u = x[i] + x[j] + x[k]
                out[u] = out.get(u, 0.0) + toxicity.DECAY ** (k - i + 1)
        return out

    a, b = features(s), features(t)
    dot = sum(v * b.get(u, 0.0) for u, v in a.items())
    return dot / math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values())) if a and b else 0.0


def test_kernel_against_its_definition():
    strings = ["grumbolt", "grum-bolt", "aaaa", "ababab", "xyz", "xy", "", "漢字漢字", "snarfle", "\x02snarf", "“quoted”", "12345", "🙂a🙂b"]
    marks = ["grumbolt", "ababa", "漢字漢", "\x02snarf", "345", "🙂a🙂"]
    value = toxicity.Landmarks(marks).kernel(strings)
    assert np.allclose(value, [[naive(s, t) for t in marks] for s in strings], atol=1e-6)
    own = toxicity.Landmarks(marks).kernel(marks)
    assert np.allclose(own, own.T) and np.allclose(np.diag(own), 1) and np.linalg.eigvalsh(own).min() > -1e-6


def test_no_near_word_is_left_out():
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcd"), rng.integers(1, 14))) for _ in range(400)]
    marks = toxicity.Landmarks(["\x02abca", "abcabc", "dcbadcba"])
    near = set(marks.near(words))
    for w in words:
        windows = toxicity.windows_of(w)
        if windows and marks.kernel(windows).max() >= toxicity.FLOOR:
            assert w in near


def model():
    bad = ["you are a grumbolt indeed", "what a grumbolt this is", "such a snarfle here", "only a snarfle talks so"] * 10
    good = ["the weather is fine today", "we walked along the river", "a gentle breeze went round", "she talks about gardens", "what is this here indeed", "only such a thing are you"] * 40
    return toxicity.train([(f"{s} {i}", 1) for i, s in enumerate(bad)] + [(f"{s} {i}", 0) for i, s in enumerate(good)])


def score(m, text):
    words = toxicity.words_of(text)
    margin = m.margins(words)
    found = [margin[w] for w in words if w in margin]
    top, hits = max([m.bias, *found]), sum(map(toxicity.hit, found))
    return float(m.probability(np.array([top]), np.array([hits]), np.array([len(words)]))[0])


def test_gaps_blanks_and_insertions():
    m = model()
    for word in ("a grumbolt", "GRUMBOLT!!", "grum-bolt", "g.r.u.m.b.o.l.t", "gruxmbolt", "grumbolts", "snarfle", "snar.fle", "now s n a r f l e here"):
        assert score(m, word) >= 0.7, word
    for word in ("garden", "river", "gumbo", "bolt", "", "such a thing"):
        assert score(m, word) < 0.5, word


def test_labels_are_of_documents_not_of_landmarks():
    """A word of both classes isn't learnt, however often toxic documents have it."""
    bad = [f"the weather is grumbolt number {i}" for i in range(60)]
    good = [f"the weather is fine number {i}" for i in range(200)]
    m = toxicity.train([(s, 1) for s in bad] + [(s, 0) for s in good])
    assert score(m, "the weather is") < 0.5 and score(m, "the weather is grumbolt") >= 0.7


def by_definition(m, text):
    """A document's score from the kernel's definition, word by word and window by window."""
    top, hits, words = m.bias, 0.0, toxicity.words_of(text or "")
    for w in words:
        margins = []
        for v in toxicity.windows_of(w):
            value = [naive(v, mark) for mark in m.landmarks]
            if max(value) >= toxicity.FLOOR:
                margins.append(float(np.dot(value, m.weights)) + m.bias)
        if margins:
            top = max(top, *margins)
            hits += min(1.0, max(0.0, max(margins)))
    seen = [top, math.log1p(hits), math.log((hits + 0.1) / (len(words) + 50)), 1.0]
    return 1 / (1 + math.exp(-float(np.dot(seen, m.fit))))


def test_scores_against_their_definition(spark):
    m = model()
    texts = [None, "", "the weather is fine today", "what a grumbolt you are", "g r u m b o l t and a snar-fle, no!", "grumbling grumbolted snarflesnarfle bolt rumb", "such a thing " * 40 + "grum bolt", "漢字 🙂 Straße"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert all(abs(got[i] - by_definition(m, t)) < 1e-4 for i, t in enumerate(texts))


def test_without_both_classes():
    m = toxicity.train([("only fine words", 0)])
    assert score(m, "anything") < 0.5
    assert score(toxicity.train([]), "anything") < 0.5


def test_odd_rows(spark, odd, empty):
    rows = toxicity.score(odd, model()).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert toxicity.score(empty, model()).count() == 0
    labels = spark.createDataFrame([(1, 1), (5, 0), (None, 1), (6, None), (7, 3)], "doc_id long, toxic int")
    assert score(toxicity.fit(odd, labels), "anything") < 0.5
    assert toxicity.fit(empty, labels.limit(0)).landmarks == []


@pytest.mark.parametrize("often", [400, 40])
def test_frequent_and_rare_insults_also_with_blanks(spark, often):
    bad = [f"you are a grumbolt number {i}" for i in range(often)] + [f"such a snarfle number {i}" for i in range(20)]
    good = [f"the weather and such a thing you are number {i}" for i in range(1600)]
    m = toxicity.train([(s, 1) for s in bad] + [(s, 0) for s in good])
    docs = spark.createDataFrame([(1, "a grumbolt here"), (2, "a snarfle here"), (3, "now s n a r f l e here"), (4, "it is so in my own garden")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(docs, m).collect()}
    assert min(got[1], got[2], got[3]) >= 0.7 and got[4] < 0.5
