import zlib

import numpy as np
import pytest

from docket.llm import langid
from docket.llm.queries import op3_language_id

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in op3_language_id(spark, SF).collect() if r.held_out]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert sum(r.lang_pred == docs[r.doc_id] for r in held) >= 0.97 * len(held)


def model():
    return langid.train([("the cat and the dog went to the house with them", "en"), ("der hund und die katze gehen nach hause mit ihnen", "de"), ("le chat et le chien vont dans la maison avec eux", "fr")] * 5)


def test_mixtures_and_sets():
    m = model()
    pred, score, shares = langid.infer(["the dog and the cat went to the house " * 5, "the dog and the cat went to the house. der hund und die katze gehen nach hause"], m)
    assert pred[0] == "en" and score[0] == pytest.approx(1) and (shares[0] > 0).sum() == 1
    assert score[1] < 0.9 and abs(shares[1].sum() - 1) < 1e-3


def by_definition(text, m):
    """Mixture of one text by plain loops: EM over all languages, then one fewer at a time, the weakest first."""
    _, buckets, counts = langid.trigram_counts([text])
    lik = np.exp(m.loglik[buckets].astype(float))
    k = len(m.languages)

    def fitted(theta, allowed, rounds):
        theta = np.array([(t + 1e-3) if i in allowed else 0.0 for i, t in enumerate(theta)])
        theta /= theta.sum()
        for _ in range(rounds):
            new = np.zeros(k)
            for row, n in zip(lik, counts, strict=True):
                part = row * theta
                new += n * part / part.sum()
            theta = new / counts.sum()
        return theta, sum(n * np.log(row @ theta) for row, n in zip(lik, counts, strict=True))

    allowed, theta, best = set(range(k)), np.ones(k), None
    for size in range(k, 0, -1):
        theta, ll = fitted(theta, allowed, 0 if size == 1 else langid.EM_ROUNDS if size == k else langid.MORE_ROUNDS)
        value = ll - size * 0.5 * np.log(counts.sum() + 1)
        if best is None or value > best[0]:
            best = (value, theta)
        allowed.discard(min(allowed, key=lambda i: theta[i]))
        if size == 2:
            allowed = {int(theta.argmax())}
    return best[1]


def test_inference_against_its_definition():
    m = model()
    texts = ["the dog and the cat went home", "der hund. le chat et le chien dans la maison", "the house und die katze", "nach hause", "zzz qqq xxx", "The DOG " * 30 + "mit ihnen"]
    pred, score, shares = langid.infer(texts, m)
    for i, text in enumerate(texts):
        want = by_definition(text, m)
        assert np.allclose(shares[i], want, atol=2e-3), text
        assert pred[i] == m.languages[int(want.argmax())] and score[i] == pytest.approx(want.max(), abs=2e-3)


def test_only_letters_count():
    pred, _, _ = langid.infer(["🙂 🙃 123 ...", "𝒳", ""], model())
    assert pred[0] == pred[2] == "und" and pred[1] != "und"


def test_odd_rows(spark, odd, empty):
    m = model()
    got = {r.doc_id: r for r in langid.predict(odd, m).collect()}
    assert [got[i].lang_pred for i in (2, 3, 4, 9)] == ["und"] * 4 and got[2].score == 0
    assert got[6].lang_pred in m.languages
    assert langid.predict(empty, m).count() == 0
    assert langid.fit(empty).languages == []
    assert {r.lang_pred for r in langid.predict(odd, langid.fit(empty)).collect()} == {"und"}
    assert set(langid.fit(odd).languages) == {"de", "en"}


def test_sample_is_of_different_texts_and_bounded(spark):
    rows = [(f"the cat and the dog number {i}", "en") for i in range(50)] + [("der hund", "de")] * 100 + [("x" * 30_000, "en"), ("le chat", None)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert set(langid.fit(docs).languages) == {"de", "en"}
    assert langid.fit(docs, languages=1).languages == ["de"]
    few = langid.fit(docs, sample_docs=3)
    assert set(few.languages) == {"de", "en"} and few.loglik.shape == (langid.BUCKETS, 2)


def test_sample_is_the_smallest_hashes(spark):
    """Also when many hashes share a prefix; repeated hashes count once."""
    rng = np.random.default_rng(2)
    rows = [(str(rng.choice(["en", "en", "en", "de"])), int(h)) for h in rng.integers(-(2**63), 2**63 - 1, 900)]
    rows += [("en", -(2**63) + i) for i in range(300)] * 2 + [("fr", 5), ("fr", -5)]
    got = langid.sample_edges(spark.createDataFrame(rows, "lang string, h long"), 250, 2)
    want = {lang: sorted({h for x, h in rows if x == lang})[:250][-1] for lang in ("en", "de")}
    assert got == want
