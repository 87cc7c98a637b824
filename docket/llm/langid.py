"""Language ID by multilingual mixture inference.

Each language has smoothed likelihoods of hashed character trigrams, learnt from
a bounded sample. A document is a mixture: expectation-maximisation estimates its
languages' proportions from the likelihoods of its trigrams. Of the language sets
that drop the weakest language again and again, the one with the best penalised
likelihood (half the logarithm of the trigrams for each language) is taken. The
prediction is the language with the largest proportion, the score its proportion.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.texts import map_texts
from docket.session import cut

BUCKETS = 1 << 16
SAMPLE_DOCS = 2_000
PREFIX_BITS = 16  # of a text's hash, by which a language's texts are counted
DOC_CHARS = 20_000  # longest document to learn from
LANGUAGES = 256
STEP_CHARS = 2_000_000
EM_ROUNDS = 12  # from equal shares over all languages
MORE_ROUNDS = 3  # after a language is dropped, from the shares before
UNDETERMINED = "und"


def _letters() -> np.ndarray:
    """For each code point of the basic plane the lower-case letter, else 0."""
    out = np.zeros(0x10000, dtype=np.uint32)
    for c in range(0x10000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_TABLE: list[np.ndarray] = []


def trigram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, bucket, count) of trigrams over letters; other characters are one blank at a time."""
    if not _TABLE:
        _TABLE.append(_letters())
    raw = np.frombuffer("\0\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    sizes = np.array([len(t) for t in texts], dtype=np.int64) + 2
    sizes[-1] -= 2
    owner = np.repeat(np.arange(len(texts)), sizes)
    code = np.where(raw < 0x10000, _TABLE[0][np.minimum(raw, 0xFFFF)], raw).astype(np.uint64)
    for c in np.unique(raw[raw >= 0x10000]).tolist():
        if not chr(c).isalpha():
            code[raw == c] = 0
    # runs of characters that aren't letters shrink to one
    blank = code == 0
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    code, owner = code[keep], owner[keep]
    code = np.concatenate([np.zeros(1, np.uint64), code, np.zeros(1, np.uint64)])
    mixed = code[:-2] * np.uint64(0x9E3779B97F4A7C15) + code[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + code[2:] * np.uint64(0x165667B19E3779F9)
    bucket = (mixed >> np.uint64(47)).astype(np.int64) & (BUCKETS - 1)
    real = code[1:-1] > 0
    key = owner[real] * BUCKETS + bucket[real]
    key, count = np.unique(key, return_counts=True)
    return key // BUCKETS, key % BUCKETS, count


@dataclass
class Model:
    """Languages in order and the logarithm of each bucket's likelihood for each; its size is fixed."""

    languages: list[str]
    loglik: np.ndarray


def train(rows: Iterable[tuple[str, str]]) -> Model:
    """A model of (text, language) rows."""
    counts: dict[str, np.ndarray] = {}
    for text, lang in rows:
        _, bucket, n = trigram_counts([text])
        counts.setdefault(lang, np.zeros(BUCKETS))[bucket] += n
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    table = np.stack([counts[k] for k in names], axis=1)
    share = table.sum(axis=1, keepdims=True) / max(1.0, table.sum())
    smooth = (table + 50 * share + 0.01) / (table.sum(axis=0) + 50 + 0.01 * BUCKETS)
    return Model(names, np.log(smooth).astype(np.float32))


def _fit_mixtures(lik: np.ndarray, count: np.ndarray, starts: np.ndarray, owner: np.ndarray, allowed: np.ndarray, theta: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, log likelihoods) of each document's mixture over its allowed languages."""
    theta = (theta + 1e-3) * allowed
    theta = (theta / theta.sum(axis=1, keepdims=True)).astype(np.float32)
    total = np.add.reduceat(count, starts)
    for _ in range(rounds):
        part = lik * theta[owner]
        part *= (count / np.maximum(part.sum(axis=1), 1e-12))[:, None]
        theta = np.add.reduceat(part, starts, axis=0) / total[:, None]
    mass = np.maximum((lik * theta[owner]).sum(axis=1), 1e-12)
    return theta, np.add.reduceat(count * np.log(mass), starts)


def infer(texts: list[str], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, its proportion, all proportions) of each text; ``und`` and 0 without a letter."""
    k = len(model.languages)
    pred, score, shares = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros((len(texts), k))
    if not k or not texts:
        return pred, score, shares
    doc, bucket, count = trigram_counts(texts)
    if not len(doc):
        return pred, score, shares
    ids, starts = np.unique(doc, return_index=True)
    owner = np.repeat(np.arange(len(ids)), np.diff(np.append(starts, len(doc))))
    log = model.loglik[bucket]
    lik = np.exp(log - log.max(axis=1, keepdims=True)) + np.float32(1e-12)
    count = count.astype(np.float32)
    penalty = 0.5 * np.log(np.add.reduceat(count, starts) + 1)
    allowed = np.ones((len(ids), k), np.float32)
    theta = allowed
    best, best_theta = np.full(len(ids), -np.inf), np.zeros((len(ids), k))
    for size in range(k, 0, -1):
        theta, ll = _fit_mixtures(lik, count, starts, owner, allowed, theta, 0 if size == 1 else EM_ROUNDS if size == k else MORE_ROUNDS)
        value = ll - size * penalty
        better = value > best
        best[better], best_theta[better] = value[better], theta[better]
        weakest = np.where(allowed > 0, theta, np.inf).argmin(axis=1)
        allowed[np.arange(len(ids)), weakest] = 0
        if size == 2:  # what is left may be any one language: try the strongest by itself
            allowed[:] = 0
            allowed[np.arange(len(ids)), theta.argmax(axis=1)] = 1
    top = best_theta.argmax(axis=1)
    for i, t in zip(ids.tolist(), top.tolist(), strict=True):
        pred[i] = model.languages[t]
    score[ids] = np.clip(best_theta[np.arange(len(ids)), top], 0, 1)
    shares[ids] = best_theta
    return pred, score, shares


def sample_edges(known: DataFrame, sample_docs: int, languages: int) -> dict[str, int]:
    """For each of the commonest languages the ``sample_docs``-th smallest hash of its rows (lang, h), or its largest if there are fewer."""
    once = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"))
    once = cut(once.withColumn("prefix", F.shiftright("h", 64 - PREFIX_BITS)))
    upto = F.sum("c").over(W.partitionBy("lang").orderBy("prefix"))
    prefixes = once.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("c")).withColumn("before", upto - F.col("c"))
    last = prefixes.where(F.col("before") < sample_docs).groupBy("lang").agg(F.max("prefix").alias("prefix"), F.max("before").alias("before"))
    nth = F.row_number().over(W.partitionBy("lang").orderBy("h")) + F.col("before")
    edge = once.join(last, ["lang", "prefix"]).withColumn("nth", nth).where(F.col("nth") <= sample_docs).groupBy("lang").agg(F.max("h").alias("most"))
    common = once.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    return {r["lang"]: r["most"] for r in edge.join(common, "lang", "left_semi").collect()}


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, doc_chars: int = DOC_CHARS, languages: int = LANGUAGES) -> Model:
    """Learns from at most ``sample_docs`` different documents of each language, chosen by their text's hash.

    Null texts, null languages and texts of more than ``doc_chars`` characters are
    not used, nor more than the ``languages`` commonest languages, so what
    reaches the driver is bounded in bytes. Two scans do for all languages: one
    finds each language's largest hash in its sample, one reads the sample. The
    largest hash is found in the counts of hash prefixes first and then among the
    few hashes of the prefix it lies in, so no language's hashes are sorted in one
    task.
    """
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    known = docs.where(F.length(text).between(1, doc_chars) & lang.isNotNull()).select(text.alias("text"), lang.cast("string").alias("lang"), F.xxhash64(text).alias("h"))
    edges = sample_edges(known, sample_docs, languages)
    if not edges:
        return train([])
    most = F.create_map(*[F.lit(x) for pair in sorted(edges.items()) for x in pair])
    rows = known.where(F.col("h") <= most[F.col("lang")]).dropDuplicates(["lang", "h"]).select("text", "lang")
    return train((r["text"], r["lang"]) for r in rows.toLocalIterator())


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, proportions), one row for each row of ``docs``.

    Whole texts are read. A null text or one without a letter is ``und`` with
    score 0 and proportions 0; so is every text if the model knows no language.
    Only the text enters. An empty table gives an empty one.
    """

    def make() -> Callable[[list[str]], dict]:
        def run(texts: list[str]) -> dict:
            pred: list[str] = []
            score, shares, at = [np.empty(0)], [], 0
            while at < len(texts):
                end, chars = at, 0
                while end < len(texts) and (end == at or chars < STEP_CHARS):
                    chars += len(texts[end])
                    end += 1
                p, s, m = infer(texts[at:end], model)
                pred += p
                score.append(s)
                shares += m.tolist()
                at = end
            return {"lang_pred": pred, "score": np.concatenate(score), "proportions": shares}

        return run

    return map_texts(docs, {"doc_id": id_col}, text_col, make, "lang_pred string, score double, proportions array<double>")
