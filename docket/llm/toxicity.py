"""Toxicity by a subsequence string kernel with Nystroem landmarks and a linear SVM.

Kernel: the feature of three characters is the sum, over all places where they
occur in order in a string with at most ``SPAN`` characters from first to last,
of ``DECAY`` to the power of that span; the kernel of two strings is the cosine of
their features. Inserted characters and gaps so weaken a match and don't end it.

Texts are compared in windows: words with a mark for their beginning of up to
``SIZES[-1]`` characters, and of longer ones all windows of ``SIZES`` characters. Punctuation inside a word is left out
(``i-d-i-o-t``), and runs of tokens of one or two letters are joined and cut into
windows too (``i d i o t``).

Training knows labels of documents only. Landmarks come from both classes: from
toxic documents windows that tell them from the others, from the others windows
near those. Each window's kernel with the landmarks, times the inverse root of
the landmarks' kernel matrix (Nystroem), enters a squared-hinge SVM in which every
window of another document counts as not toxic, and of a toxic one at first all
windows count as toxic, then those that the SVM of the round before takes for
toxic, and its most toxic one in any case (multiple-instance SVM). A toxic
document's window is an example once more with a foreign character inserted. The margin of a document's most toxic
window, its words' hits (see ``hit``) and their share give the score, by a
logistic fit on the training documents.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.texts import map_texts

SPAN = 6
DECAY = 0.8
SIZES = (6, 8, 10)
START = "\x02"  # before each word
FLOOR = 0.64  # a window further from all landmarks isn't scored: it has no margin and is no hit
LABELLED = 2_000  # documents of each class to learn from
DOC_CHARS = 20_000  # longest document to learn from
LANDMARKS = 128
ROUNDS = 4
MISSED = 2.0  # how much a missed toxic document costs against a false alarm
MOST_LETTERS = 128
SEEN = 250_000  # words whose margins a task keeps
_DROP = re.compile(r"[^\w\s]+|_+")
#: Three or more tokens of one or two characters with blanks between.
_RUN = re.compile(r"(?<!\S)\S{1,2}(?:\s+\S{1,2}){2,}(?!\S)")
_OFFSETS = [(a, b) for b in range(2, SPAN) for a in range(1, b)]


def words_of(text: str) -> list[str]:
    """Lower-cased words without punctuation, and runs of short ones once more without the blanks."""
    plain = _DROP.sub("", text.lower())
    return plain.split() + ["".join(run.split()) for run in _RUN.findall(plain)]


def windows_of(word: str) -> list[str]:
    """What of a word is compared with landmarks; nothing of one under three letters."""
    word = START + word
    n = len(word)
    whole = [word] if 4 <= n <= SIZES[-1] else []
    return whole + [word[i : i + size] for size in SIZES if n > size for i in range(n - size + 1)]


def _triples(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, three characters as one number, weight) of all occurrences in all strings."""
    raw = np.frombuffer(("\0" * SPAN).join(strings).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    owner = np.repeat(np.arange(len(strings)), sizes + SPAN)[: len(raw)]
    owners, keys, weights = [], [], []
    for a, b in _OFFSETS:
        if len(raw) > b:
            one, two, three = raw[:-b], raw[a : len(raw) - b + a], raw[b:]
            at = np.nonzero((one > 0) & (two > 0) & (three > 0))[0]
            owners.append(owner[at])
            keys.append((one[at] << 42) | (two[at] << 21) | three[at])
            weights.append(np.full(len(at), DECAY ** (b + 1)))
    if not owners:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    return np.concatenate(owners), np.concatenate(keys), np.concatenate(weights)


def _features(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_triples`` with the occurrences of each triple in a string summed, and divided by the string's norm."""
    owner, key, weight = _triples(strings)
    order = np.lexsort((key, owner))
    owner, key, weight = owner[order], key[order], weight[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (key[1:] != key[:-1])
    first = np.nonzero(new)[0]
    owner, key = owner[first], key[first]
    weight = np.add.reduceat(weight, first) if len(first) else weight
    norm = np.sqrt(np.bincount(owner, weight**2, len(strings)))
    return owner, key, weight / norm[owner]


def _least_norm(length: int) -> float:
    """Norm of a string of that length without a repeated triple; no string has less."""
    return float(np.sqrt(sum(max(0, length - b) * DECAY ** (2 * (b + 1)) for _, b in _OFFSETS)))


class Landmarks:
    """Kernel values with a fixed list of strings."""

    def __init__(self, strings: list[str]):
        self.strings = strings
        owner, key, weight = _features(strings)
        order = np.lexsort((owner, key))
        self.owner, self.weight = owner[order], weight[order]
        self.keys, self.first = np.unique(key[order], return_index=True)
        self.first = np.append(self.first, len(order))
        # for words: letters that no landmark has are 0, and a triple's place in ``most`` has its largest weight
        letters = sorted(set("".join(strings)) | {START})
        self.base = len(letters) + 1
        self.letter = np.zeros(0x110000, dtype=np.int32)
        self.letter[[ord(c) for c in letters]] = np.arange(1, self.base)
        if self.base > MOST_LETTERS:  # too many for a table of all triples; keep fewer apart, which only raises the bound
            self.letter[self.letter > 0] = self.letter[self.letter > 0] % (MOST_LETTERS - 1) + 1
            self.base = MOST_LETTERS
        a, b, c = (self.letter[(self.keys >> at) & 0x1FFFFF].astype(np.int64) for at in (42, 21, 0))
        self.most = np.zeros(self.base**3, dtype=np.float32)
        if len(self.keys):
            np.maximum.at(self.most, (a * self.base + b) * self.base + c, np.maximum.reduceat(self.weight, self.first[:-1]).astype(np.float32))

    def _meet(self, owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """Inner products of n feature vectors with the landmarks."""
        m = len(self.strings)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        at, owner, weight = at[hit], owner[hit], weight[hit]
        size = self.first[at + 1] - self.first[at]
        stop = np.cumsum(size)
        place = np.repeat(self.first[at] - (stop - size), size) + np.arange(stop[-1] if len(stop) else 0)
        cell = np.repeat(owner * m, size) + self.owner[place]
        return np.bincount(cell, np.repeat(weight, size) * self.weight[place], n * m).reshape(n, m)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """The kernel of each string with each landmark."""
        if not strings or not len(self.keys):
            return np.zeros((len(strings), len(self.strings)))
        out = np.zeros((len(strings), len(self.strings)), dtype=np.float32)
        for a in range(0, len(strings), 5000):
            out[a : a + 5000] = self._meet(*_features(strings[a : a + 5000]), len(strings[a : a + 5000]))
        return out

    def near(self, words: list[str]) -> list[str]:
        """The words of which a window can have a kernel of FLOOR or more with some landmark.

        A window has no feature that its word hasn't, and no smaller norm than
        ``_least_norm``, which bounds its kernel. First each triple counts as for
        the landmark that has most of it, then the landmarks are told apart.
        """
        out: list[str] = []
        least = FLOOR * np.array([_least_norm(n) for n in range(SIZES[0] + 1)]) - 1e-5
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            sizes = np.array([len(w) + 1 for w in part])
            need = least[np.minimum(sizes, SIZES[0])]
            code = self.letter[np.frombuffer((START + ("\0" * SPAN + START).join(part) + "\0" * SPAN).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
            total = np.zeros(len(code), dtype=np.float32)
            two = code * self.base
            one = two * self.base
            for a, b in _OFFSETS:
                k = len(code) - b
                total[:k] += np.float32(DECAY ** (b + 1)) * self.most[one[:k] + two[a : a + k] + code[b:]]
            bound = np.add.reduceat(total, np.cumsum(sizes + SPAN) - sizes - SPAN)
            part = [part[i] for i in np.nonzero((bound >= need) & (sizes > 3))[0].tolist()]
            if part:
                exact = self._meet(*_triples([START + w for w in part]), len(part)).max(axis=1)
                need = least[np.minimum([len(w) + 1 for w in part], SIZES[0])]
                out += [part[i] for i in np.nonzero((exact >= need) & (exact > 0))[0].tolist()]
        return out


@dataclass
class Model:
    """What scoring needs; a few hundred KB whatever the corpus."""

    landmarks: list[str]
    weights: np.ndarray
    bias: float
    fit: np.ndarray  # logistic weights of evidence()

    def __post_init__(self) -> None:
        self.table: Landmarks | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"table": None}

    def margins(self, words: list[str]) -> dict[str, float]:
        """The margin of each word's most toxic window, of words with a window near a landmark."""
        if not self.landmarks:
            return {}
        self.table = self.table or Landmarks(self.landmarks)
        near = self.table.near(words)
        windows = sorted({v for w in near for v in windows_of(w)})
        value = self.table.kernel(windows)
        good = value.max(axis=1) >= FLOOR if len(windows) else np.empty(0, bool)
        margin = dict(zip((v for v, g in zip(windows, good, strict=True) if g), (value[good] @ self.weights + self.bias).tolist(), strict=True))
        found = ((w, [margin[v] for v in windows_of(w) if v in margin]) for w in near)
        return {w: max(m) for w, m in found if m}

    def probability(self, margin: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(evidence(margin, hits, words) @ self.fit, -500, 500)))


def hit(margin: float) -> float:
    """How far a word counts as a hit: from none at margin 0 to one at margin 1."""
    return min(1.0, max(0.0, margin))


def evidence(margin: np.ndarray, hits: np.ndarray, words: np.ndarray) -> np.ndarray:
    """What the logistic fit sees of documents: largest margin, hits, their share."""
    return np.stack([margin, np.log1p(hits), np.log((hits + 0.1) / (words + 50)), np.ones(len(margin))], axis=1)


def _telling(toxic: Counter, other: Counter, ratio: float, most: int) -> list[str]:
    """At most ``most`` windows that toxic documents have and others hardly do.

    ``toxic`` and ``other``: documents of each word. A window counts as its words
    do. Its count must be over eight times what the other class makes expected
    and beyond chance (deviance), in words that no window chosen before is in.
    """
    count: Counter = Counter()
    for w, n in toxic.items():
        for p in set(windows_of(w)):
            count[p] += n
    common = {p for p, n in count.items() if n >= 4}
    against: Counter = Counter()
    for w, n in other.items():
        for p in common.intersection(windows_of(w)):
            against[p] += n

    def deviance(p: str, n: int) -> float:
        expected = (against[p] + 0.5) * ratio
        return 2 * (n * np.log(n / expected) - (n - expected)) if n >= 4 and n > 8 * expected else 0.0

    found = {p: d for p in common if (d := deviance(p, count[p])) >= 25}
    holders: dict[str, list[str]] = {p: [] for p in sorted(found, key=lambda p: (-found[p], -len(p), p))}
    for w in toxic:
        for p in found.keys() & set(windows_of(w)):
            holders[p].append(w)
    explained, chosen = set(), []
    for p, words in holders.items():
        left = sum(toxic[w] for w in words if w not in explained)
        if len(chosen) < most and deviance(p, left) >= 25:
            explained.update(words)
            chosen.append(p)
    return chosen


def _svm(x: np.ndarray, y: np.ndarray, share: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by accelerated gradient steps; ``share`` weighs the rows and sums to 1."""
    sign = np.where(y > 0, 1.0, -1.0)
    gram = np.zeros((x.shape[1] + 1, x.shape[1] + 1))
    for at in range(0, len(x), 4096):
        z = np.hstack([x[at : at + 4096], np.ones((len(x[at : at + 4096]), 1))])
        gram += (z * share[at : at + 4096, None]).T @ z
    step = 1 / (2 * np.linalg.eigvalsh(gram)[-1] + penalty)
    w = look = np.zeros(x.shape[1] + 1)
    for t in range(1, rounds + 1):
        slack = share * sign * np.maximum(0, 1 - sign * (x @ look[:-1].astype(x.dtype) + look[-1]))
        grad = -2 * np.append(slack.astype(x.dtype) @ x, slack.sum()) + penalty * np.append(look[:-1], 0)
        new = look - step * grad
        look, w = new + (t - 1) / (t + 2) * (new - w), new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic fit with smoothed targets, a little held towards 0; toxic rows count MISSED times."""
    cost = np.where(y > 0, MISSED, 1.0)
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (cost * (p - t)) + 0.02 * w
        hess = (x * (cost * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 0.02 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 3.0 / max(1e-9, np.abs(step).max()))
    return w


def _mapped(value: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The Nystroem map of kernel rows in 32 bits, and a row of zeros for a document without any."""
    out = np.zeros((len(value) + 1, len(root)), dtype=np.float32)
    for at in range(0, len(value), 8192):
        out[at : at + len(value[at : at + 8192])] = value[at : at + 8192] @ root
    return out


def train(rows: list[tuple[str, int]], landmarks: int = LANDMARKS) -> Model:
    """A model of (text, label of the document) rows; equal rows count once.

    Without both classes, or without a telling window, every score is under 0.5.
    """
    bags = [(Counter(map(sys.intern, words_of(t))), y) for t, y in sorted(set(rows))]
    by_class: tuple[Counter, Counter] = (Counter(), Counter())
    for words, y in bags:
        by_class[y].update(words.keys())
    other, toxic = by_class
    n = Counter(y for _, y in bags)
    told = _telling(toxic, other, n[1] / n[0], landmarks * 3 // 4) if n[0] and n[1] else []
    if not told:
        return Model([], np.zeros(0), -1.0, np.array([0.0, 0.0, 0.0, -1.0]))
    # windows near a telling one; of the other class' the commonest are landmarks too
    table = Landmarks(told)
    near = table.near(sorted(toxic.keys() | other.keys()))
    windows = sorted({v for w in near for v in windows_of(w)})
    close = table.kernel(windows).max(axis=1) >= FLOOR
    plain: Counter = Counter()
    for w in near:
        for v in windows_of(w):
            plain[v] += other[w]
    told += [v for v, _ in sorted(((v, plain[v]) for v, c in zip(windows, close, strict=True) if c and plain[v] and v not in told), key=lambda p: (-p[1], p[0]))][: landmarks - len(told)]
    table = Landmarks(told)
    near = table.near(sorted(toxic.keys() | other.keys()))
    windows = sorted({v for w in near for v in windows_of(w)})
    value = table.kernel(windows)
    good = value.max(axis=1) >= FLOOR
    windows, value = [v for v, g in zip(windows, good, strict=True) if g], value[good]
    place = {v: i for i, v in enumerate(windows)}
    val, vec = np.linalg.eigh(table.kernel(told))
    root = vec @ np.diag(1 / np.sqrt(np.maximum(val, 1e-2))) @ vec.T
    nothing = len(windows)  # a document without a window near a landmark
    x = _mapped(value, root)
    del value
    gapped = _mapped(table.kernel([f"{v[: len(v) // 2]}\x01{v[len(v) // 2 :]}" for v in windows]), root)
    of_word = {w: [place[v] for v in windows_of(w) if v in place] for w in near}
    inside = [sorted({i for w in words if w in of_word for i in of_word[w]}) or [nothing] for words, _ in bags]
    against = np.zeros(len(x))
    for ids, (_, y) in zip(inside, bags, strict=True):
        if y == 0:
            against[ids] += 1
    rows_0 = np.nonzero(against)[0]
    share_0 = 0.5 * against[rows_0] / against.sum()
    positive = [ids for ids, (_, y) in zip(inside, bags, strict=True) if y == 1]
    weights, bias = None, 0.0
    for _ in range(ROUNDS):
        witness: Counter = Counter()
        for ids in positive:
            f = np.zeros(len(ids)) if weights is None else x[ids] @ weights + bias
            witness.update(i for i, v in zip(ids, f.tolist(), strict=True) if v >= min(0.0, f.max()))
        ids, times = np.array(list(witness)), np.array(list(witness.values()), dtype=float)
        share_1 = 0.25 * times / times.sum()
        y = np.repeat([0, 1, 1], [len(rows_0), len(ids), len(ids)])
        weights, bias = _svm(np.vstack([x[rows_0], x[ids], gapped[ids]]), y, np.concatenate([share_0, share_1, share_1]))
    model = Model(told, root @ weights, bias, np.zeros(4))
    margin = model.margins(near)
    top = np.array([max([bias, *(margin[w] for w in words if w in margin)]) for words, _ in bags])
    hits = np.array([sum(c * hit(margin[w]) for w, c in words.items() if w in margin) for words, _ in bags])
    total = np.array([sum(words.values()) for words, _ in bags])
    label = np.array([y for _, y in bags])
    some = (label == 0) | (hits >= 0.5)  # a toxic document without a hit tells nothing of how evidence counts
    model.fit = _logistic(evidence(top, hits, total)[some], label[some])
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED, doc_chars: int = DOC_CHARS, landmarks: int = LANDMARKS) -> Model:
    """Trains on at most ``labelled`` documents of each class, chosen by their id's hash.

    Of those, documents of more than ``doc_chars`` characters are left out, so
    the sample that reaches the driver is bounded in bytes. The chosen ids are so
    few that they are broadcast: no text is shuffled to meet its label. Null
    texts, null labels and labels other than 0 and 1 are not used; of an id with
    several labels each counts.
    """
    known = labels.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{label_col}`").cast("int").alias("y"))
    part = lambda y: known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("k"), "k").limit(labelled)
    rows = docs.select(F.col(f"`{id_col}`").alias("k"), F.col(f"`{text_col}`").alias("t")).where(F.length("t").between(1, doc_chars))
    taken = rows.join(F.broadcast(part(0).union(part(1))), "k").select("t", "y")
    return train([(r["t"], r["y"]) for r in taken.toLocalIterator()], landmarks)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, score), or ``keep`` (new name -> column) and score, one row for each row of ``docs``.

    Whole texts are scored; null and empty texts have no window and get the
    score of a text without any match. Repeated rows get equal scores. Only the
    text enters a score. An empty table gives an empty one.
    """

    def make() -> Callable[[list[str]], dict]:
        seen: set[str] = set()
        margin: dict[str, float] = {}

        def run(texts: list[str]) -> dict:
            top, hits, total = np.full(len(texts), model.bias), np.zeros(len(texts)), np.zeros(len(texts))
            for at in range(0, len(texts), 500):
                split = [words_of(t) for t in texts[at : at + 500]]
                if len(seen) > SEEN:
                    seen.clear()
                    margin.clear()
                fresh = list(set().union(*split) - seen)
                margin.update(model.margins(fresh))
                seen.update(fresh)
                for i, words in enumerate(split, at):
                    total[i] = len(words)
                    found = [margin[w] for w in words if w in margin]
                    if found:
                        top[i] = max(model.bias, *found)
                        hits[i] = sum(map(hit, found))
            return {"score": model.probability(top, hits, total)}

        return run

    return map_texts(docs, keep or {"doc_id": id_col}, text_col, make, "score double")
