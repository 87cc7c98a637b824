"""Token ids of whole texts with a public tokenizer, cached by word."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

END_ID = 0


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of texts as unsigned 32-bit arrays.

    A byte-level BPE never joins a blank to the non-blank before it, so a text
    may be cut before each blank that lies between non-blanks: the parts' ids in
    a row are the text's ids. Parts repeat, so each is encoded once and kept in
    one long array. A text with a part of white space only (two blanks in a row,
    a blank at an end) is encoded whole. Beyond ``limit`` parts the cache keeps
    those that came again; texts go through in steps of about ``step_chars`` characters.
    """

    def __init__(self, path: str, limit: int = 400_000, step_chars: int = 1_500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.limit, self.step_chars = Tokenizer.from_file(path), limit, step_chars
        vocabulary = self.model.get_vocab(with_added_tokens=True)
        self.leads = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.leads[[i for word, i in vocabulary.items() if word.startswith("\u0120")]] = True  # how the vocabulary writes a blank
        self._clear()

    def _clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.ids = np.empty(1 << 20, dtype=np.uint32)
        self.starts, self.used = np.zeros(self.limit + 1, dtype=np.int64), 0
        self.again = np.zeros(self.limit + 1, dtype=bool)

    def _shrink(self) -> None:
        """Keeps the parts that came again since the last time, if they are half at most."""
        kept = np.nonzero(self.again[: len(self.slots)])[0]
        words, starts, ids = list(self.slots), self.starts, self.ids
        self._clear()
        if len(kept) <= self.limit // 2:
            sizes = starts[kept + 1] - starts[kept]
            ends = np.cumsum(sizes)
            if len(kept):
                self._keep([words[i] for i in kept.tolist()], ids[np.repeat(starts[kept] - (ends - sizes), sizes) + np.arange(ends[-1])], ends)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _append(self, ids: np.ndarray) -> None:
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.empty_like(self.ids)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, parts: list[str]) -> None:
        """Encodes new parts; those that begin with a blank many at a time."""
        blanks = [p for p in parts if p[0] == " "]
        for at in range(0, len(blanks), 8000):
            some = blanks[at : at + 8000]
            found = self.model.encode_batch_fast(["".join(some[i : i + 50]) for i in range(0, len(some), 50)], add_special_tokens=False)
            ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in found])
            starts = np.nonzero(self.leads[ids])[0]  # only a part's first token begins with a blank
            if len(starts) == len(some):
                self._keep(some, ids, np.append(starts[1:], len(ids)))
            else:
                each = self.whole(some)
                self._keep(some, np.concatenate(each), np.cumsum([len(x) for x in each]))
        heads = [p for p in parts if p[0] != " "]
        if heads:
            each = self.whole(heads)
            self._keep(heads, np.concatenate(each), np.cumsum([len(x) for x in each]))

    def _keep(self, parts: list[str], ids: np.ndarray, ends: np.ndarray) -> None:
        base = len(self.slots)
        while base + len(parts) >= len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.again = np.concatenate([self.again, np.zeros_like(self.again)])
        self.starts[base + 1 : base + 1 + len(parts)] = ends + self.used
        self._append(ids)
        self.slots.update(zip(parts, range(base, base + len(parts)), strict=True))

    def _slots_of(self, parts: list[str]) -> np.ndarray:
        """Slots of distinct parts, new ones learnt."""
        get = self.slots.get
        at = np.array([get(p, -1) for p in parts], dtype=np.int64)
        new = np.nonzero(at < 0)[0]
        self.again[at[at >= 0]] = True
        if len(new):
            base = len(self.slots)
            fresh = [parts[i] for i in new.tolist()]
            fresh = [p for p in fresh if p[0] == " "] + [p for p in fresh if p[0] != " "]
            self._learn(fresh)
            if len(fresh) == len(parts) and fresh[0][0] == " " == fresh[-1][0]:
                return np.arange(base, base + len(parts))
            at[new] = [self.slots[parts[i]] for i in new.tolist()]
        return at

    def _step(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.slots) > self.limit:
            self._shrink()
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        bounds = np.asarray(split.offsets)
        coded = split.flatten().dictionary_encode()
        codes, words = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        blank = np.array([not w or w.isspace() for w in words], dtype=bool)
        slots = np.zeros(len(words), dtype=np.int64)
        if not blank.all():
            full = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), coded.dictionary.filter(pa.array(~blank)), pa.scalar(" ", pa.large_string()))
            slots[~blank] = self._slots_of(full.to_numpy(zero_copy_only=False).tolist())
        odd, slot = blank[codes], slots[codes]
        heads = [words[c] for c in codes[bounds[:-1]].tolist()]  # a text's first part has no blank before it
        filled = np.array([bool(h) and not h.isspace() for h in heads], dtype=bool)
        at = bounds[:-1]
        if filled.any():
            own = list(dict.fromkeys(h for h in heads if h and not h.isspace()))
            place = dict(zip(own, self._slots_of(own).tolist(), strict=True))
            slot[at[filled]] = [place[h] for h in heads if h and not h.isspace()]
        empty = np.array([not h for h in heads], dtype=bool)
        odd[at] = ~(filled | empty)
        lens = self.starts[slot + 1] - self.starts[slot]
        lens[at[empty]] = 0
        stops = np.cumsum(lens)
        flat = self.ids[np.repeat(self.starts[slot] - (stops - lens), lens) + np.arange(stops[-1])]
        ends = stops[bounds[1:] - 1].tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        whole = np.nonzero(np.logical_or.reduceat(odd, at))[0].tolist()
        for i, ids in zip(whole, self.whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        step: list[str] = []
        chars = 0
        for t in texts:
            step.append(t)
            chars += len(t)
            if chars >= self.step_chars:
                out += self._step(step)
                step, chars = [], 0
        return out + self._step(step) if step else out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
