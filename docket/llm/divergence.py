"""Source divergence audit over a minimal acyclic transducer vocabulary.

1. Terms are counted by documents in each language; those in ``MIN_DOCS`` or more
   are kept and numbered in byte order (their ordinals) without a global sort.
2. Consecutive runs of ``SHARD_TERMS`` kept terms become minimal acyclic
   transducers, each built in one task from its sorted terms. An edge's output is
   the number of terms that come before it at its state, so the outputs along a
   path add up to the term's ordinal.
3. Texts stream through the transducers as bytes: all terms of a batch step at
   once, byte by byte. Transducers go to the tasks in rounds of ``ROUND_BYTES``,
   counted before, so what is broadcast is bounded at any size of the vocabulary.
4. Counts by language, source and ordinal give exact shares and divergences;
   pairs of sources are summed over blocks of ordinals and tiles of sources.
   Ordinals break ties of terms.
"""

from __future__ import annotations

import io
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.groups import key_groups
from docket.operators.ordering import in_order
from docket.session import cut, ship_package

MIN_DOCS = 10
SHARD_TERMS = 100_000
ROUND_BYTES = 64_000_000
SCALE = 1_000_000_000
TOP = 10
#: Ordinals in a block and sources in a tile of the pairwise sums.
BLOCK, TILE = 2048, 64
HELD_TERMS = 300_000
HELD_COUNTS = 2_000_000
ROWS = 500
#: Bytes of text that step through the transducers together, but for one longer text.
STEP_BYTES = 4_000_000

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
TERM = re.compile(rb"[a-z\x80-\xff]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- the transducer -----------------------------------------------------------------


def build_transducer(terms: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic transducer of sorted, different, non-empty terms: term to place among them.

    States with equal futures are one. Edges lie in a hash table: ``keys`` (state
    and byte, -1 if free), ``target`` and ``output``; ``final`` marks states, and
    ``root`` is where a term begins.
    """
    register: dict[tuple, int] = {}
    path: list[list] = [[False, []]]
    before = b""

    def close(down_to: int) -> None:
        for depth in range(len(before), down_to, -1):
            done = path.pop()
            path[-1][1].append((before[depth - 1], register.setdefault((done[0], tuple(done[1])), len(register))))

    for term in terms:
        shared = 0
        for x, y in zip(before, term, strict=False):
            if x != y:
                break
            shared += 1
        close(shared)
        path.extend([False, []] for _ in range(len(term) - shared))
        path[-1][0] = True
        before = term
    close(0)
    root = register.setdefault((path[0][0], tuple(path[0][1])), len(register))
    keys, target, output = [], [], []
    below, final = np.zeros(len(register), np.int64), np.zeros(len(register), bool)
    for state, (ends, edges) in enumerate(register):  # children are registered before their parents
        n = int(ends)
        for byte, to in edges:
            keys.append(state << 8 | byte)
            target.append(to)
            output.append(n)
            n += int(below[to])
        below[state], final[state] = n, ends
    return _table(np.array(keys, np.int64), np.array(target, np.int32), np.array(output, np.int32)) | {"final": final, "root": np.array([root], np.int64)}


def _home(keys: np.ndarray, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys.astype(np.uint64) * _MIX) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)


def _table(keys: np.ndarray, target: np.ndarray, output: np.ndarray) -> dict[str, np.ndarray]:
    size = 1 << max(4, int(2 * len(keys)).bit_length())
    table = {"keys": np.full(size, -1, np.int64), "target": np.zeros(size, np.int32), "output": np.zeros(size, np.int32)}
    todo, at = np.arange(len(keys)), _home(keys, size)
    while len(todo):
        free = table["keys"][at[todo]] < 0
        _, one = np.unique(at[todo[free]], return_index=True)
        lucky = todo[free][one]
        table["keys"][at[lucky]], table["target"][at[lucky]], table["output"][at[lucky]] = keys[lucky], target[lucky], output[lucky]
        todo = np.setdiff1d(todo, lucky, assume_unique=True)
        at[todo] = (at[todo] + 1) & (size - 1)
    return table


def _edges(fst: dict[str, np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Place of each edge in the table, -1 where there is none."""
    size = len(fst["keys"])
    at, found, todo = _home(keys, size), np.full(len(keys), -1, np.int64), np.arange(len(keys))
    while len(todo):
        there = fst["keys"][at[todo]]
        hit = there == keys[todo]
        found[todo[hit]] = at[todo[hit]]
        todo = todo[~hit & (there >= 0)]
        at[todo] = (at[todo] + 1) & (size - 1)
    return found


def ordinals(fst: dict[str, np.ndarray], text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For each term (start and length in the bytes ``text``) its place, or -1 if the transducer rejects it."""
    place, state = np.zeros(len(start), np.int64), np.full(len(start), fst["root"][0], np.int64)
    out, on, step = np.full(len(start), -1, np.int64), np.nonzero(length > 0)[0], 0
    while len(on):
        edge = _edges(fst, state[on] << 8 | text[start[on] + step])
        on, edge = on[edge >= 0], edge[edge >= 0]
        state[on] = fst["target"][edge]
        place[on] += fst["output"][edge]
        step += 1
        last = length[on] == step
        ends = on[last]
        ends = ends[fst["final"][state[ends]]]
        out[ends] = place[ends]
        on = on[~last]
    return out


def pack(fst: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **fst)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def terms_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of letters and non-ASCII bytes in lower-cased bytes."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = ((text >= 97) & (text <= 122)) | (text >= 128)
    turns = np.diff(inside)
    start = np.nonzero(turns == 1)[0]
    return start, np.nonzero(turns == -1)[0] - start


# --- passes over the texts ----------------------------------------------------------


def _documents(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name) for c, name in ((lang, "lang"), (source, "source"), (text, "text"))])


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield [c.to_pylist() for c in b.slice(at, ROWS).columns]


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, ord): the terms in ``min_docs`` documents of a language or more, numbered from 0 in byte order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str, bytes]] = Counter()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["lang", "term", "n"])

        for langs, texts in _slices(batches):
            for lang, text in zip(langs, texts, strict=True):
                held.update((lang, term) for term in set(TERM.findall(text.encode().translate(LOWER))))
                if len(held) > HELD_TERMS:
                    yield flush()
        if held:
            yield flush()

    counted = docs.select("lang", "text").mapInArrow(run, "lang string, term binary, n long")
    kept = counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")
    placed = in_order(kept, "lang", "term", pos="place")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    return cut(placed.join(first, "lang").select("lang", "term", (F.col("place") - F.col("first")).alias("ord")))


def transducers(kept: DataFrame) -> DataFrame:
    """(lang, shard, base, low, high, fst, bytes): a transducer for each run of terms, its first ordinal and the range of first bytes."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, ["lang", "shard"]):
            terms = [bytes(t) for t in g["term"]]
            data = pack(build_transducer(terms))
            yield pd.DataFrame({"lang": [g["lang"].iloc[0]], "shard": [g["shard"].iloc[0]], "base": [g["ord"].iloc[0]], "low": [terms[0][0]], "high": [terms[-1][0]], "fst": [data], "bytes": [len(data)]})

    sharded = kept.withColumn("shard", F.floor(F.col("ord") / SHARD_TERMS).cast("long"))
    dealt = sharded.repartition("lang", "shard").sortWithinPartitions("lang", "shard", "ord")
    return cut(dealt.mapInPandas(run, "lang string, shard long, base long, low int, high int, fst binary, bytes long"))


def recount(docs: DataFrame, fsts: DataFrame) -> DataFrame:
    """(lang, source, ord, n): occurrences of each kept term in each source, from texts streamed through the transducers.

    One pass over the texts for each ROUND_BYTES of transducers.
    """
    spark = docs.sparkSession
    running = F.sum("bytes").over(W.orderBy("lang", "shard").rowsBetween(W.unboundedPreceding, -1))
    rounds = cut(fsts.select("lang", "shard", F.floor(F.coalesce(running, F.lit(0)) / ROUND_BYTES).alias("round")))
    out = None
    for n in range((rounds.agg(F.max("round")).first()[0] if not fsts.isEmpty() else -1) + 1):
        held: dict[str, list] = {}
        for r in fsts.join(rounds.where(F.col("round") == n), ["lang", "shard"]).collect():  # ROUND_BYTES and one transducer at most
            held.setdefault(r["lang"], []).append((r["base"], r["low"], r["high"], bytes(r["fst"])))
        share = spark.sparkContext.broadcast(held)

        def run(batches: Iterable[pa.RecordBatch], share=share) -> Iterator[pa.RecordBatch]:
            fst_of = {lang: [(base, low, high, unpack(data)) for base, low, high, data in found] for lang, found in share.value.items()}
            tally = _Tally()
            for langs, sources, texts in _slices(batches):
                by_lang: dict[str, list[int]] = {}
                for i, lang in enumerate(langs):
                    if lang in fst_of:
                        by_lang.setdefault(lang, []).append(i)
                for lang, rows in by_lang.items():
                    for some in _portions(rows, texts):
                        tally.add(lang, [sources[i] for i in some], [texts[i].encode() for i in some], fst_of[lang])
                if tally.size > HELD_COUNTS:
                    yield tally.flush()
            if tally.size:
                yield tally.flush()

        part = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, ord long, n long")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "lang string, source string, ord long, n long")
    return cut(out.groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")))


def _portions(rows: list[int], texts: list[str]) -> Iterator[list[int]]:
    """``rows`` in runs whose texts have about STEP_BYTES together."""
    some, size = [], 0
    for i in rows:
        some.append(i)
        size += len(texts[i])
        if size > STEP_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


class _Tally:
    """Counts of a task: for each language the sources' numbers and (source, ordinal) keys with their counts."""

    def __init__(self) -> None:
        self.sources: dict[str, dict[str, int]] = {}
        self.found: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, sources: list[str], texts: list[bytes], fsts: list) -> None:
        """Streams ``texts`` through the transducers of their language."""
        numbers = self.sources.setdefault(lang, {})
        of_text = np.array([numbers.setdefault(s, len(numbers)) for s in sources], np.int64)
        text = np.frombuffer(b"\n".join(texts).translate(LOWER), np.uint8)
        start, length = terms_of(text)
        whose = of_text[np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), start, side="right")]
        for base, low, high, fst in fsts:
            mine = np.nonzero((text[start] >= low) & (text[start] <= high))[0] if len(fsts) > 1 else np.arange(len(start))
            place = ordinals(fst, text, start[mine], length[mine])
            hit = place >= 0
            keys, counts = np.unique((whose[mine[hit]] << 40) | (place[hit] + base), return_counts=True)
            self.found.setdefault(lang, []).append((keys, counts))
            self.size += len(keys)
        if len(self.found[lang]) >= 32:
            self._merge(lang)

    def _merge(self, lang: str) -> None:
        keys, back = np.unique(np.concatenate([k for k, _ in self.found[lang]]), return_inverse=True)
        counts = np.bincount(back, np.concatenate([c for _, c in self.found[lang]]), len(keys)).astype(np.int64)
        self.size += len(keys) - sum(len(k) for k, _ in self.found[lang])
        self.found[lang] = [(keys, counts)]

    def flush(self) -> pa.RecordBatch:
        columns: list[list] = [[], [], [], []]
        for lang in self.found:
            self._merge(lang)
            keys, counts = self.found[lang][0]
            names = pa.array(list(self.sources[lang]), pa.string())
            columns[0].append(pa.array([lang], pa.string()).take(pa.array(np.zeros(len(keys), np.int64))))
            columns[1].append(names.take(pa.array(keys >> 40)))
            columns[2].append(pa.array(keys & ((1 << 40) - 1)))
            columns[3].append(pa.array(counts))
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in columns], names=["lang", "source", "ord", "n"])


# --- divergences --------------------------------------------------------------------


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)), by three digits at a time so that nothing overflows."""
    rest, whole, out = count + F.lit(2), n + F.lit(2) * v, F.lit(0).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    for _ in range(3):
        rest = rest * F.lit(1000)
        out = out * F.lit(1000) + div(rest, whole)
        rest = rest % whole
    return out + F.lit(1)


def _shares(count: np.ndarray, n: np.ndarray, v: int) -> np.ndarray:
    """``_share`` for arrays."""
    rest, whole, out = count + 2, n + 2 * v, np.int64(0)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // whole
        rest = rest % whole
    return out + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(docs: DataFrame, kept: DataFrame, counts: DataFrame) -> DataFrame:
    """(lang, source, v, n, n_lang, no): every group with its language's kept terms, both counts and its number in the language."""
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    n = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    found = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(n, ["lang", "source"], "left").fillna(0, ["v", "n"])
    in_lang = W.partitionBy("lang")
    return cut(found.withColumns({"n_lang": F.sum("n").over(in_lang), "no": F.row_number().over(in_lang.orderBy("source")) - 1}))


def pair_corrections(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, low, high, more): for two sources, the divergences summed over terms less what two absent terms would give each."""
    tiles = F.floor(F.col("no") / TILE).cast("int")
    numbered = counts.join(groups.select("lang", "source", "no"), ["lang", "source"])
    terms = numbered.select("lang", F.floor(F.col("ord") / BLOCK).alias("block"), tiles.alias("tile"), "no", "ord", F.col("n").alias("count"))
    blocks = groups.where("v > 0").groupBy("lang").agg(F.max("v").alias("v"), F.max(tiles).alias("most"))
    blocks = blocks.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("v") - 1) / BLOCK))).alias("block"))
    # each source stands in each block with its sum, also without terms there
    there = groups.where("v > 0").join(blocks, "lang").select("lang", "block", tiles.alias("tile"), "no", F.lit(-1).cast("long").alias("ord"), F.col("n").alias("count"))
    most = groups.groupBy("lang").agg(F.max(tiles).alias("most"), F.max("v").alias("v"))
    rows = terms.unionAll(there).join(most, "lang").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("most"))))
    rows = rows.select("lang", "block", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "v", "no", "ord", "count")
    keys = ["lang", "block", "a", "b"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, keys):
            no, order, count = (g[c].to_numpy() for c in ("no", "ord", "count"))
            who = order < 0
            sources, v = no[who], int(g["v"].iloc[0])
            ranks = np.argsort(sources)
            sources, n = sources[ranks], count[who][ranks]
            terms, column = np.unique(order[~who], return_inverse=True)
            if not len(terms) or len(sources) < 2:
                continue
            table = np.zeros((len(sources), len(terms)), np.int64)
            table[np.searchsorted(sources, no[~who]), column] = count[~who]
            p, absent = _shares(table, n[:, None], v), _shares(np.zeros(len(n), np.int64), n, v)
            across = g["a"].iloc[0] != g["b"].iloc[0]
            low, high, more = [], [], []
            for i in range(len(sources) - 1):
                later = np.arange(i + 1, len(sources))
                if across:
                    later = later[sources[later] // TILE != sources[i] // TILE]
                if not len(later):
                    continue
                d, d0 = p[later] - p[i], absent[later] - absent[i]
                found = (d * d // (p[later] + p[i])).sum(axis=1) - len(terms) * (d0 * d0 // (absent[later] + absent[i]))
                low.append(np.full(len(later), sources[i]))
                high.append(sources[later])
                more.append(found)
            if low:
                yield pd.DataFrame({"lang": g["lang"].iloc[0], "low": np.concatenate(low), "high": np.concatenate(high), "more": np.concatenate(more)})

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys)
    parts = dealt.mapInPandas(run, "lang string, low long, high long, more long")
    return parts.groupBy("lang", "low", "high").agg(F.sum("more").alias("more"))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others, and which terms set it apart.

    Part ``pair``: each other source of the language and the divergence of the two
    over all kept terms. Part ``term``: the TOP kept terms that the source has
    relatively more often than its language. A row is a document; null texts,
    languages and sources are empty strings. A language without kept terms has
    pairs of value 0 and no terms; a source alone in its language has no pairs. Ties
    go by bytes of the item. Other columns are not read; an empty table gives no rows.
    """
    ship_package(docs.sparkSession)
    rows = _documents(docs, text, lang, source)
    kept = kept_terms(rows, min_docs)
    counts = recount(rows, transducers(kept))
    groups = _groups(rows, kept, counts)
    rank = lambda tie: F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), tie))

    in_lang = counts.groupBy("lang", "ord").agg(F.sum("n").alias("m"))
    both = counts.join(in_lang, ["lang", "ord"]).join(groups.select("lang", "source", "v", F.col("n").alias("total"), "n_lang"), ["lang", "source"])
    both = both.withColumns({"p": _share(F.col("n"), F.col("total"), F.col("v")), "q": _share(F.col("m"), F.col("n_lang"), F.col("v"))}).where("p > q")
    terms = both.withColumn("value", _apart(F.col("p"), F.col("q"))).withColumn("rank", rank("ord")).where(F.col("rank") <= TOP)
    terms = terms.join(kept, ["lang", "ord"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank")

    a = groups.select("lang", "source", "v", "n", "no")
    b = groups.select("lang", F.col("source").alias("item"), F.col("n").alias("n_b"), F.col("no").alias("no_b"))
    pairs = a.join(b, "lang").where("no <> no_b").withColumns({"low": F.least("no", "no_b").cast("long"), "high": F.greatest("no", "no_b").cast("long")})
    pairs = pairs.join(pair_corrections(counts, groups), ["lang", "low", "high"], "left")
    zero, some = F.lit(0).cast("long"), F.greatest("v", F.lit(1).cast("long"))
    flat = F.col("v") * _apart(_share(zero, F.col("n"), some), _share(zero, F.col("n_b"), some))
    pairs = pairs.withColumn("value", F.when(F.col("v") > 0, flat + F.coalesce("more", zero)).otherwise(zero)).withColumn("rank", rank("item"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank").unionAll(terms)
