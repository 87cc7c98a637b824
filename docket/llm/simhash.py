"""SimHash near-duplicate detection with pivot distance tables.

1. Each document gets a 64-bit fingerprint of its word shingles; equal
   fingerprints collapse to one row at once, so copies cost nothing further.
2. Each distinct fingerprint gets a row of the pivot distance table: its Hamming
   distances to reference fingerprints that a fixed rule makes.
3. Fingerprints meet in blocks: cut into g bands, two that differ in at most
   ``bits`` of them agree on g - bits bands (pigeonhole), so blocks lose no
   link. g follows from the number of fingerprints, so that blocks stay small.
4. In a block, a pair whose pivot distances differ by more than ``bits`` in any
   coordinate is discarded (triangle inequality), the others are verified. A
   block is walked breadth-first, each fingerprint against those not reached
   yet, and only links to its component's smallest fingerprint leave it: never
   all pairs. A block beyond ``BLOCK`` rows is dealt into chunks and every pair
   of chunks is walked, so nothing is capped.
5. Links become components, components the smallest doc_id.

``representatives`` removes near-duplicates at a similarity of word shingles, for
which 64 bits are too few: copies at 0.8 differ in ten of them, and bands of the
few bits that then agree would hold nearly everything. It takes fingerprints of
1024 bits, whose distance estimates the similarity, and blocks by the smallest
hashes. What the estimate brings together is verified on the sets of shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docket.llm.columns import numbered
from docket.llm.components import connected_components
from docket.llm.groups import key_groups
from docket.llm.texts import map_texts
from docket.session import cut

PIVOTS = 12
BLOCK = 4096
TARGET_BLOCK = 64
WIDE_WORDS = 16  # of 64 bits, for similarities that 64 bits can't tell apart
KEYS = 6
MARGIN = 0.054  # two standard errors of the estimated similarity at 0.8
SET_BYTES = 16_000_000  # of shingle hashes in a chunk of texts that are verified together


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """The XXH64 (seed 42) of the text's word shingles, repeats included; of fewer words the whole sequence, of none nothing."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII blanks only
    if not words:
        return np.empty(0, dtype="<u8")
    line, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[width - 1 :] - 1).tolist() if len(words) >= width else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, stops, strict=True)), dtype="<u8", count=n)


def fingerprint(text: str | None, width: int = 4) -> int:
    """Majority bits over the hashes of the text's word shingles."""
    hashes = shingle_hashes(text, width)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        bits = np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long; empty and null texts have 0."""
    def make() -> Callable[[list[str]], dict]:
        return lambda texts: {"fp": np.array([fingerprint(t, width) for t in texts], dtype=np.uint64).view(np.int64)}

    return map_texts(docs, {"doc_id": id_col}, text_col, make, "fp long")


def pivots(n: int = PIVOTS) -> list[int]:
    """Reference fingerprints: the XXH64 of 0, 1, ... as signed longs."""
    return [int(np.uint64(xxhash.xxh64_intdigest(str(i), 7)).view(np.int64)) for i in range(n)]


def bands(count: int, bits: int) -> int:
    """Number of bands so that blocks of ``count`` random fingerprints stay small."""
    g = bits + 1
    while g < 2 * bits + 4 and 2 ** (64 * (g - bits) // g) * TARGET_BLOCK < count:
        g += 1
    return g


def band_keys(fp: Column, g: int, bits: int) -> list[Column]:
    """One key for each choice of g - bits bands: its number and those bands' bits."""
    cuts = [64 * i // g for i in range(g + 1)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = []
    for chosen in combinations(range(g), g - bits):
        mask = sum(masks[i] for i in chosen)
        signed = int(np.uint64(mask).view(np.int64))
        out.append(F.struct(F.lit(len(out)).alias("band"), fp.bitwiseAND(F.lit(signed)).alias("part")))
    return out


def _links(fp: np.ndarray, table: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints that have a link in this block, and the smallest of their component."""
    left = np.argsort(table[:, 0], kind="stable")  # not reached yet, by distance to the first pivot
    found: list[tuple[np.ndarray, int]] = []
    while len(left) > 1:
        members, front, left = [left[:1]], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            first, here = table[left, 0], int(table[x, 0])
            lo, hi = np.searchsorted(first, here - bits, "left"), np.searchsorted(first, here + bits, "right")
            near = left[lo:hi]
            for k in range(1, table.shape[1]):
                if not len(near):
                    break
                near = near[np.abs(table[near, k] - table[x, k]) <= bits]
            near = near[np.bitwise_count(fp[near] ^ fp[x]) <= bits]
            if len(near):
                members.append(near)
                front.extend(near.tolist())
                left = left[~np.isin(left, near)]
        group = np.concatenate(members)
        if len(group) > 1:
            found.append((fp[group], int(fp[group].view(np.int64).min())))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    u = np.concatenate([g for g, _ in found]).view(np.int64)
    return u, np.concatenate([np.full(len(g), m, np.int64) for g, m in found])


def fingerprint_links(fps: DataFrame, bits: int = 4) -> DataFrame:
    """Links (u, v) that connect what ``bits`` or fewer differing bits connect.

    ``fps``: distinct fp. The links are a spanning set: two fingerprints within
    ``bits`` are connected by them, though not always directly.
    """
    refs = pivots()
    names = [f"p{i}" for i in range(len(refs))]
    table = fps.select("fp", *[F.bit_count(F.col("fp").bitwiseXOR(F.lit(r))).cast("short").alias(n) for n, r in zip(names, refs, strict=True)])
    g = bands(fps.count(), bits)
    keyed = table.withColumn("key", F.explode(F.array(*band_keys(F.col("fp"), g, bits)))).select("key.band", "key.part", "fp", *names)
    large = keyed.groupBy("band", "part").count().where(F.col("count") > BLOCK).withColumn("chunks", F.ceil(F.col("count") / (BLOCK // 2)).cast("int")).drop("count")
    keyed = keyed.join(large, ["band", "part"], "left")
    own = F.pmod(F.xxhash64("fp", F.lit(3)), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(own, o) * F.col("chunks") + F.greatest(own, o))
    keyed = keyed.withColumn("pair", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(-1))).otherwise(pair))).drop("chunks")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in key_groups(batches, ["band", "part", "pair"]):
            if len(group) > 1:
                u, v = _links(group["fp"].to_numpy().view(np.uint64), group[names].to_numpy(np.int16), bits)
                if len(u):
                    yield pd.DataFrame({"u": u, "v": v})

    dealt = keyed.repartition("band", "part", "pair").sortWithinPartitions("band", "part", "pair")
    return dealt.mapInPandas(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id), one row for each row of ``docs``.

    Documents are linked when their fingerprints differ in at most ``bits``
    bits; component_id is the smallest doc_id that links reach, itself included.
    Null and empty texts have fingerprint zero and are linked like any other.
    A null doc_id keeps its row; a component whose ids are all null has a null
    component_id. Repeated rows stay repeated. An empty table gives an empty
    one. Other columns of ``docs`` are not read.
    """
    rows = cut(fingerprints(docs, id_col, text_col, width))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(fps.select("fp"), bits))
    named = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "component").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")


def _mixed(hashes: np.ndarray) -> np.ndarray:
    """Each hash as WIDE_WORDS words of independent bits."""
    x = hashes[:, None] + np.arange(1, WIDE_WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, width: int = 5) -> tuple[bytes, int, np.ndarray]:
    """(wide fingerprint, number of different shingles, the smallest KEYS of their hashes)."""
    hashes = np.unique(shingle_hashes(text, width))
    ones = np.zeros(64 * WIDE_WORDS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(_mixed(hashes[at : at + 4096]).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), len(hashes), hashes[:KEYS].view(np.int64)


def similarity_of(distance: np.ndarray, n: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of sets of n and other shingles whose wide fingerprints differ in that many bits."""
    shared = np.clip(np.cos(np.pi * distance / (64 * WIDE_WORDS)), 0, 1) * np.sqrt(n * other)
    return shared / np.maximum(n + other - shared, 1e-9)


def _similar_links(node: np.ndarray, fp: np.ndarray, n: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a block that are alike, and the smallest of their component in it.

    Walked breadth-first by size: only sets of a size within the similarity can be
    alike, and of those the pivot distance table discards what the triangle
    inequality rules out; the others are verified.
    """
    most = 64 * WIDE_WORDS * np.arccos(min(1.0, 2 * least / (1 + least))) / np.pi  # at equal sizes, the largest
    refs = _mixed(np.arange(PIVOTS, dtype=np.uint64))
    table = np.stack([np.bitwise_count(fp ^ r).sum(axis=1, dtype=np.int32) for r in refs], axis=1)
    left = np.argsort(n, kind="stable")
    found: list[np.ndarray] = []
    while len(left) > 1:
        members, front, left = [left[:1]], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            lo, hi = np.searchsorted(n[left], n[x] * least, "left"), np.searchsorted(n[left], n[x] / least, "right")
            near = left[lo:hi]
            near = near[(np.abs(table[near] - table[x]) <= most).all(axis=1)]
            distance = np.bitwise_count(fp[near] ^ fp[x]).sum(axis=1, dtype=np.int32)
            near = near[similarity_of(distance, n[near].astype(float), float(n[x])) >= least]
            if len(near):
                members.append(near)
                front.extend(near.tolist())
                left = left[~np.isin(left, near)]
        group = np.concatenate(members)
        if len(group) > 1:
            found.append(node[group])
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found), np.concatenate([np.full(len(g), g.min(), np.int64) for g in found])


def similar_links(nodes: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) between nodes (node, wide, n, keys) of an estimated similarity of that or more.

    Sets of a similarity of 0.8 share one of their KEYS smallest hashes but with a
    probability of about 0.2 to the power of KEYS, so nodes meet in blocks by
    those. A block beyond BLOCK nodes, such as that of a line that very many texts
    share, is dealt by size first: sets whose sizes are within the similarity lie in
    the same or in neighbouring bands. What is still large is dealt into chunks, and
    every pair of chunks is walked, so that the same pairs meet in blocks of any size.
    """
    keyed = nodes.select("node", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    band = F.floor(F.log("n") / F.lit(float(-np.log(similarity)) * 1.001)).cast("long")  # a little wide, against rounding
    bands_in = F.when(F.col("size") > BLOCK, F.array(band, band + 1)).otherwise(F.array(F.lit(-1).cast("long")))
    dealt = cut(keyed.join(sizes, "key").select("node", "key", F.explode(bands_in).alias("key2")))
    sizes = dealt.groupBy("key", "key2").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunks = F.when(F.col("size") > BLOCK, F.ceil(F.col("size") / (BLOCK // 2)).cast("int")).otherwise(F.lit(1))
    met = _chunk_pairs(dealt.join(sizes.select("key", "key2", chunks.alias("chunks")), ["key", "key2"]))
    met = met.select("node", "key", "key2", "pair").join(nodes.select("node", "wide", "n"), "node")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in key_groups(batches, ["key", "key2", "pair"]):
            if len(group) > 1:
                fp = np.frombuffer(b"".join(group["wide"]), dtype="<u8").reshape(len(group), WIDE_WORDS)
                u, v = _similar_links(group["node"].to_numpy(), fp, group["n"].to_numpy(), similarity)
                keep = u != v
                if keep.any():
                    yield pd.DataFrame({"u": u[keep], "v": v[keep]})

    return met.repartition("key", "key2", "pair").sortWithinPartitions("key", "key2", "pair").mapInPandas(run, "u long, v long")


def _chunk_pairs(rows: DataFrame) -> DataFrame:
    """``rows`` (node, chunks) with pair: once for each pair of chunks that the node's own chunk is in."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.least(own, o) * F.col("chunks") + F.greatest(own, o))
    return rows.withColumn("pair", F.explode(pair))


def _verified(node: np.ndarray, sets: list[np.ndarray], fp: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes whose sets' similarity is that or more, as links to the smallest of what they reach; walked breadth-first by size."""
    n = np.array([len(x) for x in sets])
    left, us, vs = np.argsort(n, kind="stable"), [], []
    while len(left) > 1:
        group, front, left = [left[:1]], [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            lo, hi = np.searchsorted(n[left], n[x] * similarity, "left"), np.searchsorted(n[left], n[x] / similarity, "right")
            near = left[lo:hi]
            distance = np.bitwise_count(fp[near] ^ fp[x]).sum(axis=1, dtype=np.int32)
            near = near[similarity_of(distance, n[near].astype(float), float(n[x])) >= similarity - MARGIN]
            if not len(near):
                continue
            other = np.concatenate([sets[y] for y in near])
            at = np.minimum(np.searchsorted(sets[x], other), n[x] - 1)
            shared = np.add.reduceat((sets[x][at] == other).astype(np.int64), np.cumsum(n[near]) - n[near])
            near = near[shared >= similarity * (n[near] + n[x] - shared) - 1e-9]
            if len(near):
                group.append(near)
                front.extend(near.tolist())
                left = left[~np.isin(left, near)]
        found = node[np.concatenate(group)]
        if len(found) > 1:
            us.append(found[found != found.min()])
            vs.append(np.full(len(us[-1]), found.min(), np.int64))
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.empty(0, np.int64), np.empty(0, np.int64))


def verified_links(texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Links (u, v) between texts (node, component, wide, text) of one component whose shingle sets' Jaccard similarity is that or more.

    Only texts that the estimate brought together come here, each once with its
    shingles' hashes. A component beyond SET_BYTES of those is dealt into chunks,
    and every pair of chunks is walked.
    """

    def make() -> Callable[[list[str]], dict]:
        def run(some: list[str]) -> dict:
            sets = [np.unique(shingle_hashes(t, width)) for t in some]
            return {"set": [x.tobytes() for x in sets], "n": [len(x) for x in sets]}

        return run

    sets = cut(map_texts(texts, {"node": "node", "component": "component", "wide": "wide"}, "text", make, "set binary, n long"))
    sizes = sets.groupBy("component").agg(F.ceil(F.sum("n") * 8 / SET_BYTES).cast("int").alias("chunks"))
    met = _chunk_pairs(sets.join(sizes, "component"))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in key_groups(batches, ["component", "pair"]):
            if len(group) > 1:
                fp = np.frombuffer(b"".join(group["wide"]), dtype="<u8").reshape(len(group), WIDE_WORDS)
                u, v = _verified(group["node"].to_numpy(), [np.frombuffer(x, "<u8") for x in group["set"]], fp, similarity)
                if len(u):
                    yield pd.DataFrame({"u": u, "v": v})

    dealt = met.select("component", "pair", "node", "wide", "set").repartition("component", "pair").sortWithinPartitions("component", "pair")
    return dealt.mapInPandas(run, "u long, v long")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without near-duplicates: of each component one document stays.

    Two documents are linked when the Jaccard similarity of their sets of
    ``width``-word shingles is ``similarity`` or more. Fingerprints of 1024 bits
    estimate it and bring together what may be alike, with MARGIN to spare; the
    sets themselves decide. Of a component the one with the smallest id stays, null ids last, and of those the
    one with the smallest hash of its text; rows that repeat both stay only once.
    Texts of different components stay, also if they share an id or have none.
    Null and texts without a word are copies of one another. An empty table gives
    an empty one; all columns pass, whatever their names are.
    """
    data, place = numbered(docs)
    who, text = place[id_col], place[text_col]
    keyed = data.withColumn("key", F.xxhash64(text))

    def make() -> Callable[[list[str]], dict]:
        def run(texts: list[str]) -> dict:
            wide, n, keys = zip(*[sketch(t, width) for t in texts], strict=True) if texts else ((), (), ())
            return {"wide": list(wide), "n": list(n), "keys": list(keys)}

        return run

    rows = cut(map_texts(keyed, {"id": who, "key": "key"}, text, make, "wide binary, n long, keys array<long>"))
    least = rows.groupBy("wide", "n").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("least"), F.first("keys").alias("keys"))
    nodes = cut(least.withColumn("node", F.monotonically_increasing_id()))
    suspected = connected_components(similar_links(nodes.where("n > 0"), similarity - MARGIN))
    named = nodes.join(suspected, "node").select("node", "component", "wide", F.col("least.id").alias("of_id"), F.col("least.key").alias("of_key"))
    texts = keyed.join(named, keyed[who].eqNullSafe(named["of_id"]) & (keyed["key"] == named["of_key"])).select("node", "component", "wide", F.col(text).alias("text"))
    links = verified_links(texts.dropDuplicates(["node"]), width, similarity)
    roots = connected_components(links).withColumnRenamed("node", "of")
    named = nodes.join(roots, F.col("node") == F.col("of"), "left").select("least", F.coalesce("component", "node").alias("component"))
    stays = named.groupBy("component").agg(F.min("least").alias("least")).select(F.col("least.id").alias("stay_id"), F.col("least.key").alias("stay_key"))
    kept = keyed.join(stays, keyed[who].eqNullSafe(stays["stay_id"]) & (keyed["key"] == stays["stay_key"]), "left_semi")
    return kept.dropDuplicates([who, "key"]).select(*[F.col(d).alias(c) for c, d in place.items()])
