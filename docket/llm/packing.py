"""Best-fit packing with bound-certified repacking.

Pieces of at most ``capacity`` tokens are dealt into buckets by a hash and each
bucket is packed best-fit decreasing. A dual-feasible-function bound then says
how few sequences any packing of the bucket needs; a bucket that meets its bound
is certified and done. Buckets with a gap keep their full sequences and give the
pieces of the others to the next round, where they are dealt anew, with pieces
of other buckets, and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docket.llm.columns import numbered
from docket.llm.texts import ROW, map_texts
from docket.llm.tokens import END_ID, default_tokenizer, encoder
from docket.session import cut

CAPACITY = 2048
BUCKET = 4096
ROUNDS = 4
#: Sequence ids: the round, the bucket and the sequence in it have these bits each; full pieces have negative ids.
ROUND_AT, BUCKET_AT = 58, 22


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, longest first into the fullest bin that takes it."""
    order = np.argsort(-lengths, kind="stable")
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by the room they have
    room, mask, bins = 0, 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        where[i], offset[i] = b, capacity - room
        if room > n:
            free[room - n].append(b)
            mask |= 1 << (room - n)
    return where, offset


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The largest bound of the dual feasible functions f_t, 0 <= t <= capacity/2.

    f_t counts a length over capacity - t as a whole sequence, drops one under
    t, and leaves the others; no sequence holds more than ``capacity`` of f_t.
    """
    return histogram_bound(np.bincount(lengths, minlength=capacity + 1).astype(np.int64), capacity)


def histogram_bound(hist: np.ndarray, capacity: int) -> int:
    """``lower_bound`` of lengths by how often each occurs."""
    tokens = hist * np.arange(capacity + 1)
    upto, count = np.cumsum(tokens), np.cumsum(hist)
    t = np.arange(capacity // 2 + 1)
    large = count[capacity] - count[capacity - t]
    middle = upto[capacity - t] - np.where(t > 0, upto[np.maximum(t - 1, 0)], 0)
    return int((large + -(-middle // capacity)).max())


def _bucket_packer(turn: int, capacity: int, final: bool) -> Callable:
    """Packs one bucket; a piece is done in a full sequence, a certified bucket, or the final round."""

    def run(keys: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pack_row")
        lengths = group["length"].to_numpy()
        where, offset = best_fit_decreasing(lengths, capacity)
        bins = int(where.max()) + 1
        sure = bins <= lower_bound(lengths, capacity)
        full = np.bincount(where, weights=lengths, minlength=bins)[where] >= capacity
        if bins >= 1 << BUCKET_AT:
            raise ValueError("a bucket of over four million sequences")
        seq = (turn << ROUND_AT) + (int(keys[0]) << BUCKET_AT) + where
        return pd.DataFrame({"pack_row": group["pack_row"], "length": lengths, "sequence_id": seq, "offset": offset, "certified": sure, "done": full | sure | final})

    return run


def pack(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY, bucket: int = BUCKET, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with sequence_id, offset and certified.

    Lengths are from 0 to ``capacity``; others, and nulls, raise. A piece of
    length 0 takes no room and gets a place in some sequence. ``certified`` is
    true where the bucket in which the piece was placed for good has as few
    sequences as any packing of it; ``packing_report`` has the bound of the
    whole. Rows may repeat; ties take any order. An empty table gives an empty
    one. The columns sequence_id, offset and certified of the input are
    replaced; others pass, whatever their names are.
    """
    if not 1 <= rounds < 32:
        raise ValueError("from 1 to 31 rounds")
    data, place = numbered(pieces)
    length = F.col(place[length_col])
    checked = F.when(length.between(0, capacity), length).otherwise(F.raise_error(F.concat(F.lit("not a piece's length: "), F.coalesce(length.cast("string"), F.lit("null"))))).cast("long")
    rows = cut(data.withColumn(place[length_col], checked).withColumn("pack_row", F.monotonically_increasing_id()))
    # a full piece is a sequence by itself
    own = rows.where(length == capacity).select("pack_row", (-1 - F.col("pack_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    left = rows.where(length < capacity).select("pack_row", length.alias("length"))
    placed = own
    for turn in range(rounds):
        n = left.count()
        if not n:
            break
        buckets = -(-n // bucket)
        run = _bucket_packer(turn, capacity, turn == rounds - 1 or buckets == 1)
        salted = left.withColumn("bucket", F.pmod(F.xxhash64("pack_row", F.lit(turn)), F.lit(buckets)))
        out = cut(salted.groupBy("bucket").applyInPandas(run, "pack_row long, length long, sequence_id long, offset long, certified boolean, done boolean"))
        placed = placed.union(out.where("done").select("pack_row", "sequence_id", "offset", "certified"))
        left = out.where("not done").select("pack_row", "length")
    new = ["sequence_id", "offset", "certified"]
    return rows.join(placed, "pack_row").select(*[F.col(d).alias(c) for c, d in place.items() if c not in new], *new)


def packing_report(packed: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """One row: pieces, tokens, sequences, the fewest that any packing of all needs, the gap, certified pieces.

    Lengths are counted on the cluster; the bound needs only how often each
    length occurs, at most ``capacity`` + 1 numbers.
    """
    spark = packed.sparkSession
    counts = packed.groupBy(F.col(length_col).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n"), F.count_if("certified").alias("sure")).collect()
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for r in counts:
        hist[r["length"]] = r["n"]
    sequences = packed.select("sequence_id").distinct().count()
    least = histogram_bound(hist, capacity)
    row = (int(hist.sum()), int((hist * np.arange(capacity + 1)).sum()), sequences, least, sequences - least, sum(r["sure"] for r in counts))
    return spark.createDataFrame([row], "pieces long, tokens long, sequences long, bound long, gap long, certified_pieces long")


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's ids and its end id.

    Null text is empty. A document of more than ``capacity`` ids becomes pieces
    of ``capacity``, of which the first may be shorter. ``ids`` are little-endian
    unsigned 32-bit bytes.
    """
    path = tokenizer or default_tokenizer()

    def make() -> Callable[[list[str]], dict]:
        model = encoder(path)

        def run(texts: list[str]) -> dict:
            out: dict[str, list] = {ROW: [], "piece": [], "start": [], "length": [], "ids_crc32": []} | ({"ids": []} if keep_ids else {})
            for at in range(0, len(texts), 500):
                for i, ids in enumerate(model.encode(texts[at : at + 500]), at):
                    ids = np.append(ids, np.uint32(END_ID)).astype("<u4")
                    cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                    for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        data = ids[lo:hi].tobytes()
                        for name, value in zip(out, (i, k, lo, hi - lo, zlib.crc32(data), data), strict=False):
                            out[name].append(value)
            return out

        return run

    return map_texts(docs, {"doc_id": id_col}, text_col, make, "piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, **options) -> DataFrame:
    """The pieces of all documents with their sequences.

    Null and empty texts are documents of one id, the end id. Repeated rows are
    packed as often as they occur. A null id stays null. Other columns are not
    read. An empty table gives an empty one.
    """
    return pack(token_pieces(docs, id_col, text_col, tokenizer, capacity, keep_ids), capacity=capacity, **options)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of what pack_documents(..., keep_ids=True) gives: at most capacity ids each."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
