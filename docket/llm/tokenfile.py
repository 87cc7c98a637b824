"""Token ids as patched frame-of-reference segments.

A segment holds the ids of consecutive documents. Its ids are cut into blocks of
``BLOCK``; a block stores its minimum, the others as differences to it in a bit
width under which the chosen percentile of them fits, and what doesn't fit in an
exception list of places and values. An index has where each block's bits begin.

Segment: magic ``PFR1``; numbers of ids, blocks, exceptions as unsigned 32-bit;
minima (u32), widths (u8), block starts (u64, in bytes of the bits), numbers of
exceptions up to each block (u32), places in the block (u16), differences (u32),
the bits (each difference least significant bit first). Little-endian.

Segments are rows of a Parquet table, so writing and reading them is Spark's:
any store, commits, and a lost executor costs its tasks again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.texts import ROWS
from docket.llm.tokens import END_ID, default_tokenizer, encoder

BLOCK = 256
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
_HEAD = struct.Struct("<4sIII")


def _bit_length(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1))).astype(np.int64) + 1, 0)


def encode_segment(ids: np.ndarray, percentile: int = PERCENTILE) -> bytes:
    n, blocks = len(ids), -(-len(ids) // BLOCK)
    if not n:
        return _HEAD.pack(b"PFR1", 0, 0, 0)
    padded = np.full(blocks * BLOCK, ids[-1], dtype=np.uint32)
    padded[:n] = ids
    grid = padded.reshape(blocks, BLOCK)
    minima = grid.min(axis=1)
    delta = grid - minima[:, None]
    rank = min(BLOCK - 1, BLOCK * percentile // 100)
    widths = _bit_length(np.partition(delta, rank, axis=1)[:, rank]).astype(np.uint8)
    over = (delta >> widths[:, None].astype(np.uint32)) > 0
    row, place = np.nonzero(over)
    values = delta[row, place]
    kept = np.where(over, 0, delta)
    sizes = widths.astype(np.uint64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    bits = np.zeros(int(starts[-1]), dtype=np.uint8)
    for w in np.unique(widths).tolist():
        if w:
            at = np.nonzero(widths == w)[0]
            raw = np.unpackbits(kept[at].astype("<u4").view(np.uint8).reshape(len(at), BLOCK, 4), axis=2, bitorder="little", count=w)
            packed = np.packbits(raw.reshape(len(at), BLOCK * w), axis=1, bitorder="little")
            bits[(starts[at].astype(np.int64)[:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    upto = np.cumsum(np.bincount(row, minlength=blocks)).astype("<u4")
    parts = [minima.astype("<u4"), widths, starts[:-1].astype("<u8"), upto, place.astype("<u2"), values.astype("<u4"), bits]
    return _HEAD.pack(b"PFR1", n, blocks, len(row)) + b"".join(p.tobytes() for p in parts)


def decode_segment(data: bytes) -> np.ndarray:
    magic, n, blocks, extra = _HEAD.unpack_from(data)
    if magic != b"PFR1":
        raise ValueError("not a segment")
    if not n:
        return np.empty(0, np.uint32)
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    minima, widths, starts, upto = take("<u4", blocks), take("u1", blocks), take("<u8", blocks), take("<u4", blocks)
    place, values = take("<u2", extra), take("<u4", extra)
    bits = take("u1", len(data) - at)
    grid = np.zeros((blocks, BLOCK), dtype=np.uint32)
    for w in np.unique(widths).tolist():
        if w:
            rows = np.nonzero(widths == w)[0]
            raw = bits[starts[rows].astype(np.int64)[:, None] + np.arange(BLOCK * w // 8)]
            wide = np.zeros((len(rows), BLOCK, 32), dtype=np.uint8)
            wide[:, :, :w] = np.unpackbits(raw, axis=1, bitorder="little").reshape(len(rows), BLOCK, w)
            grid[rows] = np.packbits(wide, axis=2, bitorder="little").view("<u4")[:, :, 0]
    owner = np.repeat(np.arange(blocks), np.diff(np.concatenate([[0], upto.astype(np.int64)])))
    grid[owner, place] = values
    grid += minima[:, None]
    return grid.ravel()[:n]


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Writes the ids of all documents, each with its end id, in ascending id order.

    One row per segment: part and seg give the order, doc_ids and lengths its
    documents, image the segment. A segment has whole documents, ``SEGMENT_IDS``
    ids or one longer document. Null ids come first, rows that share an id are
    in the order of their text's hash. Null text is empty. Other columns are not
    read.
    """
    tok = tokenizer or default_tokenizer()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, part, seg = encoder(tok), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        names: list[int | None] = []
        full = 0

        def flush() -> pa.RecordBatch:
            image = encode_segment(np.concatenate(held))
            columns = [pa.array([part], pa.int32()), pa.array([seg], pa.int32()), pa.array([names], pa.list_(id_type)), pa.array([[len(x) for x in held]], pa.list_(pa.int32())), pa.array([image], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "seg", "doc_ids", "lengths", "image"])

        for b in (x.slice(at, ROWS) for x in batches for at in range(0, x.num_rows, ROWS)):
            keys, id_type = b.column(0).to_pylist(), b.column(0).type
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at in range(0, len(texts), 500):
                for key, ids in zip(keys[at:], model.encode(texts[at : at + 500]), strict=False):
                    if held and full + len(ids) + 1 > SEGMENT_IDS:
                        yield flush()
                        held, names, full, seg = [], [], 0, seg + 1
                    held.append(np.append(ids, np.uint32(END_ID)))
                    names.append(key)
                    full += len(ids) + 1
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    by = [F.asc_nulls_first("doc_id"), F.asc("tie")]
    ranged = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    ordered = ranged.sortWithinPartitions(*by)
    images = ordered.select("doc_id", "text").mapInArrow(run, f"part int, seg int, doc_ids array<{kind}>, lengths array<int>, image binary")
    images.write.option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str, ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) from the files at ``path``.

    start is the number of ids in all documents before; it comes from the sums
    of the segments (one row each), not from a sort of the documents.
    """
    images = spark.read.parquet(path)
    kind = images.schema["doc_ids"].dataType.elementType.simpleString()
    sums = images.select("part", "seg", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    parts = sums.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    sums = sums.withColumn("within", F.sum("n").over(W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, 0)) - F.col("n"))
    begins = sums.join(parts, "part").select("part", "seg", (F.col("before") + F.col("within")).alias("begin"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = {name: i for i, name in enumerate(b.schema.names)}
            for r in range(b.num_rows):
                part, seg, lengths, image = (b.column(at[c])[r].as_py() for c in ("part", "seg", "lengths", "image"))
                data = decode_segment(image).astype("<u4")
                lengths = np.asarray(lengths, dtype=np.int64)
                stops = np.cumsum(lengths)
                spans = [data[a:z].tobytes() for a, z in zip((stops - lengths).tolist(), stops.tolist(), strict=True)]
                columns = [pa.array([part] * len(spans), pa.int32()), pa.array([seg] * len(spans), pa.int32()), b.column(at["doc_ids"])[r].values, pa.array(stops - lengths), pa.array(lengths), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                columns += [pa.array(spans, pa.binary())] if ids else []
                yield pa.RecordBatch.from_arrays(columns, names=["part", "seg", "doc_id", "inner", "n_tokens", "ids_crc32", *(["ids"] if ids else [])])

    schema = f"part int, seg int, doc_id {kind}, inner long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    rows = images.mapInArrow(run, schema).join(begins, ["part", "seg"])
    return rows.select("doc_id", (F.col("begin") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if ids else []))
