import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docket.llm import packing
from docket.llm.queries import op1_best_fit_packing
from docket.llm.tokens import Encoder, default_tokenizer


@given(st.lists(st.integers(0, 60), min_size=1, max_size=60))
@settings(max_examples=60, deadline=None)
def test_bins_hold_and_bound_holds(lengths):
    n = np.array(lengths)
    where, offset = packing.best_fit_decreasing(n, 60)
    for b in range(where.max() + 1):
        spans = sorted((o, o + k) for o, k in zip(offset[where == b].tolist(), n[where == b].tolist(), strict=True))
        assert spans[0][0] == 0 and spans[-1][1] <= 60
        assert all(x[1] == y[0] for x, y in zip(spans, spans[1:], strict=False))
    bound = packing.lower_bound(n, 60)
    assert -(-int(n.sum()) // 60) <= bound <= where.max() + 1


def test_bound_counts_large_items():
    assert packing.lower_bound(np.array([31, 31, 31]), 60) == 3


def check(rows, texts):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for spans in by_seq.values():
        at = 0
        for r in sorted(spans, key=lambda r: (r.offset, r.length)):
            assert r.offset == at
            at += r.length
        assert at <= packing.CAPACITY
    ids = Encoder(default_tokenizer()).whole(list(texts.values()))
    for (doc, _), whole in zip(texts.items(), ids, strict=True):
        want, at = np.append(whole, 0).astype("<u4"), 0
        pieces = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        for p in pieces:
            assert p.start == at and (p.length == packing.CAPACITY or p.piece == 0)
            assert zlib.crc32(want[at : at + p.length].tobytes()) == p.ids_crc32
            at += p.length
        assert at == len(want)


def test_query_against_brute_force(spark, sf_dir):
    rows = op1_best_fit_packing(spark, sf_dir).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    check(rows, texts)
    used = len({r.sequence_id for r in rows})
    assert used <= 1.01 * -(-sum(r.length for r in rows) // packing.CAPACITY) + 1


def test_several_buckets_exchange(spark):
    pieces = spark.range(3000).selectExpr("id AS doc_id", "int(100 + (id * 7919) % 1500) AS length", "'x' AS offset")
    out = packing.pack(pieces, bucket=200).collect()
    assert len(out) == 3000
    total = sum(r.length for r in out)
    assert len({r.sequence_id for r in out}) <= 1.02 * total / packing.CAPACITY + 1


def test_odd_rows(spark, odd, empty):
    out = packing.pack_documents(odd, keep_ids=True)
    rows = out.collect()
    assert len([r for r in rows if r.doc_id == 1]) == 2  # repeated rows stay
    assert [r.length for r in rows if r.doc_id == 2] == [1] and len([r for r in rows if r.doc_id is None]) == 1
    whole = {r.sequence_id: r.ids for r in packing.sequences(out).collect()}
    assert sum(map(len, whole.values())) == 4 * sum(r.length for r in rows)
    assert packing.pack_documents(empty).count() == 0


def test_bad_lengths_raise(spark):
    with pytest.raises(Exception, match="not a piece"):
        packing.pack(spark.createDataFrame([(1, None)], "doc_id long, length int")).count()


def test_own_column_names_clash(spark):
    names = ["pack_row", "seq", "bucket", "done", "certified", "d0", "d1"]
    pieces = spark.createDataFrame([(i, 100 + i, *[f"{n}{i}" for n in names]) for i in range(50)], ["doc_id", "length", *names])
    out = packing.pack(pieces)
    assert out.columns == [*[c for c in pieces.columns if c != "certified"], "sequence_id", "offset", "certified"]
    for r in out.collect():
        assert [r[n] for n in names if n != "certified"] == [f"{n}{r.doc_id}" for n in names if n != "certified"]


def test_sequence_ids_never_meet(spark):
    """Ids are made of round, bucket and place, so many sequences keep apart, full pieces too."""
    pieces = spark.range(20_000).selectExpr("id AS doc_id", "int(CASE WHEN id % 5 = 0 THEN 2048 ELSE 700 + (id * 7919) % 1300 END) AS length")
    rows = packing.pack(pieces, bucket=300, rounds=6).collect()
    load = defaultdict(int)
    for r in rows:
        load[r.sequence_id] += r.length
    assert max(load.values()) <= packing.CAPACITY
    starts = sum(r.offset == 0 for r in rows)
    assert starts == len(load)


def test_report_of_bound_and_gap(spark):
    pieces = spark.createDataFrame([(i, n) for i, n in enumerate([2048, 1500, 1500, 1500, 600, 548, 500])], "doc_id long, length int")
    got = packing.packing_report(packing.pack(pieces)).first()
    assert (got.pieces, got.tokens, got.sequences, got.bound, got.gap) == (7, 8196, 5, 5, 0)
    none = packing.packing_report(packing.pack(pieces.limit(0))).first()
    assert (none.pieces, none.sequences, none.bound, none.gap) == (0, 0, 0, 0)
