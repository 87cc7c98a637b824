import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docket.llm import tokenfile
from docket.llm.queries import op10_token_files
from docket.llm.tokens import Encoder, default_tokenizer


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=2000))
@settings(max_examples=60, deadline=None)
def test_segment_round_trip(ids):
    x = np.array(ids, dtype=np.uint32)
    assert tokenfile.decode_segment(tokenfile.encode_segment(x)).tolist() == ids


def test_segments_are_small():
    x = np.random.default_rng(0).integers(1000, 1200, 100_000).astype(np.uint32)
    x[::97] = 50_000
    assert len(tokenfile.encode_segment(x)) < 0.4 * x.nbytes


def test_cached_ids_are_the_tokenizers():
    e = Encoder(default_tokenizer(), limit=50, step_chars=500)
    rng = random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "'s", ".", "é", "1", "\t", "\xa0", "\x1c", "<|endoftext|>", "漢", " x", "word"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + ["", " "]
    assert all(a.tolist() == b.tolist() for a, b in zip(e.encode(texts), e.whole(texts), strict=True))


def brute(rows):
    e, at = Encoder(default_tokenizer()), 0
    for doc, text in rows:
        ids = np.append(e.whole([text or ""])[0], 0).astype("<u4")
        yield doc, at, len(ids), zlib.crc32(ids.tobytes())
        at += len(ids)


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    got = sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in op10_token_files(spark, sf_dir).collect())
    assert got == list(brute((r.doc_id, r.text) for r in docs))


def test_odd_rows(spark, odd, empty, tmp_path):
    tokenfile.write_tokens(odd, f"{tmp_path}/a", partitions=3)
    rows = tokenfile.read_tokens(spark, f"{tmp_path}/a", ids=True).orderBy("start").collect()
    assert rows[0].doc_id is None and rows[0].start == 0 and len(rows) == odd.count()
    assert [r.doc_id for r in rows[1:]] == sorted(r.doc_id for r in rows[1:])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))
    assert all(len(r.ids) == 4 * r.n_tokens for r in rows)
    tokenfile.write_tokens(empty, f"{tmp_path}/b")
    assert tokenfile.read_tokens(spark, f"{tmp_path}/b").count() == 0
