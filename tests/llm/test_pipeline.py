from collections import Counter

import corpus_pipeline
from docket.llm import linededup, mixing, packing, toxicity
from docket.llm.queries import QUERIES, toxicity_model
from test_simhash import exact_survivors

STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_follow_one_another(spark, sf_dir):
    """Each stage gives what its operator decides on all that the stage before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    assert list(STAGES) == ["toxicity", "line_dedup", "simhash_near_dedup", "mixing", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "toxicity":
            score = {r.doc_id: r.score for r in toxicity.score(docs, toxicity_model(spark, docs, sf_dir)).collect()}
            want = Counter({r: n for r, n in rows_of(docs).items() if score[r[0]] < corpus_pipeline.TOXIC})
            assert rows_of(out) == want and 0 < sum(want.values()) < docs.count()
        if name == "line_dedup":
            text = {r.doc_id: (r.text, r.removed_lines) for r in linededup.dedup_lines(docs).collect()}
            for r in out.collect():
                assert (r.text, r.n_chars if text[r.doc_id][1] else None) == (text[r.doc_id][0], len(r.text) if text[r.doc_id][1] else None)
            assert out.count() == docs.count() and any(n for _, n in text.values())
        if name == "simhash_near_dedup":
            kept = rows_of(out)
            assert not kept - rows_of(docs)
            assert len({r.doc_id for r in out.collect()}) == out.count()
            assert {r[0] for r in kept} == exact_survivors({r.doc_id: r.text for r in docs.collect()})
        if name == "mixing":
            times = {r.doc_id: r.mix_copies for r in mixing.mix(docs).collect()}
            assert rows_of(out) == Counter({r: n * times[r[0]] for r, n in rows_of(docs).items() if times[r[0]]})
        if name == "best_fit_packing":
            pieces = Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packing.token_pieces(docs).collect())
            assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.collect()) == pieces
            assert all(r.length <= packing.CAPACITY for r in out.collect())
            break
        assert out.columns == columns, name
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_stages_take_odd_and_empty_rows(spark, odd, odd_rows, empty, sf_dir):
    clean = odd
    for name, stage in corpus_pipeline.STAGES[:2]:
        clean = stage(spark, clean, sf_dir)
        clean = spark.createDataFrame(clean.collect(), odd.schema)
        assert clean.count() == len(odd_rows), name  # nothing here is toxic, and line dedup keeps every row
    once = STAGES["simhash_near_dedup"](spark, odd, sf_dir)
    # the repeated row once, and of the texts without a word the smallest id
    assert sorted((r.doc_id is None, r.doc_id) for r in once.collect()) == [(False, i) for i in (1, 2, 5, 6, 7, 8, 9)] + [(True, None)]
    mixed = STAGES["mixing"](spark, odd, sf_dir)
    assert mixed.columns == odd.columns and set(mixed.collect()) <= set(odd.collect())
    packed = STAGES["best_fit_packing"](spark, odd, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r[0] for r in odd_rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_dup_stage_keeps_rows_that_share_ids_or_have_none(spark, sf_dir):
    text = lambda tag: " ".join(f"{tag}{i}" for i in range(60))
    rows = [(None, text("a")), (None, text("b")), (7, text("c")), (7, text("d")), (8, text("d"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    assert rows_of(out) == Counter(rows[:4])


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
