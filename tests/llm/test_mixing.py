import duckdb
import pytest

from docket.llm import mixing
from docket.llm.queries import ORACLE_SQL, op6_mixing


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(con.sql(f"SELECT doc_id, size, source_size, target, taken FROM ({ORACLE_SQL['op6_mixing']})").fetchall())
    assert sorted(map(tuple, op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", "target", "taken").collect())) == want


def test_targets_share_and_stop(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1000), (None, 10), ("c", 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["a"] == 200 and got[None] == 20 and got["c"] == 0
    assert got["b"] == pytest.approx(1.5 * 1110 - 220)


def test_near_target_and_bounded(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 50)) AS text", "concat('s', id % 3) AS source")
    rows = mixing.mix(docs).collect()
    for s in {r.source for r in rows}:
        part = [r for r in rows if r.source == s]
        assert abs(sum(r.mix_taken for r in part) - part[0].mix_target) <= 50
    assert all(r.mix_taken <= 2 * r.mix_size for r in rows)


def test_odd_rows(odd, empty):
    out = mixing.mix(odd)
    assert out.count() == 11 and out.columns[: len(odd.columns)] == odd.columns
    assert out.where("text IS NULL").first().mix_size == 0
    assert out.where("source IS NULL").first().mix_source_size == 0
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(empty).count() == 0


def test_own_column_names_clash(spark):
    names = ["threshold", "base_copies", "size", "h", "mix_s", "mix_copy", "s", "left", "prefix", "bucket", "d0", "d1", "target", "mix_size"]
    docs = spark.createDataFrame([(i, "w " * (i + 1), f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(6)], ["doc_id", "text", "source", *names])
    plain = {r.doc_id: (r.mix_size, r.mix_taken) for r in mixing.mix(docs.select("doc_id", "text", "source")).collect()}
    out = mixing.mix(docs)
    for r in out.collect():
        assert (r.mix_size, r.mix_taken) == plain[r.doc_id]
        assert [r[n] for n in names[:-1]] == [f"{n}{r.doc_id}" for n in names[:-1]]
    taken = mixing.mixed_documents(docs)
    assert taken.columns == docs.columns and {r.mix_size for r in taken.collect()} <= {f"mix_size{i}" for i in range(6)}
