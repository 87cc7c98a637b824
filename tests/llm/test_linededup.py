import re
import struct

import pytest
import xxhash
from pyspark.sql import functions as F

from docket.llm import linededup
from docket.llm.queries import op5_line_dedup


def test_lines_join_to_the_text(spark, odd):
    for r in odd.select("text", linededup.lines_of(odd["text"]).alias("l")).collect():
        assert r.text is None and r.l is None or "".join(r.l) == r.text
    marked = spark.createDataFrame([("a. b\nc\x01d. e",)], "text string")
    assert marked.select(linededup.lines_of(marked["text"]).alias("l")).first().l == ["a. ", "b\n", "c\x01d. ", "e"]


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_line(line):
    return signed(xxhash.xxh64_intdigest(line.encode(), 42))


def roll(a, b):
    h = xxhash.xxh64_intdigest(struct.pack("<q", a), 42)
    return signed(xxhash.xxh64_intdigest(struct.pack("<q", b), h))


def words(line):
    return len(re.findall(r"[^\x20\x09-\x0D]+", line))


def twin(docs):
    """{id: (text, removed lines)} of {id: text} by plain Python."""
    lines = {i: re.split(r"(?<=\n)|(?<=[.!?] )", t) for i, t in docs.items() if t is not None}
    seen, gone = set(), {}
    for i in sorted(lines):
        ls, again = lines[i], set()
        for p in range(len(ls) - 1):
            again |= {p} if (ls[p], ls[p + 1]) in seen else set()
            seen.add((ls[p], ls[p + 1]))
        out = {p for p, s in enumerate(ls) if words(s) > linededup.WORDS and s in seen}
        seen |= {s for s in ls if words(s) > linededup.WORDS}
        # places of one text: a line that it has twice goes the second time
        first = set()
        for p, s in enumerate(ls):
            if words(s) > linededup.WORDS:
                out |= {p} if s in first else set()
                first.add(s)
        chain = []
        for p in range(len(ls)):
            if p in again:
                chain.append(p)
                continue
            if chain:
                edges = [q for q in chain if roll(hash_line(ls[q]), hash_line(ls[q + 1])) % linededup.DIVISOR == 0]
                if sum(words(ls[q]) for q in [*chain, chain[-1] + 1]) > linededup.WORDS or edges and edges[-1] - edges[0] >= linededup.LEAST_LINES:
                    out |= set(chain) | {chain[-1] + 1}
            chain = []
        gone[i] = out
    return {i: (docs[i] if docs[i] is None else "".join(s for p, s in enumerate(lines[i]) if p not in gone[i]), len(gone.get(i, ()))) for i in docs}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_python(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.removed_lines) for r in op5_line_dedup(spark, f"/root/testdata/{sf}").collect()}
    want = twin(docs)
    assert got.keys() == want.keys() and sum(n for _, n in want.values()) > 0
    for i in want:
        assert got[i] == want[i], i


def test_own_column_names_clash(spark):
    passage = "".join(f"Sentence number {i} of the shared passage is here. " for i in range(20))
    names = ["row", "_row", "h", "words", "chunks", "spans", "cuts", "d0", "d1", "id", "start", "of_row", "a", "b"]
    docs = spark.createDataFrame([(k, f"own {k} first. {passage}own {k} last. ", *[f"{n}{k}" for n in names]) for k in (1, 2, 3)], ["doc_id", "text", *names])
    out = linededup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "removed_lines"]
    for r in out.collect():
        assert r.text == f"own {r.doc_id} first. {passage if r.doc_id == 1 else ''}own {r.doc_id} last. "
        assert [r[n] for n in names] == [f"{n}{r.doc_id}" for n in names]


def test_long_text_of_one_repeated_line(spark):
    long = "Once more the river ran on past the old mill and its wheel. " * 20_000
    docs = spark.createDataFrame([(1, long), (2, "Own words. " + long)], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert len(got[1].text) < len(long) / 100 and got[2].text.startswith("Own words. ")


def brute(rows):
    """The lines of each text, by plain Python."""
    return {i: re.split(r"(?<=\n)|(?<=[.!?] )", t) for i, t in rows if t}


def test_passages_go_but_for_the_first(spark):
    passage = "".join(f"Sentence number {i} of the shared passage is here. " for i in range(40))
    own = lambda k: "".join(f"Own words {k} {i} stay where they are. " for i in range(6))
    docs = spark.createDataFrame([(k, own(k) + passage + own(-k)) for k in range(1, 9)] + [(20, own(20))], "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.dedup_lines(docs).collect()}
    assert got[1].text == own(1) + passage + own(-1) and got[20].text == own(20)
    for k in range(2, 9):
        assert len(got[k].text) < len(own(k) + own(-k)) + 0.25 * len(passage)
        kept = brute([(0, got[k].text)])[0]
        whole = brute([(0, own(k) + passage + own(-k))])[0]
        assert len(whole) - len(kept) == got[k].removed_lines
        assert all(s in got[k].text for s in brute([(0, own(k))])[0] if s)


def test_every_removed_line_stays_somewhere(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = op5_line_dedup(spark, sf_dir).collect()
    assert len(out) == len(docs)
    left = {s for r in out for s in brute([(0, r.text)]).get(0, [])}
    for r in out:
        if r.removed_lines == 0:
            assert r.text == docs[r.doc_id]
        for s in brute([(0, docs[r.doc_id])]).get(0, []):
            assert s in left


def test_odd_rows(odd, empty):
    out = linededup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "removed_lines"] and out.count() == 11
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text is None and rows[3].text == "" and rows[5].text.startswith("Once more")
    assert rows[7].text.startswith("alpha.")
    assert [r.text for r in out.where("doc_id = 1").collect()] == ["The cat sat on the mat. It was warm."] * 2
    assert linededup.dedup_lines(empty).count() == 0


def test_passages_of_few_lines_go_whole(spark):
    rows, shared = [], {}
    for n in range(1, 7):
        size = 50 // n + 1
        passage = "".join(" ".join(f"p{n}x{i}w{j}" for j in range(size)) + ". " for i in range(n))
        for k in range(20):
            key = 100 * n + k
            own = [f"own {key} {i} before. " for i in range(3)], [f"own {key} {i} after. " for i in range(3)]
            shared[key] = "".join(own[0]), passage, "".join(own[1])
            rows.append((key, "".join(shared[key])))
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for key, (before, passage, after) in shared.items():
        assert got[key].text == before + (passage if key % 100 == 0 else "") + after, key
        assert got[key].removed_lines == (0 if key % 100 == 0 else key // 100)


def test_uneven_lines_and_blank_lines_go_whole(spark):
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    passage = words("a", 30) + ".\n\n" + words("b", 1) + "\n" + words("c", 20) + ".\n\n" + words("d", 3) + "\n"
    docs = spark.createDataFrame([(k, f"first {k}\n{passage}last {k}\n") for k in (1, 2, 3)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()}
    assert got == {1: f"first 1\n{passage}last 1\n", 2: "first 2\nlast 2\n", 3: "first 3\nlast 3\n"}


def test_passages_of_rows_that_share_an_id_stay_once(spark):
    passage = " ".join(f"shared{i}" for i in range(60)) + ". "
    docs = spark.createDataFrame([(k, f"own {n} before. {passage}own {n} after. ") for n, k in enumerate([None, None, None, 4, 4])], "doc_id long, text string")
    got = [r.text for r in linededup.dedup_lines(docs).collect()]
    assert sum(passage in t for t in got) == 1
    only = linededup.dedup_lines(docs.where("doc_id = 4")).collect()
    assert sum(passage in r.text for r in only) == 1


def test_rows_that_share_a_key_keep_their_texts(spark, monkeypatch):
    """All rows collide under the first seed; the result is the same as without."""
    para = "First line of a passage here.\nSecond line of it stands here.\nThird line that follows on.\nFourth line to end it all.\n"
    docs = spark.createDataFrame([(1, "alpha. " + para), (2, "beta one two. " + para), (3, "gamma alone."), (4, None), (3, "gamma alone.")], "doc_id long, text string")
    want = sorted(map(str, map(tuple, linededup.dedup_lines(docs).collect())))
    key = linededup.row_key
    monkeypatch.setattr(linededup, "row_key", lambda i, t, seed: F.lit(7).cast("long") if seed == 0 else key(i, t, seed))
    assert sorted(map(str, map(tuple, linededup.dedup_lines(docs).collect()))) == want
    monkeypatch.setattr(linededup, "row_key", lambda i, t, seed: F.lit(7).cast("long"))
    with pytest.raises(RuntimeError, match="clash"):
        linededup.dedup_lines(docs)
