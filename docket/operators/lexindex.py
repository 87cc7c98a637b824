"""A stored inverted index: written once by segments, searched many times.

A segment is four Parquet tables. ``blocks`` has one row for each term and run of
``RUN_DOCS`` documents: their keys, term frequencies and lengths, and ``top``, the
largest part that the term adds to a score there. Rows are dealt and sorted by term,
so a search's terms prune files and row groups by their statistics. ``terms`` has
document frequencies, ``docs`` each document's run and length, ``stats`` the number
of documents and their total length; it is written last, and a segment without it
isn't read.

Documents are deleted by notes beside the segments: ``gone_keys`` names them,
``gone_terms`` and ``gone_stats`` say what they had in the statistics, so that
searches are as exact as if they had never been written. ``compact`` rewrites a
segment without them. Each write of a segment has a build of its own, and notes
hold for one build only. One writer at a time.

A search is exact. It first adds the tops of a query's terms for each run, without
reading postings, scores the runs that promise most, and then only those that can
still reach the k-th score found (block-max pruning by sets).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators.canonical import bounded
from docket.operators.ordering import in_order
from docket.operators.retrieval import K1, TASK_DOCS, B, top_k, words
from docket.operators.scoring import best_hits
from docket.session import cut

RUN_DOCS = 128
#: Runs and postings of a task where they are dealt, so that tasks grow in number and not in size.
TASK_RUNS, TASK_POSTINGS = 32, 2_000_000
#: Runs that a query scores first.
FIRST_RUNS = 8
#: Terms up to this many go into the scan's filter as a list; more are joined only.
LISTED_TERMS = 2000
#: Scores are rounded to six places, so a bound counts as reached within this.
SLACK = 2e-6
ROW_GROUP = 4 << 20
#: Blocks of a batch on their way to Spark.
BATCH_BLOCKS = 20_000
#: A deletion of more documents raises, unless its caller allows more.
DELETE_MOST = 500


def part(tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """What a term of weight 1 adds to a document's score."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def idf(df: Column, n: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def write_segment(docs: DataFrame, path: str, segment: int, by: str | None = None, tokens=words) -> None:
    """Adds documents (ref_key, text, and ``by``) to the index at ``path`` as one segment.

    ``by`` is a column that searches filter on: a run has documents of one value
    only. Null texts have no words but count as documents. A segment that exists
    is replaced. Keys must be unique over all segments.
    """
    value = F.col(f"`{by}`").cast("string") if by else F.lit(None).cast("string")
    rows = docs.select("ref_key", value.alias("value"), "text")
    placed = in_order(rows, F.col("value").asc_nulls_first(), "ref_key", pos="place", parts=_parts(docs.count(), TASK_DOCS))
    first = placed.groupBy(F.col("value").alias("of")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("many"))
    first = cut(first)  # one row a value
    runs = first.agg(F.coalesce(F.sum(F.ceil(F.col("many") / RUN_DOCS)), F.lit(0))).first()[0]
    run = F.floor((F.col("place") - F.col("first")) / RUN_DOCS)
    placed = placed.join(first, F.col("value").eqNullSafe(F.col("of"))).select("ref_key", "value", run.alias("run"), "text")
    # texts are dealt by run and tokenised there, so that blocks form where the run lies; a row without a term a document
    dealt = placed.repartition(_parts(runs, TASK_RUNS), "value", "run").select("ref_key", "value", "run", F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("t"))
    key = dealt.schema["ref_key"].dataType.simpleString()
    blocks = cut(dealt.sortWithinPartitions("value", "run", "ref_key").mapInArrow(_run_blocks, f"term string, value string, run long, n int, keys array<{key}>, tfs array<int>, lengths array<int>"), "zstd")
    opened = F.explode(F.arrays_zip("keys", "lengths")).alias("d")
    documents = blocks.where("term is null").select("value", "run", opened).select(F.col("d.keys").alias("ref_key"), "value", "run", F.col("d.lengths").alias("dl"))
    _write(cut(documents), blocks.where("term is not null"), path, segment)


def _parts(many: int, each: int) -> int:
    return max(1, -(-many // each))


def _run_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's blocks of documents (ref_key, value, run, t); rows of a run lie together in order of their keys. Null is the term of all of a run."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(_begins(batch))
        if len(new):  # what comes before the batch's last run is complete
            held.append(batch.slice(0, new[-1]))
            yield from _blocks_of(pa.Table.from_batches(held, held[0].schema))
            held = []
            batch = batch.slice(new[-1])
        elif held and not _same_run(held[-1], batch):
            yield from _blocks_of(pa.Table.from_batches(held, held[0].schema))
            held = []
        held.append(batch)
    if held:
        yield from _blocks_of(pa.Table.from_batches(held, held[0].schema))


def _same_run(a: pa.RecordBatch, b: pa.RecordBatch) -> bool:
    return all(a.column(c)[-1].as_py() == b.column(c)[0].as_py() for c in ("value", "run"))


def _begins(rows: pa.RecordBatch | pa.Table) -> np.ndarray:
    """Whether a row is of another run than the one before; not so for the first."""
    out = np.zeros(rows.num_rows, dtype=bool)
    value = rows.column("value")
    if isinstance(value, pa.ChunkedArray):
        value = value.combine_chunks()
    named = value.dictionary_encode("encode").indices.to_numpy()
    run = rows.column("run").to_numpy()
    out[1:] = (named[1:] != named[:-1]) | (run[1:] != run[:-1])
    return out


def _blocks_of(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The blocks of whole runs."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    keys, value, run, lists = (rows.column(c).combine_chunks() for c in ("ref_key", "value", "run", "t"))
    size, n = lists.value_lengths().to_numpy(), rows.num_rows
    words = lists.flatten().dictionary_encode()
    code, v = words.indices.to_numpy().astype(np.int64) + 1, len(words.dictionary) + 1  # 0 is the term of all
    of, doc = np.cumsum(_begins(rows)), np.arange(n)
    at = np.repeat(doc, size)
    # one number a run, term and document, so that one sort counts and orders them
    both, tf = np.unique(np.concatenate([(of * v) * n + doc, (of[at] * v + code) * n + at]), return_counts=True)
    block, doc = both // n, both % n
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    offsets = pa.array(np.append(first, len(both)), pa.int32())
    term = block[first] % v
    head = pa.array(doc[first])
    columns = [
        words.dictionary.take(pa.array(term - 1, mask=term == 0)),
        value.take(head),
        run.take(head),
        pa.array(np.diff(np.append(first, len(both))), pa.int32()),
        *[pa.ListArray.from_arrays(offsets, c) for c in (keys.take(pa.array(doc)), pa.array(tf, pa.int32()), pa.array(size[doc], pa.int32()))],
    ]
    for a in range(0, len(first), BATCH_BLOCKS):
        yield pa.RecordBatch.from_arrays([c.slice(a, BATCH_BLOCKS) for c in columns], names=["term", "value", "run", "n", "keys", "tfs", "lengths"])


def _write(documents: DataFrame, blocks: DataFrame, path: str, segment: int) -> None:
    """Writes documents (ref_key, value, run, dl) and their ``_blocks`` as one segment; neither is read from it."""
    spark = documents.sparkSession
    total = documents.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")).first()
    avgdl = (total["total"] / total["docs"] if total["docs"] else 0.0) or 1.0
    postings = blocks.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    dealt = blocks.repartitionByRange(_parts(postings, TASK_POSTINGS), "term", "run").sortWithinPartitions("term", "value", "run")
    # most blocks have one document, for which no list is walked
    one = F.array(F.struct(F.col("keys")[0].alias("ref_key"), F.col("tfs")[0].alias("tf"), F.col("lengths")[0].alias("dl")))
    docs = F.when(F.col("n") == 1, one).otherwise(F.arrays_zip(F.col("keys").alias("ref_key"), F.col("tfs").alias("tf"), F.col("lengths").alias("dl")))
    tops = F.array_max(F.zip_with("tfs", "lengths", lambda tf, dl: part(tf, dl, F.lit(avgdl))))
    top = F.when(F.col("n") == 1, part(F.col("tfs")[0], F.col("lengths")[0], F.lit(avgdl))).otherwise(tops)
    place = f"segment={segment}"
    dealt.select("term", "value", "run", docs.alias("docs"), "n", top.alias("top")).write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/blocks/{place}")
    df = spark.read.parquet(f"{path}/blocks/{place}").groupBy("term").agg(F.sum("n").cast("long").alias("df"))
    df.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms/{place}")
    documents.repartitionByRange(_parts(total["docs"], TASK_POSTINGS), "ref_key").sortWithinPartitions("ref_key").write.mode("overwrite").parquet(f"{path}/docs/{place}")
    build = F.lit(uuid.uuid4().hex).alias("build")
    stats = spark.range(1).select(build, F.lit(total["docs"]).cast("long").alias("docs"), F.lit(total["total"]).cast("long").alias("total"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats/{place}")


class Index:
    """The segments of an index that are complete, as they were when it was opened."""

    def __init__(self, spark: SparkSession, path: str, segments: list[int] | None = None) -> None:
        self.spark, self.path = spark, path
        try:
            stats = spark.read.option("basePath", f"{path}/stats").parquet(f"{path}/stats")
        except AnalysisException as gone:
            raise ValueError(f"no index at {path}") from gone
        found = {int(r["segment"]): r for r in stats.collect()}  # one row a segment
        self.segments = sorted(found if segments is None else set(found) & set(segments))
        self.builds = {s: r["build"] for s, r in found.items()}
        #: Deletions that still hold, by number.
        self.deletions: list[int] = []
        self.next_deletion, docs, total = 0, 0, 0
        for r in _deletions(spark, path):  # one row a deletion and segment
            self.next_deletion = max(self.next_deletion, r["deletion"] + 1)
            if self.builds.get(r["segment"]) == r["build"]:
                self.deletions = sorted({*self.deletions, r["deletion"]})
                docs, total = docs + r["docs"], total + r["total"]
        self.docs = sum(r["docs"] for r in found.values()) - docs
        self.total = sum(r["total"] for r in found.values()) - total
        self.avgdl = (self.total / self.docs if self.docs else 0.0) or 1.0
        #: By how much a segment's tops are too low under the average length of the whole.
        self.lift = {s: max(1.0, self.avgdl / ((r["total"] / r["docs"] if r["docs"] else 0.0) or 1.0)) for s, r in found.items()}
        self.all_segments = sorted(found)

    def _read(self, name: str, segments: list[int]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={s}" for s in segments])

    def blocks(self) -> DataFrame:
        lift = F.create_map(*[F.lit(x) for s, v in self.lift.items() for x in (s, v)])
        return self._read("blocks", self.segments).withColumn("top", F.col("top") * lift[F.col("segment")])

    def _gone(self, name: str) -> DataFrame:
        """What deletions say of the segments as they are now."""
        rows = self.spark.read.parquet(*[f"{self.path}/gone_{name}/deletion={d}" for d in self.deletions])
        return rows.where(F.col("build").isin(list(self.builds.values())))

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (segment, ref_key, ...) without those of deleted documents."""
        if not self.deletions:
            return rows
        return rows.join(self._gone("keys").select("segment", "ref_key"), ["segment", "ref_key"], "left_anti")

    def documents(self) -> DataFrame:
        """(segment, ref_key, value, run, dl) of the documents of the segments opened."""
        return self.live(self._read("docs", self.segments).select("segment", "ref_key", "value", "run", "dl"))

    def terms(self, only: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """(term, df) over all segments."""
        rows = only(self._read("terms", self.all_segments).select("term", "df"))
        if self.deletions:
            rows = rows.union(only(self._gone("terms").select("term", -F.col("df"))))
        return rows.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def weights(self, queries: DataFrame, tokens=words) -> DataFrame:
        """(query_id, term, df, idf) of the terms of queries (query_id, text) that the index knows."""
        asked = cut(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")))
        return cut(asked.join(self.terms(term_filter(asked)), "term").select("query_id", "term", "df", idf(F.col("df"), F.lit(float(self.docs))).alias("idf")))


def _deletions(spark: SparkSession, path: str) -> list:
    """(deletion, segment, build, docs, total) of the deletions that were completed."""
    try:
        return spark.read.option("basePath", f"{path}/gone_stats").parquet(f"{path}/gone_stats").collect()
    except AnalysisException:  # none yet
        return []


def delete(spark: SparkSession, path: str, keys: DataFrame, dry_run: bool = True, most: int | None = DELETE_MOST) -> int:
    """Takes the documents with a key in ``keys`` (ref_key) out of the index, and returns how many it has.

    More than ``most`` raise and nothing is deleted; a dry run only counts.
    Unknown, null and repeated keys and those deleted before don't count. Only
    runs that hold such a document are read, in one scan of the postings. A later
    segment may bring a deleted key again.
    """
    index = Index(spark, path)
    found = cut(index.documents().join(keys.select("ref_key").distinct(), "ref_key", "left_semi"))
    n = found.count()
    if most is not None and n > most:
        raise ValueError(f"{n} documents match, more than {most}")
    if dry_run or not n:
        return n
    build = F.create_map(*[F.lit(x) for pair in index.builds.items() for x in pair])[F.col("segment")].alias("build")
    # a block and its run's deleted keys are compared as lists, so that no posting becomes a row
    touched = _beside(index.blocks().select("segment", "term", "value", "run", F.col("docs.ref_key").alias("keys")), found, "inner")
    lost = touched.select("segment", "term", F.size(F.array_intersect("keys", "gone")).alias("df")).where("df > 0")
    place = f"deletion={index.next_deletion}"
    found.select("segment", build, "ref_key").write.mode("overwrite").parquet(f"{path}/gone_keys/{place}")
    lost.groupBy("segment", build, "term").agg(F.sum("df").cast("long").alias("df")).write.mode("overwrite").parquet(f"{path}/gone_terms/{place}")
    # written last: a deletion without it doesn't hold
    stats = found.groupBy("segment", build).agg(F.count(F.lit(1)).alias("docs"), F.sum("dl").cast("long").alias("total"))
    stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/gone_stats/{place}")
    return n


def replace(docs: DataFrame, path: str, segment: int, by: str | None = None, tokens=words) -> int:
    """Writes documents as a new segment in place of those that have their keys, and returns how many those were.

    The old ones go first: until the segment is complete, searches find neither.
    """
    try:
        gone = delete(docs.sparkSession, path, docs.select("ref_key"), dry_run=False, most=None)
    except ValueError:  # no index yet
        gone = 0
    write_segment(docs, path, segment, by, tokens)
    return gone


def compact(spark: SparkSession, path: str, segment: int) -> None:
    """Rewrites a segment without its deleted documents; not while it is searched. Runs keep their numbers."""
    index = Index(spark, path, [segment])
    documents = cut(index.documents().drop("segment"))
    blocks = index._read("blocks", [segment]).select("segment", "term", "value", "run", "docs")
    if index.deletions:
        gone = index._read("docs", [segment]).join(index._gone("keys").select("segment", "ref_key"), ["segment", "ref_key"], "left_semi")
        blocks = _beside(blocks, cut(gone), "left")
        left = F.filter("docs", lambda d: ~F.array_contains("gone", d["ref_key"]))
        blocks = blocks.withColumn("docs", F.when(F.coalesce(F.arrays_overlap(F.col("docs.ref_key"), F.col("gone")), F.lit(False)), left).otherwise(F.col("docs")))
    lists = blocks.select("term", "value", "run", F.size("docs").alias("n"), F.col("docs.ref_key").alias("keys"), F.col("docs.tf").alias("tfs"), F.col("docs.dl").alias("lengths"))
    _write(documents, cut(lists.where("n > 0"), "zstd"), path, segment)


def _beside(blocks: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """``blocks`` with gone: the keys of ``found`` (segment, ref_key, value, run) in the block's run, which bounds them."""
    runs = found.groupBy(*[F.col(c).alias(f"r_{c}") for c in ("segment", "value", "run")]).agg(F.collect_set("ref_key").alias("gone"))
    same = (F.col("segment") == F.col("r_segment")) & F.col("value").eqNullSafe(F.col("r_value")) & (F.col("run") == F.col("r_run"))
    return blocks.join(bounded(runs), same, how).drop("r_segment", "r_value", "r_run")


def term_filter(asked: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Leaves of a table the rows of the terms in ``asked``: a list in the scan's filter if it is short, and a range of terms if not."""
    terms = asked.select("term").distinct()
    some = [r["term"] for r in terms.limit(LISTED_TERMS + 1).collect()]
    if len(some) <= LISTED_TERMS:
        return lambda rows: rows.where(F.col("term").isin(some))
    low, high = terms.agg(F.min("term"), F.max("term")).first()
    known = bounded(terms)
    return lambda rows: rows.where(F.col("term").between(low, high)).join(known, "term", "left_semi")


def bounds(index: Index, weights: DataFrame, only: Callable[[DataFrame], DataFrame], inside: DataFrame | None = None) -> DataFrame:
    """(query_id, segment, value, run, blocks, bound): for each run with one of a query's terms what a score there can reach.

    ``inside`` (query_id, value) leaves each query the runs of its values. Reads
    no postings.
    """
    heads = only(index.blocks().select("segment", "term", "value", "run", "top"))
    if inside is not None:
        allowed = inside.select("query_id", F.col("value").cast("string").alias("value")).distinct()
        met = heads.join(weights.join(allowed, "query_id").withColumnRenamed("value", "wants"), ["term"]).where("value = wants").drop("wants")
    else:
        met = heads.join(weights, "term")
    return met.groupBy("query_id", "segment", "value", "run").agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.col("idf") * F.col("top")).alias("bound"))


def _scored(index: Index, weights: DataFrame, only: Callable[[DataFrame], DataFrame], runs: DataFrame, k: int, decimals: int, inside: DataFrame | None = None, least: DataFrame | None = None) -> DataFrame:
    """(query_id, ref_key, segment, score, dl, found): the best k of each query at least of all documents in ``runs`` (query_id, segment, value, run).

    Blocks that hold a query's term are dealt by run and opened once for all
    queries, so that no posting is shuffled once a query. A run that one query
    wants is scored for the others too, which are no less exact for that. ``least``
    (query_id, least) leaves out a query's hits below a score.
    """
    place = ["segment", "value", "run"]
    wanted = cut(runs.select(*[F.col(c).alias(f"r_{c}") for c in place]).distinct())
    parts = _parts(wanted.count(), TASK_RUNS)
    known = weights.select(F.col("term").alias("r_term")).distinct()
    same = (F.col("segment") == F.col("r_segment")) & F.col("value").eqNullSafe(F.col("r_value")) & (F.col("run") == F.col("r_run"))
    blocks = only(index.blocks().select("term", *place, "docs")).join(known, F.col("term") == F.col("r_term"), "left_semi").join(wanted, same, "left_semi")
    # lists of numbers take less room on their way than lists of rows
    lists = blocks.select("term", *place, F.col("docs.ref_key").alias("ref_key"), F.col("docs.tf").alias("tf"), F.col("docs.dl").alias("dl"))
    opened = lambda rows: rows.select("term", *place, F.explode(F.arrays_zip("ref_key", "tf", "dl")).alias("d")).select("term", *place, "d.*")
    dealt = lambda rows: rows.repartition(parts, *place).sortWithinPartitions(*place)
    post = dealt(index.live(opened(lists))) if index.deletions else opened(dealt(lists))
    allowed = None if inside is None else inside.select("query_id", F.col("value").cast("string").alias("value"))
    hits = best_hits(post, weights.select("query_id", "term", "idf"), k, index.avgdl, K1, B, decimals, place, allowed, True, least)
    return hits.select("query_id", "ref_key", "segment", "score", "dl", "found")


def search(index: Index, queries: DataFrame, k: int = 10, inside: DataFrame | None = None, decimals: int = 6, tokens=words) -> tuple[DataFrame, DataFrame]:
    """((query_id, ref_key, segment, score, pos, dl, found), (query_id, blocks, read)): Okapi BM25 over all documents, and the blocks it had and read.

    Statistics cover all segments of the index, hits come from those it was opened
    for. ``inside`` (query_id, value) ranks for a query only documents with one of
    its values. found has each hit's terms of the query and their frequencies.
    Queries without a known word have no rows.
    """
    if not index.segments:
        key = index._read("docs", index.all_segments).schema["ref_key"].dataType.simpleString()
        empty = queries.select("query_id").where("false")
        hits = empty.selectExpr("query_id", f"CAST(null AS {key}) AS ref_key", "0 AS segment", "0D AS score", "1 AS pos", "1 AS dl", "CAST(array() AS array<struct<term:string,tf:int>>) AS found")
        return hits, empty.selectExpr("query_id", "0L AS blocks", "0L AS read")
    weights = index.weights(queries, tokens)
    only = term_filter(weights)
    reach = cut(bounds(index, weights, only, inside))
    place = ["query_id", "segment", "value", "run"]
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "segment", F.col("value").asc_nulls_first(), "run"))
    begun = cut(reach.withColumn("_n", order).where(F.col("_n") <= FIRST_RUNS).drop("_n"))
    first = cut(top_k(_scored(index, weights, only, begun, k, decimals, inside), k))
    least = first.where(F.col("pos") == k).select("query_id", F.col("score").alias("least"))
    rest = reach.join(begun.select(*[F.col(c).alias(f"b_{c}") for c in place]), (F.col("query_id") == F.col("b_query_id")) & (F.col("segment") == F.col("b_segment")) & F.col("value").eqNullSafe(F.col("b_value")) & (F.col("run") == F.col("b_run")), "left_anti")
    rest = cut(rest.join(least, "query_id", "left").where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least"))))
    both = first.drop("pos").unionByName(_scored(index, weights, only, rest, k, decimals, inside, least))
    hits = top_k(both.dropDuplicates(["query_id", "segment", "ref_key"]), k)  # a run may be of both passes
    read = begun.select("query_id", "blocks").unionByName(rest.select("query_id", "blocks")).groupBy("query_id").agg(F.sum("blocks").alias("read"))
    report = reach.groupBy("query_id").agg(F.sum("blocks").alias("blocks")).join(read, "query_id")
    return hits, report


# --- a maintained view of standing queries ------------------------------------------

SPARE = 3


def start_view(index: Index, queries: DataFrame, k: int = 10, tokens=words) -> DataFrame:
    """(query_id, ref_key, segment, score, dl, found, floor, weights, avgdl): for each query its best SPARE * k documents.

    No other document scores above floor, and weights are the terms' inverse
    document frequencies and the average length it was scored with. Queries
    without hits have one row without a document.
    """
    best = SPARE * k
    hits, _ = search(index, queries, best, tokens=tokens)
    floor = hits.groupBy("query_id").agg(F.max(F.when(F.col("pos") == best, F.col("score"))).alias("floor"))
    rows = queries.select("query_id").join(hits.select("query_id", "ref_key", "segment", "score", "dl", "found"), "query_id", "left").join(floor, "query_id", "left")
    return cut(rows.withColumn("floor", F.coalesce("floor", F.lit(0.0))).join(_standing(index, queries, tokens), "query_id", "left"))


def _standing(index: Index, queries: DataFrame, tokens) -> DataFrame:
    """(query_id, weights, avgdl): a map from a query's known terms to their weights; a query bounds it."""
    terms = index.weights(queries, tokens).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("weights"))
    return queries.select("query_id").join(terms, "query_id", "left").withColumn("avgdl", F.lit(index.avgdl))


def refresh_view(view: DataFrame, path: str, new_segments: list[int], queries: DataFrame, k: int = 10, decimals: int = 6, tokens=words) -> tuple[DataFrame, DataFrame]:
    """(view, (query_id, recomputed)): ``view`` brought up to ``new_segments`` and the deletions of the index at ``path``.

    Stored hits that were deleted go; what moves up into their places is known as
    long as enough stored hits are left. A segment that was written anew is one of
    the new ones.

    New documents are scored by themselves, stored ones anew under the present
    statistics from their stored frequencies. Documents that aren't stored scored
    floor at most; under the present statistics a score has grown by at most the
    largest growth of one of the query's weights times that of the average length.
    If the k-th score isn't above that, the query is searched from scratch.
    Queries that the view doesn't have yet are searched as well.
    """
    spark, best = view.sparkSession, SPARE * k
    index = Index(spark, path)
    now = cut(_standing(index, queries, tokens).select("query_id", F.col("weights").alias("w"), F.col("avgdl").alias("a")))
    old = view.join(now, "query_id")
    parts = F.transform("found", lambda t: F.col("w")[t["term"]] * part(t["tf"], F.col("dl"), F.col("a")))
    score = F.round(F.aggregate(parts, F.lit(0.0), lambda x, y: x + y), decimals)
    grown = F.array_max(F.transform(F.map_entries(F.coalesce("weights", F.create_map().cast("map<string,double>"))), lambda e: F.col("w")[e["key"]] / e["value"]))
    growth = F.coalesce(grown, F.lit(1.0)) * F.greatest(F.lit(1.0), F.col("a") / F.col("avgdl"))
    old = cut(old.select("query_id", "ref_key", "segment", score.alias("score"), "dl", "found", (F.col("floor") * growth).alias("floor")))
    fresh, _ = search(Index(spark, path, new_segments), queries, best, tokens=tokens)
    fresh = cut(fresh)
    floors = old.groupBy("query_id").agg(F.max("floor").alias("floor"))
    own = fresh.where(F.col("pos") == best).select("query_id", F.col("score").alias("own"))
    stored = old.where("ref_key is not null").drop("floor")
    if new_segments:
        stored = stored.where(~F.col("segment").isin(new_segments))
    # a compacted segment has no notes of its deletions any more, so what is there decides
    there = cut(index.documents().select("segment", "ref_key").join(stored.select("segment", "ref_key").distinct(), ["segment", "ref_key"], "left_semi"))
    stored = stored.join(there, ["segment", "ref_key"], "left_semi")
    rows = top_k(stored.unionByName(fresh.select("query_id", "ref_key", "segment", "score", "dl", "found")), best)
    rows = cut(rows)
    last = rows.groupBy("query_id").agg(F.max(F.when(F.col("pos") == best, F.col("score"))).alias("last"), F.max(F.when(F.col("pos") == k, F.col("score"))).alias("kth"))
    state = queries.select("query_id").join(floors, "query_id", "left").join(own, "query_id", "left").join(last, "query_id", "left")
    new, floor = F.col("floor").isNull(), F.coalesce("floor", F.lit(0.0))
    # what isn't stored: old ones under the grown floor, new ones under their own last, and those that the merge left out
    above = F.coalesce(F.col("kth"), F.lit(0.0)) > floor + SLACK
    state = cut(state.select("query_id", F.greatest(floor, F.coalesce("own", F.lit(0.0)), F.coalesce("last", F.lit(0.0))).alias("floor"), (new | ((floor > 0) & ~above)).alias("recomputed")))
    good = state.where("NOT recomputed").select("query_id", "floor")
    kept = good.join(rows.drop("pos"), "query_id", "left").join(now.select("query_id", F.col("w").alias("weights"), F.col("a").alias("avgdl")), "query_id")
    kept = kept.select("query_id", "ref_key", "segment", "score", "dl", "found", "floor", "weights", "avgdl")
    again = queries.join(state.where("recomputed").select("query_id"), "query_id", "left_semi")
    out = kept if again.isEmpty() else kept.unionByName(start_view(index, again, k, tokens))
    return cut(out), state.select("query_id", "recomputed")


def view_hits(view: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, ref_key, score, pos) of a maintained view."""
    return top_k(view.where("ref_key is not null").select("query_id", "ref_key", "score"), k)
