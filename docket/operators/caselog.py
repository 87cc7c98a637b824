"""Case event logs: versions, staleness, state, run admission, work queue.

Logs are append-only rows (case, stage, action, ts, event_id). Window state is
bounded by a case's own log.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.session import cut

DEAD_MINUTES = 20
LOG_BUCKETS, SKETCH_K, SKETCH_RANK_ERROR = 12, 200, 0.0165
STAGES = (1, 2, 3, 4, 5)


def ordered(*by: str):
    return W.partitionBy(*by).orderBy("ts", "event_id")


def versions(starts: DataFrame) -> DataFrame:
    """Each start of a case's stage gets the next number, so failed runs keep theirs."""
    return starts.withColumn("version", F.row_number().over(ordered("case_id", "stage")))


def latest(numbered: DataFrame, value_cols: list[str]) -> DataFrame:
    """(case, stage, version, values) of the last version."""
    best = F.max_by(F.struct("version", *value_cols), "version")
    return numbered.groupBy("case_id", "stage").agg(best.alias("b")).select("case_id", "stage", "b.*")


def version_list(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("case_id", "stage").agg(F.array_sort(F.collect_list("version")).alias("versions"))


def based_on(numbered: DataFrame) -> DataFrame:
    """``numbered`` (integer stage) with based_on, the version of the stage before at its start, and stale.

    An as-of join by one window: starts of stage n and of n - 1 in one order,
    the last version of the latter so far.
    """
    own = numbered.select("case_id", "stage", "ts", "event_id", "version", F.lit(1).alias("_own"), F.lit(None).cast("int").alias("_prev"))
    before = numbered.select("case_id", (F.col("stage") + 1).alias("stage"), "ts", "event_id", F.lit(None).cast("int").alias("version"), F.lit(0).alias("_own"), F.col("version").alias("_prev"))
    over = W.partitionBy("case_id", "stage").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    both = own.union(before).withColumn("based_on", F.last("_prev", ignorenulls=True).over(over))
    newest = F.max("_prev").over(W.partitionBy("case_id", "stage"))
    out = both.withColumn("_newest", newest).where("_own = 1")
    stale = F.coalesce(F.coalesce("based_on", F.lit(0)) < F.col("_newest"), F.lit(False))
    return out.select("case_id", "stage", "version", "based_on", stale.alias("stale"))


def stale_stages(changes: DataFrame, impact: DataFrame, status: DataFrame, default: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """(case, stage): finished stages that a changed field affects.

    A field that isn't listed affects the default stages, one listed with an
    empty list none.
    """
    out = changes.select("case_id", "field").distinct().join(impact, "field", "left")
    hit = out.select("case_id", F.explode(F.coalesce("stages", F.array(*[F.lit(s) for s in default]))).alias("stage")).distinct()
    return hit.join(status.where(F.col("status").isin("done", "confirmed")).select("case_id", "stage"), ["case_id", "stage"])


def fold_status(events: DataFrame, changes: dict[str, str]) -> DataFrame:
    """``events`` with case_status after each: set by the last action that changes it."""
    new = F.lit(None).cast("string")
    for action, state in changes.items():
        new = F.when(F.col("action") == action, state).otherwise(new)
    over = ordered("case_id").rowsBetween(W.unboundedPreceding, 0)
    return events.withColumn("case_status", F.coalesce(F.last(new, ignorenulls=True).over(over), F.lit("new")))


def next_stage(status: Column, table: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, stage in table.items():
        out = F.when(status == name, stage).otherwise(out)
    return out


def admission(requests: DataFrame, expected: Column, minutes: int = DEAD_MINUTES) -> DataFrame:
    """Requests (start events with prior action, prior ts, finished before) with allowed and why; ages in whole seconds, as in ``dead_runs``."""
    over = ordered("case_id", "stage")
    last, at = F.lag("action").over(over), F.lag("ts").over(over)
    done = F.max(F.when(F.col("action") == "done", 1)).over(over.rowsBetween(W.unboundedPreceding, -1))
    rows = requests.withColumn("_last", last).withColumn("_at", at).withColumn("_done", done)
    running = F.col("_last") == "start"
    young = F.unix_timestamp("ts") - F.unix_timestamp("_at") <= minutes * 60
    why = F.when(running & young, "running").when(running, "dead run").when(expected, "expected").when(F.col("_done") == 1, "finished before").otherwise("not its turn")
    return rows.where("action = 'start'").withColumn("reason", why).withColumn("allowed", ~F.col("reason").isin("running", "not its turn")).drop("_last", "_at", "_done")


def dead_runs(events: DataFrame, minutes: int = DEAD_MINUTES) -> DataFrame:
    """Starts without a finish within ``minutes`` (strictly more is dead), and how long they took."""
    finish = F.when(F.col("action").isin("done", "failed"), F.col("ts"))
    over = ordered("case_id", "stage").rowsBetween(1, W.unboundedFollowing)
    rows = events.withColumn("finished", F.first(finish, ignorenulls=True).over(over)).where("action = 'start'")
    seconds = F.unix_timestamp("finished") - F.unix_timestamp("ts")
    return rows.withColumn("seconds", seconds).withColumn("dead", F.coalesce(seconds > minutes * 60, F.lit(True)))


def accepted_starts(starts: DataFrame, minutes: int = DEAD_MINUTES) -> DataFrame:
    """Starts that count: one within ``minutes`` of the last that counted is ignored.

    Partitions are sorted and walked once; only the case at hand and its last start
    are held, so a case may have any number of starts.
    """
    wait = timedelta(minutes=minutes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, last = None, None
        for batch in batches:
            keep = []
            for case, stage, t in zip(batch["case_id"], batch["stage"], batch["ts"], strict=True):
                if (case, stage) != here:
                    here, last = (case, stage), None
                fine = last is None or t - last > wait
                keep.append(fine)
                last = t if fine else last
            yield batch.assign(accepted=keep)

    kinds = ", ".join(f"{n} {t}" for n, t in starts.dtypes)
    dealt = starts.repartition("case_id", "stage").sortWithinPartitions("case_id", "stage", "ts", "event_id")
    return dealt.mapInPandas(run, kinds + ", accepted boolean")


def accepted_by_pointers(starts: DataFrame, minutes: int = DEAD_MINUTES) -> DataFrame:
    """``accepted_starts`` by joins: every start points to the next that would count after it, and pointers are doubled.

    The first start of a case's stage counts. In round r the starts up to 2^r
    pointers from it are known and pointers of 2^r steps are joined to make those of
    twice as many, so rounds grow with the logarithm of the longest chain. A
    pointer is the nearest start later than the limit, by one running window.
    """
    key, wait = ["case_id", "stage"], minutes * 60 * 1_000_000
    rows = cut(starts.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("_n", F.monotonically_increasing_id()))
    none = F.lit(None).cast("long")
    at = F.struct("_us", "event_id", "_n")
    begins = rows.select(*key, F.col("_us").alias("_at"), F.lit(1).alias("_start"), "event_id", at.alias("_to"), none.alias("_from"))
    limits = rows.select(*key, (F.col("_us") + wait).alias("_at"), F.lit(0).alias("_start"), "event_id", F.lit(None).cast(dict(begins.dtypes)["_to"]).alias("_to"), F.col("_n").alias("_from"))
    # from the latest back: at a limit the last start seen is the earliest one after it
    back = W.partitionBy(*key).orderBy(F.desc("_at"), "_start", F.desc("event_id")).rowsBetween(W.unboundedPreceding, 0)
    jumps = begins.unionAll(limits).withColumn("_next", F.last("_to", ignorenulls=True).over(back)).where("_start = 0 AND _next IS NOT NULL")
    jumps = cut(jumps.select("_from", F.col("_next._n").alias("_to")))
    reached = [cut(rows.groupBy(*key).agg(F.min(at).alias("_f")).select(F.col("_f._n").alias("_n")))]
    while True:
        known = reached[0]
        for more in reached[1:]:
            known = known.unionAll(more)
        fresh = cut(known.join(jumps, F.col("_n") == F.col("_from")).select(F.col("_to").alias("_n")))
        if fresh.isEmpty():
            break
        reached.append(fresh)
        jumps = cut(jumps.alias("a").join(jumps.alias("b"), F.col("a._to") == F.col("b._from")).select("a._from", "b._to"))
    out = rows.join(known.withColumn("accepted", F.lit(True)), "_n", "left")
    return out.select(*starts.columns, F.coalesce("accepted", F.lit(False)).alias("accepted"))


def daily_sketches(runs: DataFrame) -> DataFrame:
    """(day, stage, runs, cases, seconds): runs with mergeable sketches of their different cases and of their seconds.

    ``runs``: case_id, stage, ts, seconds (null for none). A day's row never has
    to be computed again; see ``merged_sketches``.
    """
    return runs.groupBy(F.to_date("ts").alias("day"), "stage").agg(F.count(F.lit(1)).alias("runs"), F.hll_sketch_agg("case_id", LOG_BUCKETS).alias("cases"), F.kll_sketch_agg_bigint(F.col("seconds").cast("long"), SKETCH_K).alias("seconds"))


def merged_sketches(daily: DataFrame, by: list[str], shares: tuple[float, ...] = (0.5, 0.9)) -> DataFrame:
    """(by..., runs, cases, q50, q90, ...): sketches of many days as one.

    Different cases have a relative standard error of 1.04 / sqrt(2^LOG_BUCKETS);
    a quantile's rank is off by SKETCH_RANK_ERROR at most, but for one time in a hundred.
    """
    out = daily.groupBy(*by).agg(F.sum("runs").alias("runs"), F.hll_sketch_estimate(F.hll_union_agg("cases", False)).alias("cases"), F.kll_merge_agg_bigint("seconds").alias("_s"))
    quantiles = [F.kll_sketch_get_quantile_bigint("_s", F.lit(float(s))).alias(f"q{round(100 * s)}") for s in shares]
    return out.select(*by, "runs", "cases", *quantiles)


def trail(events: DataFrame, detail: str, most: int = 4000) -> DataFrame:
    """Events of a case in order, detail cut."""
    return events.select("case_id", F.row_number().over(ordered("case_id")).alias("pos"), "ts", "action", F.left(F.col(detail), F.lit(most)).alias("detail"))


def counts_over_time(events: DataFrame, length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window_start, action, n) in tumbling or sliding windows."""
    out = events.groupBy(F.window("ts", length, slide) if slide else F.window("ts", length), "action").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "action", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(case, session_start, session_end, n): events of a case no further apart than the gap."""
    out = events.groupBy("case_id", F.session_window("ts", gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select("case_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def patched(fields: DataFrame, patches: DataFrame, editable: list[str]) -> DataFrame:
    """(case, key, value, confidence, method, changed): editable patches replace, with high confidence, by hand."""
    ok = patches.where(F.col("key").isin(*editable)).select("case_id", "key", F.col("value").alias("_new"))
    out = fields.join(ok, ["case_id", "key"], "left")
    has = F.col("_new").isNotNull()
    return out.select("case_id", "key", F.coalesce("_new", "value").alias("value"), F.when(has, "high").otherwise(F.col("confidence")).alias("confidence"), F.when(has, "manual").otherwise(F.col("method")).alias("method"), (has & ~F.col("_new").eqNullSafe(F.col("value"))).alias("changed"))


def merged_summary(updates: DataFrame) -> DataFrame:
    """(case, key, value): the last value of a key that isn't empty."""
    filled = updates.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    return filled.groupBy("case_id", "key").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))


def finalised(cases: DataFrame, sections: DataFrame, claims: DataFrame, done: DataFrame, section_least: int = 30, claim_least: int = 10) -> DataFrame:
    """Units of archived cases that aren't indexed: long enough sections and claims, claims with their section."""
    ready = cases.where("archived").select("case_id").join(done.select("case_id"), "case_id", "left_anti")
    s = sections.join(ready, "case_id").where(F.length("text") >= section_least)
    c = claims.join(ready, "case_id").where(F.length("text") >= claim_least)
    linked = s.select("case_id", "claim_id", F.col("ref_key").alias("linked_reason"))
    a = s.select("case_id", "ref_key", F.lit("reason").alias("unit_type"), F.lit(None).cast("string").alias("linked_reason"), "text")
    b = c.join(linked, ["case_id", "claim_id"], "left").select("case_id", "ref_key", F.lit("claim").alias("unit_type"), "linked_reason", "text")
    return a.unionByName(b)


def work_stage(stages: Column, archived: Column) -> Column:
    """Where a case stands, first match: archived, failed, running, waiting to be confirmed, else open. ``stages``: map to status."""
    values = F.map_values(stages)
    has = lambda s: F.exists(values, lambda v: v == s)
    return F.when(archived, "archived").when(has("failed"), "failed").when(has("running"), "running").when(has("done"), "to confirm").otherwise("open")


def priority(remaining: Column, overdue: Column) -> Column:
    return F.when(remaining.isNull(), "normal").when(overdue | (remaining <= 3), "critical").when(remaining <= 7, "high").when(remaining <= 14, "medium").otherwise("normal")


def tags(named: dict[str, Column]) -> Column:
    """The names whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in named.items()]))


def quadrant(machine: Column, human: Column) -> Column:
    """Agreement of two nullable flags."""
    return F.when(machine.isNull() | human.isNull(), "open").when(machine & human, "both").when(machine, "machine only").when(human, "human only").otherwise("neither")


def queue(rows: DataFrame, needle: str, cols: list[str]) -> DataFrame:
    """Rows in which any column contains the words, whatever their case."""
    return rows.where(F.lower(F.concat_ws(" ", *cols)).contains(needle.lower()))


def progress(cases: DataFrame, last: DataFrame, stages: tuple[int, ...] = STAGES) -> DataFrame:
    """One row for each case and stage, those never started included."""
    grid = cases.select("case_id", F.explode(F.array(*[F.lit(s) for s in stages])).alias("stage"))
    out = grid.join(last, ["case_id", "stage"], "left")
    return out.withColumn("status", F.coalesce("status", F.lit("not started")))
