"""Corpus scans, staged loads, rebuilds, deletes, routed and bundled sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.operators.canonical import bounded
from docket.operators.ordering import in_order

DELETE_MOST = 500
ROUTE_BYTES = 300 * 1024


def scan_files(spark: SparkSession, root: str, category: str, extension: str = "txt") -> DataFrame:
    """(file, text): whole files of one category with one extension, subfolders included."""
    rows = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extension}").load(f"{root}/{category}")
    return rows.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def scan_category(units: DataFrame, category_col: str, category: str, id_col: str) -> DataFrame:
    """Units of one category, numbered in the order of their ids; the filter reaches the scan."""
    return in_order(units.where(F.col(category_col) == category), id_col)


def stage(units: DataFrame, path: str, by: str) -> DataFrame:
    """Writes parsed units to a staging area by category and reads it back."""
    units.write.mode("overwrite").partitionBy(by).parquet(path)
    return units.sparkSession.read.parquet(path)


def staged_report(staged: DataFrame, by: str, file_col: str, order: str, text_col: str, checks: dict[str, Column], sample_chars: int = 80) -> tuple[DataFrame, DataFrame]:
    """What to look at before a load: (a row a category, a row a file).

    A category has its files, units, units of each check that holds (named after
    it), and the beginning of its first unit as a sample. A file has its units,
    its longest one, and how many units some check holds for.
    """
    bad = F.lit(False)
    for c in checks.values():
        bad = bad | F.coalesce(c, F.lit(False))
    first = F.min_by(F.left(F.col(text_col), F.lit(sample_chars)), F.struct(file_col, order))
    category = staged.groupBy(by).agg(F.countDistinct(file_col).alias("files"), F.count(F.lit(1)).alias("units"), *[F.count_if(c).alias(n) for n, c in checks.items()], first.alias("sample"))
    files = staged.groupBy(by, file_col).agg(F.count(F.lit(1)).alias("units"), F.max(F.length(text_col)).alias("longest"), F.count_if(bad).alias("problems"))
    return category, files


def load(units: DataFrame, routes: dict[str, Column], root: str, by: str, mode: str = "append") -> None:
    """Appends each route's units to its own table, partitioned; routes don't overlap."""
    for name, condition in routes.items():
        units.where(condition).write.mode(mode).partitionBy(by).parquet(f"{root}/{name}")


def rebuild(units: DataFrame, routes: dict[str, Column], root: str, by: str) -> None:
    """Drops and writes anew: appending again would only double the rows."""
    load(units, routes, root, by, "overwrite")


def replace_categories(units: DataFrame, root: str, by: str, version: int) -> list:
    """Replaces the categories that ``units`` hold by them, as ``version``; gives their values.

    Units are staged as ``root/units/<by>=.../_version=...``. Overwriting is dynamic,
    so only partitions of these categories and this version are touched, and a
    repeated attempt replaces what a failed one left. Then one small table is
    appended to ``root/commits``: only what is committed is read, so readers see
    the old units or the new ones and never half. A category that has no units
    any more can't be told from one that isn't meant; replace it by none with ``drop_categories``.
    """
    spark = units.sparkSession
    staged = units.withColumn("_version", F.lit(version))
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "_version").parquet(f"{root}/units")
    there = units.select(by).distinct().withColumn("_version", F.lit(version))
    _commit(there, root)
    return [r[0] for r in spark.read.parquet(f"{root}/commits").where(F.col("_version") == version).select(by).distinct().collect()]


def drop_categories(spark: SparkSession, root: str, by: str, values: list, version: int) -> None:
    """Readers no longer see these categories from ``version`` on."""
    kind = dict(spark.read.parquet(f"{root}/commits").dtypes)[by]
    _commit(spark.createDataFrame([(v,) for v in values], f"`{by}` {kind}").withColumn("_version", F.lit(version)), root)


def _commit(rows: DataFrame, root: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def read_categories(spark: SparkSession, root: str, by: str) -> DataFrame:
    """The committed units: of each category the newest version, whatever else lies there."""
    commits = spark.read.parquet(f"{root}/commits")
    newest = commits.groupBy(by).agg(F.max("_version").alias("_version"))
    kind = dict(commits.dtypes)[by]
    units = spark.read.parquet(f"{root}/units").withColumn(by, F.col(by).cast(kind))
    return units.join(bounded(newest), [by, "_version"], "left_semi").drop("_version")


def details_loaded(events: DataFrame, detail: str) -> DataFrame:
    """``events`` with the JSON text of ``detail`` parsed once into a VARIANT; text that isn't JSON is null."""
    return events.withColumn(detail, F.try_parse_json(F.col(detail)))


def audit_details(rows: DataFrame, sort_key: str, prefix: str, by: str, detail: str, fields: dict[str, str]) -> DataFrame:
    """``audit_read`` over parsed details: (by, pos, sort_key, fields), each field read by its type, null if it doesn't fit."""
    picked = rows.where(F.col(sort_key).startswith(prefix))
    got = [F.try_variant_get(F.col(detail), f"$.{name}", kind).alias(name) for name, kind in fields.items()]
    pos = F.row_number().over(W.partitionBy(by).orderBy(sort_key))
    return picked.select(by, pos.alias("pos"), sort_key, *got)


def delete_where(units: DataFrame, col: str, value, dry_run: bool = True, most: int | None = DELETE_MOST) -> tuple[DataFrame, int]:
    """(what stays, rows that match); more than ``most`` matches raise. A dry run keeps all."""
    n = units.where(F.col(col).eqNullSafe(F.lit(value))).count()
    if most is not None and n > most:
        raise ValueError(f"{n} rows match, more than {most}")
    return (units if dry_run else units.where(~F.col(col).eqNullSafe(F.lit(value)))), n


def build_all(units: DataFrame, category_col: str, root: str, parse, categories: list[str] | None = None, most_rows: int | None = None) -> DataFrame:
    """Parses and loads categories in order into one partitioned table, and reports (category, status, n).

    ``categories`` None stands for all, by name; units without a category are left
    out. With ``most_rows`` the build stops before the first category with which
    more source rows would be read than that: it and those after it are
    ``stopped``, to be given to a later call. All that is built is one write, so
    it is there whole or not at all; counts come from what was written.
    """
    spark = units.sparkSession
    sizes = units.where(F.col(category_col).isNotNull()).groupBy(F.col(category_col).cast("string").alias("category")).agg(F.count(F.lit(1)).alias("rows"))
    if categories is None:
        plan = sizes.withColumn("place", F.col("category"))
    else:
        named = spark.createDataFrame([(c, f"{i:09d}") for i, c in enumerate(categories)], "category string, place string")
        plan = named.join(sizes, "category", "left").select("category", F.coalesce("rows", F.lit(0)).alias("rows"), "place")
    upto = F.sum("rows").over(W.orderBy("place").rowsBetween(W.unboundedPreceding, 0))  # a row a category
    plan = plan.withColumn("status", F.when(F.lit(most_rows is not None) & (upto > F.lit(most_rows)), "stopped").otherwise("built")).drop("place", "rows")
    taken = units.join(bounded(plan.where("status = 'built'").select(F.col("category").alias(category_col))), category_col, "left_semi")
    parse(taken).withColumn("category", F.col(category_col).cast("string")).write.mode("overwrite").partitionBy("category").parquet(root)
    loaded = spark.read.schema("category string").parquet(root).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return plan.join(loaded, "category", "left").select("category", "status", F.coalesce("n", F.lit(0)).alias("n"))


def unfinalise(spark: SparkSession, rows: DataFrame, flags: DataFrame, cases: DataFrame, case_col: str, root: str) -> tuple[DataFrame, DataFrame]:
    """(rows, flags) after cases are taken back: two writes, the rows' always first.

    First the index's rows without those of the cases are written, whether or not
    a case's flag is set; only when that is done are indexed, indexed_at and
    status_note of the cases cleared. If the first write fails, the flags still
    say what the index holds.
    """
    gone = cases.select(case_col).distinct()
    rows.join(gone, case_col, "left_anti").write.mode("overwrite").parquet(f"{root}/rows")
    marked = flags.join(gone.withColumn("_gone", F.lit(True)), case_col, "left")
    cleared = {"indexed": F.when(F.col("_gone"), F.lit(False)).otherwise(F.col("indexed"))} | {c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("indexed_at", "status_note")}
    marked.withColumns(cleared).select(*flags.columns).write.mode("overwrite").parquet(f"{root}/flags")
    return spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/flags")


def with_defaults(default: DataFrame, stored: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, is_default): stored values over built-in ones."""
    s = stored.select(key, F.col(value).alias("_stored"))
    return default.join(s, key, "left").select(key, F.coalesce("_stored", value).alias(value), F.col("_stored").isNull().alias("is_default"))


def config_problems(rules: DataFrame, known: DataFrame, check_col: str, id_col: str, required: list[str], stage_col: str) -> DataFrame:
    """(id, problem): missing required keys, unknown checks, stage numbers outside 1 to 5. Write only if empty."""
    unknown = rules.join(known.select(check_col).distinct(), check_col, "left_anti").select(id_col, F.lit("unknown check").alias("problem"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), F.lit(f"no {c}")) for c in required]))
    gone = rules.select(id_col, F.explode(missing).alias("problem"))
    stages = rules.where(~F.forall(stage_col, lambda s: s.between(1, 5))).select(id_col, F.lit("stage outside 1 to 5").alias("problem"))
    return unknown.union(gone).union(stages)


def case_list(rows: DataFrame, keep: Column, time_col: str, id_col: str) -> DataFrame:
    """Kept rows with pos, newest first."""
    return in_order(rows.where(keep), F.col(time_col).desc_nulls_last(), F.col(id_col))


def audit_read(events: DataFrame, key_col: str, prefix: str, case_col: str, detail_col: str, fields: dict[str, str]) -> DataFrame:
    """Events whose sort key begins with the prefix, in order, their JSON detail decoded."""
    rows = events.where(F.col(key_col).startswith(prefix))
    got = [F.get_json_object(detail_col, f"$.{k}").cast(t).alias(k) for k, t in fields.items()]
    return rows.withColumn("pos", F.row_number().over(W.partitionBy(case_col).orderBy(key_col))).select(case_col, "pos", key_col, *got)


def route_by_size(rows: DataFrame, body: str, most: int = ROUTE_BYTES) -> DataFrame:
    """``rows`` with bytes and target: bodies over ``most`` bytes go to the second store."""
    return rows.withColumn("bytes", F.octet_length(body)).withColumn("target", F.when(F.col("bytes") > most, "object").otherwise("row"))


def write_routed(rows: DataFrame, body: str, id_col: str, root: str, most: int = ROUTE_BYTES) -> None:
    """Two writes: small bodies in their rows, large ones apart with a pointer left behind."""
    routed = route_by_size(rows, body, most)
    routed.select(id_col, F.when(F.col("target") == "row", F.col(body)).alias(body), "target").write.mode("overwrite").parquet(f"{root}/rows")
    routed.where("target = 'object'").select(id_col, F.col(body).alias("object")).write.mode("overwrite").parquet(f"{root}/objects")


def read_routed(spark: SparkSession, body: str, id_col: str, root: str) -> DataFrame:
    rows, objects = spark.read.parquet(f"{root}/rows"), spark.read.parquet(f"{root}/objects")
    return rows.join(objects, id_col, "left").select(id_col, F.coalesce(body, "object").alias(body))


def bundle(cases: DataFrame, parts: dict[str, DataFrame], case_col: str) -> DataFrame:
    """(case, document): one JSON document a case with the ordered rows of each part."""
    out = cases
    for name, part in parts.items():
        cols = [c for c in part.columns if c != case_col]
        lists = part.groupBy(case_col).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
        out = out.join(lists, case_col, "left")
    return out.select(case_col, F.to_json(F.struct(*out.columns)).alias("document"))


def write_bundles(bundles: DataFrame, case_col: str, version_col: str, root: str, shards: int = 64) -> None:
    """Bundles as JSON lines by version and shard of cases: a folder a case would be far too many."""
    shard = F.pmod(F.xxhash64(case_col), F.lit(shards))
    bundles.withColumn("shard", shard).write.mode("overwrite").partitionBy(version_col, "shard").option("ignoreNullFields", False).json(root)


def rendered(sections: DataFrame, by: str, no: str, text: str, head: Column, flagged: Column, mark: str = " [check]") -> DataFrame:
    """(by, document): header, then numbered sections joined by blank lines, flagged ones marked."""
    line = F.concat(F.col(no).cast("string"), F.lit(". "), F.col(text), F.when(flagged, mark).otherwise(""))
    lists = sections.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), line.alias("line")))).alias("l"), F.first(head).alias("h"))
    return lists.select(by, F.concat(F.col("h"), F.lit("\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n\n")).alias("document"))
