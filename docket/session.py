"""Session, shared scratch space and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "docket", **conf: str) -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the cluster's spark.checkpoint.dir.

    Only where the session names none and its master is local (tests, a laptop) a
    fresh local folder is made and set; on a cluster that raises, since executors
    don't see the driver's folders.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    context = spark.sparkContext
    known = context.getCheckpointDir()
    if known is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docket-"))
        known = context.getCheckpointDir()
    return known.rstrip("/")


def cut(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The result has no lineage beyond those files, so a lost executor costs a
    re-read and never a recomputation. Columns that Parquet can't hold (void)
    become strings. Executors get this package first, so operators work from any
    program that imports them.
    """
    spark = df.sparkSession
    ship_package(spark)
    void = {c: df[c].cast("string") for c, kind in df.dtypes if kind == "void"}
    path = f"{scratch_root(spark)}/docket-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    df.withColumns(void).write.option("compression", compression).parquet(path)
    return spark.read.schema(df.withColumns(void).schema).parquet(path)


_written: dict[str, list[str]] = {}


def drop_cuts(spark: SparkSession) -> int:
    """Deletes the tables that ``cut`` wrote in this application, and gives their number.

    Call it when results that read them are written or no longer needed.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once for a Spark context."""
    context = spark.sparkContext
    if getattr(context, "_docket_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="docket-py-"), "docket_code.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("docket", os.path.relpath(full, here)))
    context.addPyFile(target)
    context._docket_shipped = True
