"""Session helpers: a tuned local builder and lineage cutting on shared storage."""

from __future__ import annotations

import os
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "pathatlas", cores: str = "8", shuffle_partitions: int | None = None) -> SparkSession:
    """Local session for tests and benchmarks; a cluster brings its own session."""
    parts = shuffle_partitions or (int(cores) if cores.isdigit() else os.cpu_count() or 8)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the session names; only a local session may fall back to a folder of its own.

    On a cluster a machine-local folder would hold a part of the rows on every executor, so there
    an unset ``spark.checkpoint.dir`` is an error.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="pathatlas-ckpt-")
    sc.setCheckpointDir(shared)


_written: list[str] = []
_steps = threading.local()  # for each step that is open, the tables written in it
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def release_cuts(spark: SparkSession) -> None:
    """Delete the tables that ``cut_lineage`` wrote, once no result that reads them is needed any more."""
    while _written:
        _delete(spark, [_written.pop()])


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write the rows to a table in the shared checkpoint folder and read them back.

    The written table survives executor loss, is computed once (a plain checkpoint
    computes twice), keeps columns prunable and gives later plans a short lineage. The
    shuffle files of the write go with its end. ``keep`` holds the table beyond the step
    (``settle``) in which it is written.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/cut-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    _written.append(path)
    if not keep and getattr(_steps, "open", None):
        _steps.open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def settle(make: Callable[[], DataFrame], keep: bool = False) -> DataFrame:
    """``cut_lineage`` of what ``make`` returns; the tables written on the way, which nothing else reads, are deleted.

    So the disk holds what one step needs and the results of the steps before, not the work of all steps.
    """
    if not hasattr(_steps, "open"):
        _steps.open = []
    _steps.open.append([])
    try:
        df = make()
        mine = list(_steps.open[-1])
    finally:
        _steps.open.pop()
    out = cut_lineage(df, keep)
    _delete(df.sparkSession, mine)
    _written[:] = [p for p in _written if p not in mine]
    return out
