"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import functools
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

from pyspark.sql import DataFrame, SparkSession

Stage = Callable[[DataFrame, str], DataFrame]

CHECKPOINT_CONF = "spark.checkpoint.dir"
LARGE_BYTES = 16 << 20


def build_session(app: str = "mailverdict", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans are tuned for; `conf` keys use `__` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # mails and notices are small files; a higher opening cost would give each task only a few
        .config("spark.sql.files.openCostInBytes", "524288")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@functools.cache
def _own_base(application: str) -> str:
    return tempfile.mkdtemp(prefix="mailverdict-")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the one the cluster shares between its executors.

    The cluster names it in `spark.checkpoint.dir`. Where that is unset and all tasks run in the driver's
    own process, as in tests on one machine, a temporary folder of the application takes its place. On
    a cluster there is no such stand-in: each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    base = spark.conf.get(CHECKPOINT_CONF, None) or context.getConf().get(CHECKPOINT_CONF)
    if not base:
        if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master or ""):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        base = _own_base(context.applicationId)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def hadoop_path(spark: SparkSession, path: str):
    """File system and path object of a folder or file, through Spark's own connectors."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that `shared_dir` named."""
    files, folder = hadoop_path(spark, path)
    files.delete(folder, True)


def let_go(spark: SparkSession, written: str) -> None:
    """Let Spark remove the shuffle files of the steps that led to a written table, if that is a large one.

    It does so only when the driver collects garbage, which else may come long after several such steps. What the first
    round finds lets go of the shuffles, which the second one finds.
    """
    files, folder = hadoop_path(spark, written)
    if files.exists(folder) and files.getContentSummary(folder).getLength() >= LARGE_BYTES:
        gc.collect()
        for _ in range(2):
            spark.sparkContext._jvm.System.gc()
            time.sleep(0.2)


def passing_dir(spark: SparkSession, label: str) -> str:
    """A folder as `shared_dir` names it, removed when the process ends: for checks and benches."""
    path = shared_dir(spark, label)

    def drop() -> None:
        with suppress(Exception):  # the session may have ended first
            drop_dir(spark, path)

    atexit.register(drop)
    return path


def keep(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back; it stays until the process ends."""
    path = passing_dir(df.sparkSession, label)
    df.write.parquet(path)
    let_go(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staging(spark: SparkSession, below: str | None = None) -> Iterator[Stage]:
    """Give out a function that writes an intermediate table to the shared folder and reads it back.

    With `below` the tables lie in a folder there, for example beside the stored tables, which executors
    share anyway. Later steps read such a table more than once, and a lost executor then costs a file read, not
    the work that led to it. The tables are removed at the end.
    """
    paths: list[str] = []

    def stage(df: DataFrame, label: str) -> DataFrame:
        path = f"{below.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}" if below else shared_dir(spark, label)
        paths.append(path)
        df.write.parquet(path)
        let_go(spark, path)
        return spark.read.schema(df.schema).parquet(path)

    try:
        yield stage
    finally:
        for path in paths:
            drop_dir(spark, path)
