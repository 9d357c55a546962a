"""Session helpers: local test sessions and the shared work folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "seastate") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@cache
def _test_dir() -> str:
    return tempfile.mkdtemp(prefix="spark-", dir="/tmp")


@contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings for a while, dots written as two underscores; the former ones come back."""
    conf = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a session on one machine that names none (tests) gets a temporary
    folder, the same one for the life of the process; a cluster must name its own.
    """
    root = spark.conf.get(CHECKPOINT_CONF, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        root = _test_dir()
    return root.rstrip("/")


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, one per use."""
    return f"{shared_dir(spark)}/seastate/{label}-{uuid.uuid4().hex}"


def materialise(df, label: str):
    """Cut lineage through a written table that survives executor loss."""
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """Hadoop's file system for a path, as Spark's own readers use it (a classic session; Spark Connect has none)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path, with its scheme."""
    fs, at = _store(spark, path)
    return fs.makeQualified(at).toString().rstrip("/")


def children(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a folder; none if it is not there."""
    fs, at = _store(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def make(spark: SparkSession, path: str) -> None:
    """Create an empty folder, at once or not at all."""
    fs, at = _store(spark, path)
    fs.mkdirs(at)


def delete(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete files and folders that are no longer needed."""
    for p in paths:
        fs, at = _store(spark, p)
        fs.delete(at, True)
