"""Session settings the operators rely on."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


# recording a Python call site per column expression costs seconds on wide plans
CALL_SITES = "spark.python.sql.dataFrameDebugging.enabled"


def build_session(app: str = "breezeframe", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time and adaptive execution; ``conf`` overrides any setting."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        CALL_SITES: "false",
        # wide aggregates (correlations, lag products) stay in generated code
        "spark.sql.codegen.maxFields": "1000",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Hour-of-day and date logic is defined on UTC, whatever zone the session came with."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    A cluster names it in ``spark.checkpoint.dir``, and without that setting a cluster run
    is an error. Only a local master (tests, laptops) gets a private temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir", None
    )
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.mkdtemp(prefix="breezeframe-")
    return _LOCAL_DIR


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below :func:`shared_dir`; never reused, so nothing is overwritten."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut of lineage that outlives
    any executor. Meant for parameter tables, or rows that several passes re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str):
    """:func:`materialise` for the length of a ``with`` block: the files go at its end."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    try:
        yield df.sparkSession.read.schema(df.schema).parquet(path)
    finally:
        discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder of :func:`scratch_path` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


_LOCAL_DIR: str | None = None
