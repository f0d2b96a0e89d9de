"""Session settings, shared folder and staged tables.

The library never touches static configuration. ``configure`` sets only runtime SQL options, so it is
safe to call on a session that somebody else built.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

RUNTIME_SETTINGS = {
    # Timestamps are zone-free (TIMESTAMP_NTZ); UTC keeps elapsed-time arithmetic free of DST jumps.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A hot join key is split over several tasks.
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every plan in this package assumes."""
    for key, value in RUNTIME_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "shopgrain", master: str | None = None, **settings: str) -> SparkSession:
    """A configured session; ``settings`` override or extend the defaults."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


@lru_cache(maxsize=None)
def _own_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="shopgrain-")


def name_local_folder(spark: SparkSession) -> SparkSession:
    """For checks, benchmarks and tests on one machine: name a temporary folder where none is named.

    The library itself never calls this. A session on a cluster is left as it is.
    """
    if not spark.conf.get("spark.checkpoint.dir", None) and re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        spark.conf.set("spark.checkpoint.dir", _own_dir(spark.sparkContext.applicationId))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the driver and all executors")
    return named.rstrip("/")


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for an intermediate table in the shared folder."""
    return f"{shared_dir(spark)}/shopgrain/{name}-{uuid.uuid4().hex}"


_OWNERS: list[list[str]] = []


@contextmanager
def staged(spark: SparkSession) -> Iterator[None]:
    """Owns the stages written inside the block and deletes them at its end.

    Write or collect what is wanted inside; tables that read a stage cannot be read after it.
    """
    paths: list[str] = []
    _OWNERS.append(paths)
    try:
        yield
    finally:
        _OWNERS.remove(paths)
        hadoop = spark._jsc.hadoopConfiguration()
        for path in paths:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)


@contextmanager
def mounted(spark: SparkSession, path: str | None) -> Iterator[str | None]:
    """A folder of the shared folder as a path that tasks can open, for the length of the block; None if it is not a mounted one."""
    hadoop = spark._jsc.hadoopConfiguration()
    folder = spark._jvm.org.apache.hadoop.fs.Path(path) if path else None
    system = folder.getFileSystem(hadoop) if path else None
    if not path or system.getScheme() != "file":
        yield None
        return
    system.mkdirs(folder)
    try:
        yield folder.toUri().getPath()
    finally:
        system.delete(folder, True)


def discard(table: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` returned, once nothing reads it any more."""
    spark = table.sparkSession
    for folder in {name.rsplit("/", 1)[0] for name in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop plans that nothing holds any more. Spark then deletes their shuffle files."""
    gc.collect()
    spark._jvm.System.gc()


def materialize(df: DataFrame, name: str = "stage", outlive: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Later steps restart from files when executors are lost, read only the columns they need, and do not
    compute the table again. Inside ``staged`` the files go with the block, or with the one around it if they are to
    ``outlive`` it; otherwise they stay.
    """
    path = stage_path(df.sparkSession, name)
    owners = _OWNERS[:-1] if outlive else _OWNERS
    if owners:
        owners[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
