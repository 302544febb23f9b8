"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDERS: set[str] = set()
_SCRATCH: list[list[str]] = []
PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: its root goes into the workers' PYTHONPATH."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *paths])


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a folder of our own only where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"/tmp/folioscope-{spark.sparkContext.applicationId}"
    if own not in _OWN_FOLDERS:
        _OWN_FOLDERS.add(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Let the driver delete a folder when the application ends, or when the innermost ``scratch`` does."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if _SCRATCH:
        _SCRATCH[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(where, True)
    files.cancelDeleteOnExit(where)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at the end all steps that were materialized within: for jobs that write their result before it ends.

    ``with scratch(spark): query(spark, folder).write.parquet(result)``
    """
    _SCRATCH.append([])
    try:
        yield
    finally:
        for path in _SCRATCH.pop():
            delete(spark, path)


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` into the shared folder and read it back.

    Cuts lineage, survives the loss of an executor and gives the planner the true size of the result (a
    broadcast is then only chosen below the session's threshold). The folder is deleted when the application ends,
    earlier by ``discard`` or ``scratch``.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    delete_on_exit(spark, path)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._folder = path
    return found


def discard(*steps: DataFrame) -> None:
    """Delete materialized steps that nothing will read again; other frames are left alone."""
    for step in steps:
        if path := step.__dict__.pop("_folder", None):
            delete(step.sparkSession, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
