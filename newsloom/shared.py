"""Tables written to the folder that driver and executors share, which cut lineage and survive lost executors."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: What this process has written under the shared folder and not yet removed, in order.
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder, but only if all runs on this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
        at = _own_dir()
    return at


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="newsloom-")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A fresh path in the shared folder, under a folder of this application."""
    path = f"{shared_dir(spark)}/newsloom-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stored(df: DataFrame, kind: str) -> DataFrame:
    """df written to the shared folder and read back."""
    spark = df.sparkSession
    path = shared_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession, since: int = 0) -> None:
    """Removes what has been written to the shared folder after the first ``since`` paths; results that still read it must be written out before."""
    gone = _written[since:]
    del _written[since:]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes, at its end, what was written to the shared folder within."""
    before = len(_written)
    try:
        yield
    finally:
        remove_written(spark, before)
