"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one is made up only where none is set and all runs in one process."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        got = spark.sparkContext._jsc.sc().getCheckpointDir()
        known = got.get() if got.isDefined() else None
    if not known:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="litmusq-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known


def reserved(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted with what is in it like the tables."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written[path] = (spark,)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once as Parquet and reads it back, so later plans start there.

    Lost executors cost nothing that was written.  Files go at the end of the
    ``scope`` they were written in, else when the driver process ends.
    """
    spark = df.sparkSession
    path = reserved(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(paths: list[str]) -> None:
    for path in paths:
        (spark,) = _written.pop(path)
        try:
            jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)
        except Exception:  # the session has ended already
            return


@contextmanager
def scope() -> Iterator[None]:
    """Tables written inside are deleted at its end; results that rest on them must have been used by then."""
    before = set(_written)
    try:
        yield
    finally:
        _delete([p for p in _written if p not in before])


@atexit.register
def _remove() -> None:
    _delete(list(_written))
