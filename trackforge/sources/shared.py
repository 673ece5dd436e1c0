"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below spark.checkpoint.dir. Where the session names none, below a temporary one
    if all runs on one machine, as in tests; on a cluster, an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="trackforge-")
        spark.sparkContext.setCheckpointDir(held)
    return f"{held.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Tables written within the innermost scope().
_held: ContextVar[list[Callable[[], None]] | None] = ContextVar("held", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Owns the tables that operators called within it, in this thread, write to the shared folder; they are
    deleted when it ends, so results must have been read by then. Outside of any scope they stay."""
    own: list[Callable[[], None]] = []
    token = _held.set(own)
    try:
        yield
    finally:
        _held.reset(token)
        while own:
            own.pop()()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it cuts lineage and outlives lost executors."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    if (own := _held.get()) is not None:
        own.append(lambda: delete(spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
