"""What the operators of this package share: tables, words, shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that part words: ASCII but digits and lower-case letters.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; other letters as they are."""
    return F.translate(text, UPPER, LOWER)


def ascii_words(text: Column) -> Column:
    """The words of a text as an array; of a null text, none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD, -1), "")


def unused(columns: list[str], *names: str) -> list[str]:
    """Each name with as many underscores in front as it takes not to be one of columns (which Spark
    tells apart without regard to case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where the session names
    none, a temporary one if all runs on one machine, as in tests; on a cluster, an error."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not held:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        held = "file://" + tempfile.mkdtemp(prefix="trackforge-")
        spark.sparkContext.setCheckpointDir(held)
    return held.rstrip("/")


#: What the calls within the innermost scope() have left for results that are not read yet: each entry deletes one thing.
_left: ContextVar[list[Callable[[], None]] | None] = ContextVar("left", default=None)


@contextmanager
def scope() -> Iterator[None]:
    """Owns the scratch tables of the operators called within it, in this thread: they are deleted when it ends,
    so results must have been read or written by then. Tables of calls outside of any scope stay."""
    own: list[Callable[[], None]] = []
    token = _left.set(own)
    try:
        yield
    finally:
        _left.reset(token)
        while own:
            own.pop()()


def leave(delete: Callable[[], None]) -> None:
    if (own := _left.get()) is not None:
        own.append(delete)


def delete_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def bounded_batches(spark: SparkSession, limit: int = 64 << 20) -> Iterator[None]:
    """While it lasts, batches that go to Python end at so many bytes, not only at so many rows: rows can be
    long, and a batch is held as a whole."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(name, None)
    spark.conf.set(name, str(limit))
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive lost executors. The scope() that it was
    made in deletes them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n, self.held = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0, []
        leave(self.clear)

    def clear(self) -> None:
        delete_path(self.spark, self.root)

    def write(self, df: DataFrame, *, codec: str = "zstd", last: bool = False) -> DataFrame:
        """last: the result reads it, so it stays, and all others can go."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with bounded_batches(self.spark):
            df.write.option("compression", codec).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held.append(path)
        if last:
            self.keep(out)
        return out

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables written so far but these."""
        stay = {t._scratch_path for t in tables}
        for path in [p for p in self.held if p not in stay]:
            delete_path(self.spark, path)
        self.held = [p for p in self.held if p in stay]

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        delete_path(self.spark, df._scratch_path)
        self.held.remove(df._scratch_path)


def sha_of_list(items: Column, sep: str = ",") -> Column:
    return F.sha2(F.concat_ws(sep, items), 256)
