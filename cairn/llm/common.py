"""What the training-data operators share: scratch tables, batches, white space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of Unicode, as the patterns of the tokenizers take it (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
#: A word, for Spark's and Java's patterns.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cairn-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Where a list is, written() notes its tables there, for release().
_noted: list[list[str]] = []


@contextmanager
def noting() -> Iterator[list[str]]:
    """The paths of the tables that written() makes inside."""
    paths: list[str] = []
    _noted.append(paths)
    try:
        yield paths
    finally:
        _noted[:] = [x for x in _noted if x is not paths]


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete written tables that nothing reads any more."""
    while paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _noted:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch of whole texts holds in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


class Memo(dict):
    """What make(key) gave, for the keys met lately: two generations of at most `entries` short keys each.

    A key that is met again moves on to the young generation, so the common ones stay.
    """

    def __init__(self, make: Callable, entries: int, longest: int = 64):
        super().__init__()
        self.make, self.entries, self.longest, self.old = make, entries, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value
