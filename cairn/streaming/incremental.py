"""Streaming forms of import, histograms and n-grams. Late rows: an hour by event time, then dropped."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

LATE = "1 hour"
#: Groups that the keys of a stream's n-grams are dealt to, each with one state.
GROUPS = 1024


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside keep their state in RocksDB, which transformWithState needs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def ingest(stream: DataFrame, path: str, checkpoint: str, id: str = "oid", at: str = "ts") -> None:
    """Append the rows of a stream whose id the table at path doesn't have; runs through what is there and ends.

    Within the watermark ids are dropped by the stream's own state; over all time by an anti join with the table.
    """

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(path).select(id)
        except Exception as e:  # the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = batch.select(id).limit(0)
        batch.dropDuplicates([id]).join(known, id, "left_anti").write.mode("append").parquet(path)

    once = stream.withWatermark(at, LATE).dropDuplicatesWithinWatermark([id])
    once.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_counts(stream: DataFrame, key: list[str]) -> DataFrame:
    """Keywise counts that a complete or update sink keeps up to date."""
    return stream.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, key: list[str], at: str = "ts", width: str = "1 day") -> DataFrame:
    return stream.withWatermark(at, LATE).groupBy(F.window(at, width), *key).agg(F.count(F.lit(1)).alias("n"))


class Grams(StatefulProcessor):
    """The n-grams of a group of keys, each key's in order of time: rows wait until the watermark has passed them, a key's last n - 1 items stay.

    A group has one state, so that a key costs no calls of its own: the rows that wait, and the tails (key, items, at of the last).
    """

    def __init__(self, key: str, value: str, at: str, order: list[str], n: int, waiting: StructType, idle_ms: int | None):
        self.key, self.value, self.at, self.order, self.n, self.schema, self.idle_ms = key, value, at, order, n, waiting, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tails = handle.getListState("tails", "key string, items array<string>, at long")
        self.waiting = handle.getListState("waiting", self.schema)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first, came = None, []
        for batch in rows:
            batch = batch[batch[self.value].notna() & batch[self.at].notna()]
            if len(batch):
                at = batch[self.at].astype("datetime64[us]").astype("int64")
                came += zip(batch[self.key].tolist(), at.tolist(), *[batch[c].tolist() for c in self.order], batch[self.value].tolist(), strict=True)
                first = int(at.min()) if first is None else min(first, int(at.min()))
        if came:
            self.waiting.appendList(came)
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        ready: list[tuple] = []
        later: list[tuple] = []
        for row in map(tuple, self.waiting.get()):
            (ready if row[1] <= passed else later).append(row)
        idle = None if self.idle_ms is None else self.idle_ms * 1000
        if not ready and idle is None:  # another timer has done it
            return
        tails = {k: (list(items), at) for k, items, at in self.tails.get()}
        keys, grams, keep = [], [], self.n - 1
        for row in sorted(ready):
            items, last = tails.get(row[0], ([], None))
            if idle is not None and last is not None and row[1] - last > idle:
                items = []
            items.append(row[-1])
            if len(items) >= self.n:
                keys.append(row[0])
                grams.append(",".join(items[len(items) - self.n :]))
            tails[row[0]] = (items[len(items) - keep :] if len(items) > keep else items, row[1])
        if idle is not None:
            still = {row[0] for row in later}
            tails = {k: x for k, x in tails.items() if k in still or passed - x[1] <= idle}
        if tails:
            self.tails.put([(k, items, at) for k, (items, at) in tails.items()])
        else:
            self.tails.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(row[1] for row in later) // 1000 + 1)
        elif ready:
            self.waiting.clear()
        if idle is not None and tails:
            self.handle.registerTimer(max(max(at for _, at in tails.values()) + idle, passed) // 1000 + 2)
        yield pd.DataFrame({self.key: pd.Series(keys, dtype=object), "gram": pd.Series(grams, dtype=object)})


def ngrams(stream: DataFrame, key: str, value: str, at: str, order: list[str] | None = None, n: int = 3, late: str = LATE, idle_ms: int | None = None, groups: int = GROUPS) -> DataFrame:
    """(key, gram): the n-grams of each key's values in order of time, then of the columns in order, however the rows fall into batches.

    A row waits in the key's state until the watermark (the latest time less `late`) has passed it, then its grams are given out; the
    last n - 1 values stay as state for the next ones. So rows of an open stream's last stretch are given out once later rows of any key
    move the watermark on. A row that comes once an earlier batch has seen the watermark pass it is dropped. A null value or time is no item, an empty value is one. Equal
    rows are as many items; a null key is a key like others. Keys are whole numbers, strings or dates. Keys share `groups` states, a number that stays for a checkpoint's life; a group's waiting rows and tails are in one task's memory. With idle_ms a key that has no row for so long in event time forgets its values, and no gram spans such a gap.
    """
    if n < 1:
        raise ValueError("n must be 1 at least")
    order = order or []
    kind = stream.schema[key].dataType.simpleString()
    waiting = StructType([StructField("key", StringType()), StructField("at", LongType()), *[StructField(f"o{i}", stream.schema[c].dataType) for i, c in enumerate(order)], StructField("item", StringType())])
    # A null among numbers would reach the workers as one of many floats; so keys travel as text, with a letter for null.
    marked = F.coalesce(F.concat(F.lit("v"), F.col(key).cast("string")), F.lit("n")).alias(key)
    given = stream.select(marked, F.col(at).cast("timestamp").alias(at), *[c for c in order if c not in (key, at, value)], F.col(value).cast("string").alias(value)).withWatermark(at, late)
    grams = given.withColumn("__group", F.pmod(F.xxhash64(key), F.lit(groups))).groupBy("__group").transformWithStateInPandas(Grams(key, value, at, order, n, waiting, idle_ms), f"`{key}` string, gram string", "append", "eventTime")
    return grams.select(F.when(F.col(key) != "n", F.expr(f"substring(`{key}`, 2)")).cast(kind).alias(key), "gram")
