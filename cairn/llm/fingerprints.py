"""Document fingerprints: SimHash of weighted terms, and search by permuted block tables.

Terms are words and pairs of neighbouring words, weighted by 1 + ln(frequency in the text). Every
bit of a term's hash votes with the weight; the sign of the sum is the fingerprint's bit. For a
search within r bits the 64 bits are cut into b blocks: two fingerprints that near agree on b - r
blocks at least, so there is a table for every choice of b - r blocks, which puts their bits
first, and a candidate shares that prefix in some table. b is chosen so that a prefix is longer
than the binary logarithm of the number of fingerprints.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty

BITS = 64
ROWS_IN_BUCKET = 1000
MOST_BUCKETS = 10_000
FIRST = -(1 << 63)


class Prints:
    """SimHash of texts."""

    def __init__(self) -> None:
        import xxhash

        self.hashes = Memo(lambda w: xxhash.xxh64_intdigest(w), 200_000)

    def __call__(self, text: str) -> int:
        words = text.split()
        if not words:
            return 0
        own = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
        pairs = (pairs ^ (pairs >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        terms, counts = np.unique(np.concatenate([own, pairs ^ (pairs >> np.uint64(31))]), return_counts=True)
        weights = (1 + np.log(counts)).astype(np.float32)
        sums = np.zeros(BITS, np.float64)
        for at in range(0, len(terms), 1 << 14):
            bits = np.unpackbits(terms[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += weights[at : at + (1 << 14)] @ bits.astype(np.float32)
        return int(np.packbits(sums * 2 > float(weights.sum(dtype=np.float64)), bitorder="little").view(np.uint64)[0])


def likeness(a: int, b: int) -> float:
    return 1 - (a ^ b).bit_count() / BITS


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of
    the next row's text, or all that there are. Next is by key, then text, nulls first; after the last row comes the first.
    Rows go to ranges of keys by one shuffle; the first rows of a range are sent to the range before it, too,
    so no task needs more than a range's rows, one after another. An empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark, 500)
    given = df.select(F.col(key), text_or_empty(text).alias("__text"), F.coalesce(F.col(key).cast("long"), F.lit(FIRST)).alias("__order"))
    n = given.count()
    buckets = max(1, min(MOST_BUCKETS, n // ROWS_IN_BUCKET))
    shares = [i / buckets for i in range(1, buckets)]
    ends = sorted(set(given.select(F.percentile_approx("__order", shares, max(10_000, 20 * buckets))).first()[0] or [])) if shares and n else []
    placed = given.withColumn("__bucket", _place(ends, F.col("__order")))
    firsts = sorted(placed.groupBy("__bucket").agg(F.min("__order")).collect())  # a row for each range
    before = [(b, least, firsts[i - 1][0]) for i, (b, least) in enumerate(firsts)]
    before = spark.createDataFrame(before, "__of int, __least long, __before int") if before else spark.createDataFrame([], "__of int, __least long, __before int")
    joined = placed.join(F.broadcast(before), F.col("__bucket") == F.col("__of"))
    targets = F.when(F.col("__order") == F.col("__least"), F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("t")), F.struct(F.col("__before").alias("b"), F.lit(1).alias("t")))).otherwise(F.array(F.struct(F.col("__bucket").alias("b"), F.lit(0).alias("t"))))
    sent = joined.select(key, "__text", "__order", F.explode(targets).alias("x")).select("x.b", "x.t", "__order", key, "__text")
    ordered = sent.repartition(max(1, len(firsts)), "b").sortWithinPartitions("b", "t", "__order", "__text")
    schema = T.StructType([df.schema[key]] + [T.StructField(c, t) for c, t in (("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prints = Prints()
        last = None  # (bucket, key, text, fingerprint) that waits for the next row
        closed = None  # the range whose last row has met a first row of the next range
        for batch in batches:
            out: list[tuple] = []
            for b, t, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if t and b == closed:
                    continue  # more rows tie for first place there
                mark = prints(text)
                if last is not None:
                    half = len(last[2]) // 2
                    edited = last[2][: len(last[2]) - half] + text[:half]
                    changed = prints(edited)
                    out.append((last[1], len(last[2]), hashlib.sha256(edited.encode()).hexdigest(), f"{last[3]:016x}", f"{changed:016x}", likeness(last[3], changed), likeness(last[3], mark)))
                last, closed = (None, b) if t else ((b, own, text, mark), closed)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], names=[f.name for f in schema])

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = list(to_arrow_schema(schema))
    return ordered.mapInArrow(run, schema)


def _place(ends: list[int], value: Column) -> Column:
    """How many of the sorted ends are not above the value, by two steps of about the root of their number."""
    if not ends:
        return F.lit(0)
    step = math.isqrt(len(ends) - 1) + 1
    tops = ends[step::step]
    as_array = lambda x: F.expr(f"transform(split('{','.join(map(str, x))}', ','), x -> bigint(x))")
    top = F.size(F.filter(as_array(tops), lambda e: e <= value)) if tops else F.lit(0)
    return top * step + F.size(F.filter(F.slice(as_array(ends), top * step + 1, step), lambda e: e <= value))


def tables(n: int, radius: int) -> list[int]:
    """Masks of the prefixes of the permuted tables for n fingerprints."""
    for blocks in range(radius + 1, BITS + 1):
        equal = blocks - radius
        edges = [BITS * i // blocks for i in range(blocks + 1)]
        if blocks == radius + 8 or BITS // blocks * equal >= math.log2(max(n, 2)) + 1:
            break
    return [sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in some) for some in combinations(range(blocks), equal)]


def within(queries: DataFrame, index: DataFrame, radius: int = 3) -> DataFrame:
    """(query, found, distance): for every distinct fingerprint of queries all distinct others of index within radius bits.

    Both have a long column fp; null fingerprints find nothing. Rows with equal fingerprints are one, so copies make no
    pairs; a prefix that very many fingerprints share is a skewed key of the join, which adaptive execution splits. Neither side is broadcast.
    """
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    all_of = index.select("fp").where("fp IS NOT NULL").distinct()
    masks = tables(all_of.count(), radius)
    prefixes = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("prefix")) for i, m in enumerate(masks)])).alias("x")
    asked = queries.select("fp").where("fp IS NOT NULL").distinct().select(F.col("fp").alias("query"), prefixes).select("query", "x.table", "x.prefix")
    there = all_of.select(F.col("fp").alias("found"), prefixes).select("found", "x.table", "x.prefix")
    pairs = asked.join(there.hint("merge"), ["table", "prefix"]).where("query <> found")
    pairs = pairs.withColumn("distance", F.bit_count(F.col("query").bitwiseXOR(F.col("found"))).cast("int")).where(F.col("distance") <= radius)
    return pairs.select("query", "found", "distance").distinct()
