"""Near duplicates by 64-bit SimHash and the generalised pigeonhole principle.

Two fingerprints that differ in at most d bits differ, for any division of the 64 bits into
partitions with thresholds t_i where sum(t_i + 1) = d + 1, in at most t_i bits of some
partition i. Correlated bits are grouped into one partition, the thresholds are allocated by
dynamic programming on candidate counts taken from all fingerprints, and each fingerprint is
put under the keys within t_i of its bits. Keys with few fingerprints are verified pair by
pair inside a task. Fingerprints under a key with many go another exact way, by all 65
patterns within one bit of them: two fingerprints within two bits share one, and at most 65
fingerprints can share the same one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import small_batches, written
from cairn.llm.components import components

BITS = 64
#: A key with more fingerprints is not verified pair by pair.
MOST_UNDER_KEY = 64
#: So many keys at most are broadcast; more are joined.
MOST_BROADCAST = 200_000


def votes(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes."""
    set_in = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        set_in += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0]) if len(hashes) else 0


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """SimHash of the shingles of `size` words; fewer words are one shingle, none are fingerprint zero."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and the white space of ASCII
    if len(words) > size:
        found: list | map = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))
    else:
        found = [b" ".join(words)] if words else []
    return votes(np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(seed)), np.uint64))


def fingerprints(df: DataFrame, text: str = "text", name: str = "fingerprint", size: int = 3, keep_text: bool = False) -> DataFrame:
    """df with a long column of fingerprints, without its text unless keep_text; null text counts as empty.

    Every row gives one row; a column of df of that name is replaced, and an empty df gives no rows.
    """
    small_batches(df.sparkSession, 1000)
    rest = [c for c in df.columns if c != name and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).cast(pa.binary()).to_pylist()
            found = pa.array(np.array([fingerprint(x or b"", size) for x in texts], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [found], names=[*rest, name])

    return df.select(*[f"`{c}`" for c in rest], *([] if keep_text else [text])).mapInArrow(run, schema)


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def co_set(nodes: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j set, over all of them: 64 x 64 sums, added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BITS, BITS))
        for batch in batches:
            values = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS * BITS), pa.int32()), pa.array(total.ravel().astype(np.int64))], names=["cell", "n"])

    sums = nodes.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").sum("n").collect()  # 4,096 rows
    out = np.zeros(BITS * BITS)
    for cell, n in sums:
        out[cell] = n
    return out.reshape(BITS, BITS)


def grouped(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The bits in m partitions of like size; each grows by the bit most correlated with those it has."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    like = np.abs(together / max(n, 1) - np.outer(p, p)) / np.where(spread > 0, spread, 1)
    np.fill_diagonal(like, 0)
    free, out = set(range(BITS)), []
    for k in range(m):
        size = BITS // m + (k < BITS % m)
        own = [max(free, key=lambda i: (like[i, sorted(free)].max(), -i))]
        free.remove(own[0])
        while len(own) < size:
            best = max(free, key=lambda i: (like[i, own].mean(), -i))
            own.append(best)
            free.remove(best)
        out.append(sorted(own))
    return out


def allocated(costs: list[list[float]], distance: int) -> tuple[float, list[int]]:
    """Thresholds with sum(t + 1) = distance + 1 of the least cost; costs[i][t + 1] is partition i's at t, -1 leaves it out."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, given) in best.items():
            for more, extra in enumerate(own):
                if used + more <= distance + 1 and (used + more not in after or cost + extra < after[used + more][0]):
                    after[used + more] = (cost + extra, [*given, more - 1])
        best = after
    return best[distance + 1]


def thresholds(nodes: DataFrame, n: int, distance: int, counts: tuple[int, ...] = (2, 3, 4)) -> list[tuple[int, list[int], int]]:
    """(mask, bits, threshold) of the partitions to probe, for all fingerprints together.

    For every division into counts partitions, the pairs under equal bits are counted over all
    fingerprints; at threshold t a key stands for sum(C(w, s), s <= t) keys of as many fingerprints.
    """
    together = co_set(nodes)
    divisions = {m: grouped(together, n, m) for m in counts}
    masks = {(m, i): sum(1 << b for b in bits) for m, parts in divisions.items() for i, bits in enumerate(parts)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for (m, i), mask in masks.items()])).alias("x")
    pairs = nodes.select(each).groupBy("x").agg(F.count(F.lit(1)).alias("n")).groupBy("x.m", "x.i").agg(F.sum(F.expr("cast(n as double) * (n - 1) / 2"))).collect()
    equal = {(m, i): p for m, i, p in pairs}
    best: tuple[float, list] = (float("inf"), [])
    for m, parts in divisions.items():
        costs = []
        for i, bits in enumerate(parts):
            near = [sum(1 if s == 0 else len(bits) if s == 1 else len(bits) * (len(bits) - 1) // 2 for s in range(t + 1)) for t in range(min(distance, 2) + 1)]
            costs.append([0.0] + [x * (n + equal.get((m, i), 0)) for x in near])
        cost, given = allocated(costs, distance)
        if cost < best[0]:
            best = (cost, [(masks[m, i], bits, t) for i, (bits, t) in enumerate(zip(parts, given, strict=True)) if t >= 0])
    return best[1]


def keys(mask: int, bits: list[int], threshold: int) -> Column:
    """All patterns within `threshold` of a fingerprint's bits under the mask."""
    own = F.col("fp").bitwiseAND(F.lit(signed(mask)))
    flips = [sum(1 << b for b in some) for s in range(threshold + 1) for some in combinations(bits, s)]
    return F.transform(F.array(*[F.lit(signed(x)) for x in flips]), lambda x: own.bitwiseXOR(x))


def tagged(part: int, mask: int, bits: list[int], threshold: int) -> Column:
    """keys() with the number of their partition."""
    return F.transform(keys(mask, bits, threshold), lambda k: F.struct(F.lit(part).alias("part"), k.alias("key")))


def links(nodes: DataFrame, distance: int = 2) -> DataFrame:
    """Edges (u, v) between the distinct fingerprints fp of nodes, such that their components are those of all links.

    Every pair within `distance` (2 at most) is an edge or joined by a path of links.
    """
    if not 0 <= distance <= 2:
        raise ValueError("distance must be 0, 1 or 2")
    n = nodes.count()
    probes = thresholds(nodes, n, distance)
    each = F.explode(F.concat(*[tagged(i, *p) for i, p in enumerate(probes)])).alias("x")
    entries = nodes.select("fp", each).select("fp", "x.part", "x.key")
    many = written(entries.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_UNDER_KEY).select("part", "key"), "keys")
    seen = F.broadcast(many) if many.count() <= MOST_BROADCAST else many.hint("merge")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            size = np.diff(lists.offsets.to_numpy())
            owner, value = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy().view(np.uint64)
            left, right = [], []
            for step in range(1, int(size.max(initial=1))):
                near = (owner[step:] == owner[:-step]) & (np.bitwise_count(value[step:] ^ value[:-step]) <= distance)
                left.append(value[step:][near])
                right.append(value[:-step][near])
            u, v = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (left, right))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    few = entries.join(seen, ["part", "key"], "left_anti").groupBy("part", "key").agg(F.collect_list("fp").alias("fps"))
    checked = few.where(F.size("fps") > 1).select("fps").mapInArrow(verify, "u long, v long")
    crowded = entries.join(seen, ["part", "key"], "left_semi").select("fp").distinct()
    around = crowded.select("fp", F.explode(keys((1 << 64) - 1, list(range(BITS)), min(1, distance))).alias("center"))
    if distance == 1:  # only the centre itself is within one bit of all the others
        around = around.join(nodes.select(F.col("fp").alias("center")), "center", "left_semi")
    stars = around.groupBy("center").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.explode("fps").alias("u"), (F.col("center") if distance == 1 else F.array_min("fps")).alias("v")).where("u <> v")
    return checked.unionByName(stars)


def dedup(df: DataFrame, distance: int = 2, key: str = "doc_id", fp: str = "fingerprint") -> DataFrame:
    """(fp, component_id, least) for every distinct fingerprint of df.

    component_id: the smallest key that links of at most `distance` bits reach. df is read twice, so it
    should be a written table. Equal fingerprints are one node, however many rows have them;
    null keys are passed over unless a component has no other. An empty df gives no rows.
    """
    nodes = written(df.groupBy(F.col(fp).alias("fp")).agg(F.min(key).alias("least")), "nodes")
    found = written(components(links(nodes, distance)), "components")
    owned = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = found.join(nodes, F.col("fp") == F.col("node")).groupBy(F.col("component").alias("of")).agg(F.min("least").alias("lowest"))
    return owned.join(lowest, F.col("component") == F.col("of"), "left").select(F.col("fp").alias(fp), F.coalesce("lowest", "least").alias("component_id"))
