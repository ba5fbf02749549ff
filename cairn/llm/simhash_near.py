"""Near duplicates beyond a few bits: wide probing on one SimHash, a second one to screen, and the texts to decide.

The first fingerprint is of a text's distinct words without those that stand in over a tenth of all texts, the second
of its three-word shingles. Candidates differ in at most `distance` bits of the first and `second` bits of the other.
On the first, the generalised pigeonhole principle is used from both sides: two fingerprints that both lie within r bits of a common
pattern differ in up to 2 r bits, so a partition of radius r uses up a threshold of 2 r. Radii
are allocated by dynamic programming on counts over all fingerprints.

Members of a group (fingerprints under a key; texts that candidates join) are compared inside tasks, and only links
that join something are handed on, never all pairs. A group with very many members is dealt out: each member is first
compared with a few pivots. Most members of a group of near copies are then of one component; between these no
comparison is needed any more, and only the others are compared with all, in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty, written
from cairn.llm.components import components
from cairn.llm.simhash_dedup import co_set, fingerprint, grouped, signed, tagged, votes

#: Members of a group that one task compares, and shingles of texts; more are dealt out.
GROUP = 1024
SHINGLES = 300_000
#: Members of a large group with which all others are compared first.
PIVOTS = 8
#: Fingerprints whose entries one task makes.
NODES_IN_TASK = 20_000
#: What a pair costs to verify, in entries.
PAIR_COST = 0.004
RADII = (-1, 0, 1, 2)
#: Words are counted by so many buckets of their hashes; a bucket met in over a tenth of the texts is common.
BUCKETS = 1 << 16
COMMON = 0.1
SIZE = 5


class Words:
    """Hashes of a text's distinct words."""

    def __init__(self) -> None:
        import xxhash

        self.hashes = Memo(lambda w: xxhash.xxh64_intdigest(w, 42), 200_000)

    def __call__(self, text: bytes) -> np.ndarray:
        words = set(text.lower().split())
        return np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))


def common_words(df: DataFrame, text: str = "text") -> np.ndarray:
    """Whether a bucket of words stands in over a tenth of the texts: counts of all texts, added up in tasks and by Spark."""
    small_batches(df.sparkSession, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = Words(), np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary()).to_pylist()
            counts[BUCKETS] += len(texts)
            for x in texts:
                counts[np.unique(hashes(x) % np.uint64(BUCKETS)).astype(np.int64)] += 1
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["bucket", "n"])

    sums = df.select(text_or_empty(text).alias("t")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # BUCKETS + 1 rows at most
    counts = np.zeros(BUCKETS + 1, np.int64)
    for bucket, n in sums:
        counts[bucket] = n
    return counts[:BUCKETS] > COMMON * counts[BUCKETS]


def prints(df: DataFrame, text: str = "text") -> DataFrame:
    """df with fp, of the words that are not common, and fp2, of three-word shingles; a text of common words only has all of them in fp."""
    common = common_words(df, text)
    rest = [c for c in df.columns if c not in ("fp", "fp2")]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField(n, T.LongType()) for n in ("fp", "fp2")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Words()
        for batch in batches:
            texts = [x or b"" for x in batch.column(text).cast(pa.binary()).to_pylist()]
            found = []
            for x in texts:
                own = hashes(x)
                rare = own[~common[(own % np.uint64(BUCKETS)).astype(np.int64)]]
                found.append(votes(rare if len(rare) else own))
            both = [np.array(v, np.uint64).view(np.int64) for v in (found, [fingerprint(x) for x in texts])]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(v) for v in both], names=[*rest, "fp", "fp2"])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)


def radii(nodes: DataFrame, n: int, distance: int, divisions: tuple[int, ...] = (3, 4, 5)) -> list[tuple[int, list[int], int]]:
    """(mask, bits, radius) of the partitions to probe, with sum(2 r + 1) above distance at the least cost."""
    together = co_set(nodes)
    parts = {m: grouped(together, n, m) for m in divisions}
    masks = {(m, i): sum(1 << b for b in bits) for m, own in parts.items() for i, bits in enumerate(own)}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(signed(mask))).alias("key")) for (m, i), mask in masks.items()])).alias("x")
    counted = nodes.select(each).groupBy("x").agg(F.count(F.lit(1)).alias("n")).groupBy("x.m", "x.i").agg(F.sum(F.expr("cast(n as double) * (n - 1) / 2"))).collect()
    equal = {(m, i): p for m, i, p in counted}
    best: tuple[float, list] = (float("inf"), [])
    for m, own in parts.items():
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for i, bits in enumerate(own):
            w, after = len(bits), {}
            for used, (cost, given) in table.items():
                for r in RADII:
                    near = [1, 1 + w, 1 + w + w * (w - 1) // 2][r] if r >= 0 else 0
                    total = cost + n * near + PAIR_COST * equal.get((m, i), 0) * near * near
                    to = min(distance + 1, used + (2 * r + 1 if r >= 0 else 0))
                    if to not in after or total < after[to][0]:
                        after[to] = (total, [*given, r])
            table = after
        if distance + 1 in table and table[distance + 1][0] < best[0]:
            best = (table[distance + 1][0], [(masks[m, i], bits, r) for i, (bits, r) in enumerate(zip(own, table[distance + 1][1], strict=True)) if r >= 0])
    return best[1]


def forest(first: np.ndarray, second: np.ndarray, owner: np.ndarray, size: int, distance: int, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i, j) such that links inside each owner's run and these edges have the same components; runs have `size` rows at most."""
    label = np.arange(len(first))  # always the root of a row's component
    for step in range(1, size):
        near = np.flatnonzero((owner[step:] == owner[:-step]) & (label[step:] != label[:-step]))
        near = near[np.bitwise_count(first[near + step] ^ first[near]) <= distance]
        near = near[np.bitwise_count(second[near + step] ^ second[near]) <= limit]
        while len(near := near[label[near] != label[near + step]]):
            i, j = label[near], label[near + step]
            np.minimum.at(label, np.maximum(i, j), np.minimum(i, j))
            while (label != (label := label[label])).any():
                pass
    moved = np.flatnonzero(label != np.arange(len(label)))
    return moved, label[moved]


Compare = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def links_in_groups(members: DataFrame, by: list[str], weight: Column, most: int, whole: Compare, asked: Compare) -> DataFrame:
    """Edges (u, v) whose components are those of all links inside the groups of members (by, id, payload), id a long.

    whole and asked turn batches of member lists (ask, id, payload) into edges: whole compares all members, asked those with
    ask with all. A group of over GROUP members, or over `most` of weight in all, is dealt out by pivots. members is read several times.
    """
    parts = lambda rows: F.greatest(F.ceil(F.count(F.lit(1)) / GROUP), F.ceil(F.sum(weight) / most)).cast("int").alias(rows)
    crowded = written(members.groupBy(*by).agg(parts("g")).where("g > 1"), "crowded")
    n = crowded.count()
    side = lambda df: F.broadcast(df) if n <= 200_000 else df.hint("merge")
    listed = lambda df, *of: df.groupBy(*of).agg(F.collect_list(F.struct("ask", "id", "payload")).alias("members")).where(F.size("members") > 1).select("members")
    edges = lambda df, f: df.mapInArrow(f, "u long, v long")
    few = members.join(side(crowded.select(*by)), by, "left_anti") if n else members
    out = edges(listed(few.withColumn("ask", F.lit(True)), *by), whole)
    if not n:
        return out
    held = written(members.join(side(crowded), by), "held")
    first = F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(s)).alias("h"), "id")).getField("id") for s in range(PIVOTS)])
    chosen = held.groupBy(*by).agg(F.array_distinct(first).alias("ids")).select(*by, F.explode("ids").alias("id"))
    pivots = held.join(side(chosen), [*by, "id"], "left_semi")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("g")).cast("int")
    same = held.withColumn("part", part).withColumn("ask", F.lit(False))
    everywhere = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("ask", F.lit(True))
    stars = written(edges(listed(same.unionByName(everywhere), *by, "part"), asked), "stars")
    found = components(stars).select(F.col("node").alias("id"), "component")
    placed = written(held.select(*by, "id", "g").distinct().join(found, "id", "left"), "placed")
    top = placed.where("component IS NOT NULL").groupBy(*by, "component").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg(F.max_by("component", "n").alias("top"))
    rest = placed.join(side(top), by, "left").where("component IS NULL OR component <> top").select(*by, "id")
    asking = written(held.join(rest, [*by, "id"], "left_semi"), "asking")
    sizes = written(asking.groupBy(*by).agg(parts("r")), "sizes")
    if not sizes.limit(1).count():
        return out.unionByName(stars)
    place = F.pmod(F.xxhash64("id", F.lit(11)), F.col("r")).cast("int")
    columns = [*by, "i", "j", "ask", "id", "payload"]
    askers = asking.join(side(sizes), by).withColumn("i", place).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("ask", F.lit(True)).select(*columns)
    others = held.join(side(sizes), by).withColumn("j", part).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("r") - 1))).withColumn("ask", F.lit(False)).select(*columns)
    return out.unionByName(stars).unionByName(edges(listed(askers.unionByName(others), *by, "i", "j"), asked))


def edge_batch(u: list, v: list) -> pa.RecordBatch:
    u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (u, v))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def near_links(nodes: DataFrame, distance: int = 11, second: int = 20) -> DataFrame:
    """Edges (u, v) between the fingerprints fp of nodes (fp, fp2) whose components are those of all candidate pairs."""
    n = nodes.count()
    probes = radii(nodes, n, distance)
    each = F.explode(F.concat(*[tagged(i, *p) for i, p in enumerate(probes)])).alias("x")
    # A small table that becomes many entries: dealt out, so that all cores make them.
    dealt = nodes.repartition(max(nodes.sparkSession.sparkContext.defaultParallelism, n // NODES_IN_TASK + 1))
    entries = dealt.select(F.col("fp").alias("id"), F.col("fp2").alias("payload"), each).select("x.part", "x.key", "id", "payload").withColumnRenamed("part", "of")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            size, flat = np.diff(column.offsets.to_numpy()), column.flatten()
            first, other = (flat.field(k).to_numpy().view(np.uint64) for k in (1, 2))
            owner = np.repeat(np.arange(len(size)), size)
            u, v = [], []
            for top in sorted({1 << int(x - 1).bit_length() for x in size}):  # lists of like size together
                at = np.flatnonzero((size[owner] <= top) & (size[owner] > top // 2))
                i, j = forest(first[at], other[at], owner[at], int(size[(size <= top) & (size > top // 2)].max()), distance, second)
                u.append(first[at][i].view(np.int64))
                v.append(first[at][j].view(np.int64))
            yield edge_batch(u, v)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for rows in batch.column(0):
                ask, first, other = (rows.values.field(k).to_numpy(zero_copy_only=False) for k in range(3))
                one, two = first.view(np.uint64), other.view(np.uint64)
                label = np.arange(len(first))
                for i in np.flatnonzero(ask):
                    near = np.flatnonzero((np.bitwise_count(one ^ one[i]) <= distance) & (np.bitwise_count(two ^ two[i]) <= second) & (label != label[i]))
                    merged, at = np.unique(label[near], return_index=True)
                    label[np.isin(label, merged)] = label[i]
                    u.append(first[near[at]])
                    v.append(np.full(len(at), first[i]))
            yield edge_batch(u, v)

    return links_in_groups(entries, ["of", "key"], F.lit(1), 1 << 40, whole, asked)


def fp_components(df: DataFrame, distance: int, second: int) -> DataFrame:
    """(node, component) of the fingerprints fp of df (fp, fp2) that have candidates; each fp2 that an fp has counts."""
    return written(components(near_links(written(df.select("fp", "fp2").distinct(), "pairs"), distance, second)), "components")


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Hashes of the shingles in their order, cut as for fingerprints."""
    import xxhash

    words = text.lower().split()
    found = map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False)) if len(words) > size else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64).view(np.int64)


def spread(hit: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Words that stand in a shingle that is hit, by the places of first words; the last size - 1 places are no shingles."""
    out = hit.copy()
    for k in range(1, size):
        out[k:] |= hit[:-k]
    return out


def alike(rows: list[np.ndarray], least: float, ask: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Positions (i, j) of pairs of texts that are alike, whose components are those of all such pairs of which one asks (all do by default).

    rows are the texts' shingles in order. Alike are texts of a Jaccard similarity of at least `least` of their sets of
    shingles, or where that share of the words of both stands in shingles that the other has, too.
    """
    n = len(rows)
    inner = SIZE - 1
    codes = np.unique(np.concatenate(rows), return_inverse=True)[1]
    none = int(codes.max()) + 1  # stands after the last shingle, so that a text has a place for each word
    cuts = np.cumsum([len(x) for x in rows])[:-1]
    placed = [np.append(x, np.full(inner, none)) for x in np.split(codes, cuts)]
    sets = [np.unique(x[:-inner]) for x in placed]
    words, distinct = np.array([len(x) for x in placed]), np.array([len(x) for x in sets])
    mark = np.zeros(none + 1, bool)
    label, done, out = np.arange(n), np.zeros(n, bool), []
    for i in np.flatnonzero(np.ones(n, bool) if ask is None else ask):
        done[i] = True
        others = np.flatnonzero((label != label[i]) & ~done)
        if not len(others):
            continue
        mark[sets[i]] = True
        starts = np.concatenate([[0], np.cumsum(distinct[others])[:-1]])
        common = np.add.reduceat(mark[np.concatenate([sets[j] for j in others])], starts, dtype=np.int64)
        fits = common >= least * (distinct[i] + distinct[others] - common) - 1e-9
        # so many words at most do the common shingles cover, on both sides
        maybe = np.flatnonzero(~fits & (common > 0))
        if len(maybe):
            some = others[maybe]
            starts = np.concatenate([[0], np.cumsum(words[some])[:-1]])
            theirs = np.add.reduceat(spread(mark[np.concatenate([placed[j] for j in some])]), starts, dtype=np.int64)
            wanted = least * (words[i] + words[some]) - 1e-9
            for at in np.flatnonzero(theirs + words[i] >= wanted):
                mine = int(spread(np.isin(placed[i], sets[some[at]])).sum())
                fits[maybe[at]] = theirs[at] + mine >= wanted[at]
        mark[sets[i]] = False
        for j in others[fits]:
            if label[i] != label[j]:
                label[label == label[j]] = label[i]
                out.append((int(i), int(j)))
    return out


def near_rows(df: DataFrame, key: str, row: str, distance: int = 11, second: int = 20, least: float = 0.8, text: str = "text") -> DataFrame:
    """(row): the row of the smallest key of each group of texts that are alike; df is (key, row, text, fp, fp2), row a unique long.

    Candidates are joined by fp_components(). The texts of each such group are compared, in tasks, by
    their five-word shingles as alike() says; equal texts are one. Null text counts as empty. df is read
    several times, so it should be a written table. An empty df gives no rows.
    """
    found = fp_components(df, distance, second)
    same = df.groupBy("fp", F.md5(text_or_empty(text)).alias("__same")).agg(F.min(F.struct(key, row)).alias("__first"))
    texts = same.join(found, F.col("fp") == F.col("node"), "left").select(F.col("__first")[row].alias("__id"), "__first", F.coalesce("component", "fp").alias("__group"))
    texts = written(texts, "texts")
    crowds = texts.groupBy(F.col("__group").alias("__of")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = texts.join(crowds, F.col("__group") == F.col("__of"), "left_semi").select("__id", "__group")
    small_batches(df.sparkSession, 1000)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(x) for x in batch.column(2).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["of", "id", "payload"])

    held = df.select(F.col(row).alias("__row"), text_or_empty(text).alias("__text")).join(members, F.col("__row") == F.col("__id"))
    sets = written(held.select("__id", "__group", "__text").mapInArrow(cut, "of long, id long, payload array<long>"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = [], []
            for rows in batch.column(0):
                inside = rows.values
                ask, ids, inner = inside.field(0).to_numpy(zero_copy_only=False), inside.field(1).to_numpy(), inside.field(2)
                pairs = np.array(alike([inner[k].values.to_numpy() for k in range(len(ids))], least, ask), np.int64).reshape(-1, 2)
                u.append(ids[pairs[:, 0]])
                v.append(ids[pairs[:, 1]])
            yield edge_batch(u, v)

    joined = components(links_in_groups(sets, ["of"], F.size("payload"), SHINGLES, compare, compare))
    owned = texts.join(joined, F.col("__id") == F.col("node"), "left")
    return owned.groupBy(F.coalesce("component", "__id").alias("of")).agg(F.min("__first").alias("first")).select(F.col("first")[row].alias(row))
