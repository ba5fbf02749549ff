"""Likeness of many sets: every pair that shares an element is counted, block against block, in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import checkpointed

#: Elements and sets of a block, about; two blocks meet in a task.
ELEMENTS_IN_BLOCK, SETS_IN_BLOCK = 1 << 20, 4096
#: Open sets of a block at least, where there are cores for more blocks; blocks that a task meets.
FEWEST_SETS, BLOCKS_IN_STRIP = 1024, 16
#: Counts, and meetings of equal elements, that a task holds at a time.
CELLS = 1 << 18
#: An element that more than this share of a block's sets have goes by bits.
OFTEN = 1 / 16


def shared_elements(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides (id, grams) as (id, n, codes): how many elements a set has, and numbers of those that some set of the other side has, too.

    Elements are numbered where all their rows meet, so equal numbers are equal elements. Null ids and sets without such an element have no row; null elements count nowhere.
    (explode_outer, since explode would have Spark make the sets a second time, to filter empty ones.)
    """
    side = lambda df, at: df.where("id IS NOT NULL").withColumn("grams", F.array_distinct(F.array_compact("grams"))).select(F.lit(at).alias("side"), "id", F.size("grams").alias("n"), F.explode_outer("grams").alias("g")).where("g IS NOT NULL")
    of = Window.partitionBy("g")
    each = side(left, 0).unionByName(side(right, 1)).repartition("g").withColumn("at", F.monotonically_increasing_id())
    met = each.withColumn("both", F.min("side").over(of) < F.max("side").over(of)).withColumn("code", F.min("at").over(of)).where("both").select("side", "id", "n", "code")
    # Numbers differ from run to run, so both sides are of one table.
    held = checkpointed(met.groupBy("side", "id", "n").agg(F.collect_list("code").alias("codes")))
    return tuple(held.where(f"side = {at}").select("id", "n", "codes") for at in (0, 1))


def in_blocks(df: DataFrame, name: str, *more: str) -> DataFrame:
    """(name): a row for each block of the sets (id, n, codes), a list of them."""
    sets, elements = df.agg(F.count(F.lit(1)), F.sum(F.size("codes"))).first()
    blocks = max(1, -(-sets // SETS_IN_BLOCK), -(-(elements or 0) // ELEMENTS_IN_BLOCK))
    dealt = df.withColumn("__block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    return dealt.repartition(blocks, "__block").groupBy("__block").agg(F.collect_list(F.struct("id", "n", "codes", *more)).alias(name)).select(name)


def counted(own: tuple[np.ndarray, np.ndarray], there: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, counts): how many elements the own sets from, ..., to - 1 share with each set there; a side is (starts, codes)."""
    (starts, codes), (r_starts, r_codes) = own, there
    n = len(r_starts) - 1
    owner = np.repeat(np.arange(n), np.diff(r_starts))
    order = np.argsort(r_codes, kind="stable")
    owner, ordered = owner[order], r_codes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    values, often = ordered[first], np.diff(first, append=len(ordered))
    at = np.minimum(np.searchsorted(values, codes), max(len(values) - 1, 0))
    hit = values[at] == codes if len(values) else np.zeros(len(codes), bool)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[hit]
    at = at[hit]
    dense = often > max(8, OFTEN * n)
    column = np.cumsum(dense) - 1
    words = -(-int(dense.sum()) // 64)
    table = np.zeros((n, 64 * words), bool)
    for k in np.flatnonzero(dense):
        table[owner[first[k] : first[k] + often[k]], column[k]] = True
    table = np.ascontiguousarray(np.packbits(table, axis=1).view(np.uint64).T)
    meets = np.where(dense[at], 0, often[at])
    ends = np.searchsorted(rows, np.arange(len(starts)))
    total = np.concatenate([[0], np.cumsum(meets)])
    step = max(1, min(CELLS // max(n, 64 * words, 1), len(starts) - 1))
    both, ones = np.empty((step, n if words else 0), np.uint64), np.empty((step, n if words else 0), np.uint8)
    low = 0
    while low < len(starts) - 1:
        high = min(low + step, len(starts) - 1)
        while high > low + 1 and total[ends[high]] - total[ends[low]] > CELLS:
            high = low + (high - low) // 2
        some = slice(ends[low], ends[high])
        kind, row, many = at[some], rows[some] - low, meets[some]
        counts = np.zeros((high - low, n), np.min_scalar_type(64 * words))
        if words:
            mine = np.zeros((high - low, 64 * words), bool)
            crowd = dense[kind]
            mine[row[crowd], column[kind[crowd]]] = True
            mine = np.packbits(mine, axis=1).view(np.uint64)
            for word in range(words):
                np.add(counts, np.bitwise_count(np.bitwise_and(mine[:, word, None], table[word], out=both[: high - low]), out=ones[: high - low]), out=counts)
        counts = counts.astype(np.int64 if many.any() else np.float32)
        if many.any():
            # The places of the sets there that have these elements, one run of places for each.
            places = np.repeat(first[kind] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            counts += np.bincount(np.repeat(row, many) * n + owner[places], minlength=(high - low) * n).reshape(high - low, n)
        yield low, high, counts
        low = high


Choose = Callable[[np.ndarray, np.ndarray, pa.StructArray, pa.StructArray], tuple[np.ndarray, np.ndarray]]


def meetings(left: DataFrame, right: DataFrame, choose: Choose, *more: str) -> DataFrame:
    """(left, right, c, ln, rn): pairs of sets that share c elements, those that choose(shared, likeness, own, there) names by places.

    Both are tables of shared_elements(). A task holds two blocks and counts in pieces, so its memory doesn't grow with the tables; nothing is shuffled but the blocks.
    """
    kinds = [left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["left", "right", "c", "ln", "rn"]
        for batch in batches:
            for own, there in zip(batch.column(0), batch.column(1), strict=True):
                own, there = own.values, there.values
                there = there.take(pc.sort_indices(there.field(0)))  # by id, so that the first of equals has the smaller id
                sides = [(np.concatenate([[0], np.cumsum(x.field(2).value_lengths().to_numpy())]).astype(np.int64), x.field(2).flatten().to_numpy()) for x in (own, there)]
                n, m = own.field(1).to_numpy().astype(np.int64), there.field(1).to_numpy().astype(np.int64)
                for low, high, counts in counted(*sides):
                    i, j = choose(counts, counts / (n[low:high, None] + m[None, :] - counts), own.slice(low, high - low), there)
                    c, i, j = counts[i, j].astype(np.int64), pa.array(i + low), pa.array(j)
                    yield pa.RecordBatch.from_arrays([own.field(0).take(i), there.field(0).take(j), pa.array(c), own.field(1).take(i).cast(pa.int64()), there.field(1).take(j).cast(pa.int64())], names=names)

    pairs = in_blocks(left, "own", *more).crossJoin(in_blocks(right, "there", *more))
    return pairs.mapInArrow(run, f"left {kinds[0]}, right {kinds[1]}, c long, ln long, rn long")


def row_by_row(df: DataFrame) -> DataFrame:
    """df as a written table, made while a batch for Python is one row: here two blocks."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, "1")
    try:
        return checkpointed(df)
    finally:
        conf.set(key, before)


def likeness() -> Column:
    return F.col("c") / (F.col("ln") + F.col("rn") - F.col("c"))


def alike_pairs(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, similarity) of the items (id, grams) of two tables with a Jaccard similarity of at least `least` (above 0) of their sets.

    Exact: all common elements of two sets are counted. Null ids and empty sets are in no pair. Ids are taken as unique; the result is a written table.
    """

    def choose(counts: np.ndarray, likeness: np.ndarray, own: pa.StructArray, there: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return np.nonzero((counts > 0) & (likeness >= least - 1e-9))

    found = meetings(*shared_elements(left, right), choose).where(likeness() >= least)
    return row_by_row(found.select("left", "right", F.round(likeness(), 6).alias("similarity")))


def copies_once(items: DataFrame, k: int) -> DataFrame:
    """(key, reps): each distinct set's first items as (id, object), by id, at most k of an object and 2k in all.

    They hold the first k items outside any one object: 2k of them, at most k of each, leave k whichever object is left out.
    """
    first = lambda df, *by: df.withColumn("__at", F.row_number().over(Window.partitionBy(*by).orderBy("id"))).where(F.col("__at") <= (2 * k if len(by) == 1 else k)).drop("__at")
    reps = first(first(items.select("key", "object", "id"), "key", "object"), "key")
    return reps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("id", "object"))).alias("reps"))


def numbered(sets: DataFrame) -> DataFrame:
    """(key, n, codes) of distinct sets (key, grams): how many elements a set has, and the numbers of its elements."""
    each = sets.select("key", F.size("grams").alias("n"), F.explode("grams").alias("g"))
    codes = checkpointed(each.select("g").distinct().withColumn("code", F.monotonically_increasing_id()))
    return each.join(codes, "g").groupBy("key", "n").agg(F.collect_list("code").alias("codes"))


def in_strips(df: DataFrame, name: str, blocks: int, strips: int) -> DataFrame:
    """(<name>_at, name): as many blocks of the rows, each a list of them, and dealt evenly to so many tasks."""
    dealt = df.withColumn(f"{name}_at", F.pmod(F.xxhash64("unit"), F.lit(blocks)).cast("int"))
    listed = dealt.groupBy(f"{name}_at").agg(F.collect_list(F.struct("unit", "object", "n", "codes", "ids")).alias(name))
    return listed.repartitionById(strips, F.pmod(f"{name}_at", F.lit(strips)).cast("int"))


def closest_units(units: DataFrame, k: int, least: float) -> DataFrame:
    """(unit, c, ln, rn, ids): for each open unit (unit, object, n, codes, ids, open) at least the k closest of other objects, with c shared elements.

    A task holds a block of open units and meets blocks of a strip of all units, one after the other. It hands on of each block only what may be among the k closest
    of all that it has met. Likeness is bounded in single precision first; the exact one is taken where it may count.
    """
    total, wanted, elements = units.agg(F.count(F.lit(1)), F.count_if("open"), F.sum(F.size("codes"))).first()
    blocks = max(1, -(-total // SETS_IN_BLOCK), -(-(elements or 0) // ELEMENTS_IN_BLOCK))
    cores = units.sparkSession.sparkContext.defaultParallelism
    own_blocks = max(1, -(-wanted * blocks // max(total, 1)), min(cores, -(-wanted // FEWEST_SETS)))

    def side(rows: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([[0], np.cumsum(rows.field(3).value_lengths().to_numpy())]).astype(np.int64), rows.field(3).flatten().to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, last = ["unit", "c", "ln", "rn", "ids"], None
        for batch in batches:
            for mark, own, there in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3), strict=True):
                if mark != last:
                    # Both sides go by object, so that units of one object meet in a rectangle.
                    own = own.values
                    found = own.field(1).dictionary_encode()
                    objects, own = found.dictionary, own.take(pa.array(np.argsort(found.indices.to_numpy(), kind="stable")))
                    last, own_side, n = mark, side(own), own.field(2).to_numpy().astype(np.int64)
                    starts = np.searchsorted(np.sort(found.indices.to_numpy()), np.arange(len(objects) + 1))
                    best = np.zeros((len(own), k), np.int64)
                    kept = own
                own, there = kept, there.values
                at = pc.fill_null(pc.index_in(there.field(1), value_set=objects), -1).to_numpy()
                order = np.argsort(at, kind="stable")
                there, columns = there.take(pa.array(order)), np.searchsorted(at[order], np.arange(len(objects) + 1))
                m, by_id = there.field(2).to_numpy().astype(np.int64), np.empty(len(there), np.int64)
                by_id[pc.sort_indices(pc.list_element(there.field(4), 0)).to_numpy()] = np.arange(len(there))
                own_sizes, sizes, chunks, chosen = n[:, None].astype(np.float32), m.astype(np.float32), np.arange(0, len(there), max(1, len(there) // (16 * k))), []
                room = np.empty((0, len(there)), np.float32)
                for low, high, counts in counted(own_side, side(there)):
                    room = room if len(room) >= high - low else np.empty((high - low, len(there)), np.float32)
                    rough = np.add(own_sizes[low:high], sizes, out=room[: high - low])
                    rough -= counts
                    np.divide(counts, rough, out=rough, casting="same_kind")
                    for o in range(np.searchsorted(starts, low, "right") - 1, np.searchsorted(starts, high)):
                        rough[max(starts[o] - low, 0) : max(starts[o + 1] - low, 0), columns[o] : columns[o + 1]] = 0
                    bound = best[low:high, 0] / 1e6
                    if len(there) > k:  # k columns apart that reach it
                        peaks = np.maximum.reduceat(rough, chunks, axis=1)
                        bound = np.maximum(bound, np.partition(peaks, -k, axis=1)[:, -k])
                    i, j = np.divmod(np.flatnonzero(rough >= np.maximum(bound - 2e-6, 1e-12).astype(np.float32)[:, None]), len(there))
                    c = counts[i, j].astype(np.int64)
                    likeness = c / (n[i + low] + m[j] - c)
                    # As Spark rounds; a half is a half although its double may be a bit less.
                    score = np.floor(likeness * 1e6 + 0.5 + 1e-8).astype(np.int64)
                    good = np.flatnonzero((likeness >= least) & (score >= best[i + low, 0]))
                    good = good[np.argsort((i[good] * (10**6 + 1) + 10**6 - score[good]) * len(there) + by_id[j[good]])]
                    place = np.arange(len(good)) - np.searchsorted(i[good], i[good])
                    good, place = good[place < k], place[place < k]
                    new = np.zeros((high - low, k), np.int64)
                    new[i[good], place] = score[good]
                    best[low:high] = np.sort(np.concatenate([best[low:high], new], axis=1), axis=1)[:, k:]
                    chosen.append((i[good] + low, j[good], c[good]))
                i, j, c = (np.concatenate(x) for x in zip(*chosen, strict=True))
                yield pa.RecordBatch.from_arrays([own.field(0).take(pa.array(i)), pa.array(c), pa.array(n[i]), pa.array(m[j]), there.field(4).take(pa.array(j))], names=names)

    pairs = in_strips(units.where("open"), "own", own_blocks, own_blocks).crossJoin(in_strips(units, "there", blocks, -(-blocks // BLOCKS_IN_STRIP)).hint("shuffle_replicate_nl"))
    return pairs.mapInArrow(run, f"unit long, c long, ln long, rn long, ids {units.schema['ids'].dataType.simpleString()}")


def closest(sets: DataFrame, k: int = 1, least: float = 0.0) -> DataFrame:
    """For every item (object, item, grams) the k closest items of other objects by Jaccard of their sets, above 0 and of at least `least`: (item, other, similarity, rank).

    Equal sets are compared once: items whose k closest are copies in other objects take these, and the other items of an object and set are one unit, of which no set
    has more than k. So copies cost no comparisons; units are compared all with all. Similarities are rounded to six places, and ties go by the other's id (sets of
    2,000,000 elements or more, of which unequal ones may round to 1: copies come first). Items without elements, and those without such a partner, have no rows; an item
    that holds less than k partners has those it has. Ids are taken as unique.
    """
    grams = F.array_sort(F.array_distinct(F.array_compact("grams")))
    whole = sets.select("object", F.col("item").alias("id"), grams.alias("grams")).where("object IS NOT NULL AND id IS NOT NULL AND size(grams) > 0")
    items = checkpointed(whole.select("object", "id", F.unhex(F.sha2(F.to_json("grams"), 256)).alias("key"), "grams"))
    copies = checkpointed(copies_once(items, k))
    # An open unit has less than k copies in other objects; then all items of its set, or k of each object, are in reps.
    unit = "struct(o AS object, transform(filter(reps, r -> r.object = o), r -> r.id) AS ids, size(filter(reps, r -> r.object <> o)) < {k} AS open)"
    each = copies.select("key", F.explode(F.expr(f"transform(array_distinct(transform(reps, r -> r.object)), o -> {unit.format(k=k)})")).alias("u"))
    coded = numbered(items.select("key", "grams").dropDuplicates(["key"]))
    units = checkpointed(each.select("key", "u.*").join(coded, "key").withColumn("unit", F.monotonically_increasing_id()))
    found = closest_units(units, k, least).select("unit", F.round(likeness(), 6).alias("similarity"), F.explode("ids").alias("other"))
    order = Window.partitionBy("unit").orderBy(F.desc("similarity"), "other")
    ranked = row_by_row(found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k))
    listed = ranked.groupBy("unit").agg(F.collect_list(F.struct("other", "similarity", "rank")).alias("best"))
    answers = units.where("open").select("key", "object", "unit").join(listed, "unit").groupBy("key").agg(F.collect_list(F.struct("object", "best")).alias("own"))
    known = items.select("key", "object", "id").join(copies.join(answers, "key", "left"), "key")
    of_copies = f"transform(slice(filter(reps, r -> r.object <> object), 1, {k}), (r, i) -> struct(r.id AS other, 1D AS similarity, i + 1L AS rank))"
    best = F.expr(f"coalesce(get(filter(own, u -> u.object = object), 0).best, {of_copies})")
    return known.select(F.col("id").alias("item"), F.explode(best).alias("b")).select("item", "b.other", "b.similarity", "b.rank")
