"""Collections: making them, their memberships, and sets of ids, offsets and ranges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cairn.functions.columns import cid_of
from cairn.operators.graph import checkpointed, dealt


def collection(ids: DataFrame, name: str, notes: str = "") -> DataFrame:
    """One row (cid, name, notes, num_oids) of distinct ids; none for no ids."""
    return ids.select("oid").distinct().agg(cid_of("oid").alias("cid"), F.count(F.lit(1)).alias("num_oids")).where("num_oids > 0").select("cid", F.lit(name).alias("name"), F.lit(notes).alias("notes"), "num_oids")


def may_create(collections: DataFrame, new: DataFrame) -> bool:
    """Whether a new collection has members, and neither name nor cid is taken."""
    if not new.limit(1).count():
        return False
    return not collections.join(new.select(F.col("cid").alias("c"), F.col("name").alias("n")), (F.col("cid") == F.col("c")) | (F.col("name") == F.col("n")), "left_semi").limit(1).count()


def renamed(collections: DataFrame, old: str, new: str) -> DataFrame:
    return collections.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def pruned(members: DataFrame, gone: DataFrame) -> DataFrame:
    """Members without some ids, and each collection's id anew: it follows from the members."""
    kept = members.join(gone.select("oid").distinct(), "oid", "left_anti")
    return kept.groupBy("name").agg(cid_of("oid").alias("cid"), F.count(F.lit(1)).alias("num_oids"))


def expanded(ids: DataFrame, collections: DataFrame, members: DataFrame, known: DataFrame) -> DataFrame:
    """Ids with collection ids replaced by their members and unknown ids dropped."""
    inside = collections.select(F.col("cid").alias("oid"), "name").join(members.withColumnRenamed("oid", "member"), "name")
    flat = ids.join(inside.select("oid", "member"), "oid", "left").select(F.coalesce("member", "oid").alias("oid")).distinct()
    return flat.join(known.select("oid").distinct(), "oid", "left_semi")


def memberships(ids: DataFrame, members: DataFrame, without: list[str]) -> DataFrame:
    """For every collection but some: the sorted ids that it shares."""
    shared = members.where(~F.col("name").isin(without)).join(ids.select("oid").distinct(), "oid")
    return shared.groupBy("name").agg(F.array_sort(F.collect_set("oid")).alias("shared"))


def intersection(members: DataFrame, names: list[str]) -> DataFrame:
    """Ids in every named collection."""
    return members.where(F.col("name").isin(names)).groupBy("oid").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(names)).select("oid")


def union(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("oid")
    for f in frames[1:]:
        out = out.unionByName(f.select("oid"))
    return out.distinct()


def orphans(objects: DataFrame, members: DataFrame) -> DataFrame:
    return objects.select("oid").join(members, "oid", "left_anti")


#: Tools, groups or prompts that a query crosses with all rows, at most.
MOST_FEW = 2_000


def few(df: DataFrame, column: str, most: int = MOST_FEW) -> list:
    """The distinct values of a column that are few by their nature, as tools are; more than `most` are an error."""
    found = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(found)


def each_of(values: list, kind: str) -> Column:
    """A row for each of some values."""
    return F.explode(F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>"))


def difference_matrix(items: DataFrame, group: str, item: list[str]) -> DataFrame:
    """(y, x, only): how many items of y are not in x, and in rows with x null all of y's."""
    one = items.select(group, *item).distinct()
    totals = one.groupBy(F.col(group).alias("y")).agg(F.count(F.lit(1)).alias("total"))
    common = one.withColumnRenamed(group, "y").join(one.withColumnRenamed(group, "x"), item).groupBy("y", "x").agg(F.count(F.lit(1)).alias("common"))
    pairs = totals.withColumn("x", each_of(few(one, group), one.schema[group].dataType.simpleString()))
    cells = pairs.join(common, ["y", "x"], "left").select("y", "x", (F.col("total") - F.coalesce("common", F.lit(0))).alias("only"))
    return cells.unionByName(totals.select("y", F.lit(None).cast(cells.schema["x"].dataType).alias("x"), F.col("total").alias("only")))


def block_agreement(blocks: DataFrame) -> DataFrame:
    """(y, x, same, diff, destinations) of two tools' blocks (tool, oid, block, dests): blocks at the same place, those of differing destinations, and how many destinations of y are not x's."""
    other = blocks.select(F.col("tool").alias("x"), "oid", "block", F.col("dests").alias("other"))
    both = blocks.withColumnRenamed("tool", "y").join(other, ["oid", "block"])
    differs = F.array_sort("dests") != F.array_sort("other")
    return both.groupBy("y", "x").agg(F.count_if(~differs).alias("same"), F.count_if(differs).alias("diff"), F.sum(F.size(F.array_except("dests", "other")).cast("long")).alias("destinations"))


def jaccard_distance(a, b):
    """Of two arrays as sets; 0 when both are empty."""
    union_size = F.size(F.array_union(a, b))
    return F.when(union_size == 0, F.lit(0.0)).otherwise(1 - F.size(F.array_intersect(a, b)) / union_size)


def placed(df: DataFrame, order: list[str]) -> DataFrame:
    """df sorted in ranges, and written, with __part: the number of a row's range. Rows that are equal in the order share a range."""
    return checkpointed(df.orderBy(*order).withColumn("__part", F.shiftright(F.monotonically_increasing_id(), 33)))


def _carried(rows: DataFrame, by: list[str], ends: dict[str, Column], carry: dict[str, Column]) -> DataFrame:
    """Placed rows with what a group's other ranges tell: ends sums a range's part of a group up in one row, carry looks from there along the group's ranges."""
    parts = rows.groupBy("__part", *by).agg(*[x.alias(c) for c, x in ends.items()])
    told = parts.select(F.col("__part").alias("__of"), *[F.col(c).alias(f"__by_{c}") for c in by], *[x.alias(c) for c, x in carry.items()])
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(told, same).drop("__of", *[f"__by_{c}" for c in by])


def _along(by: list[str]) -> WindowSpec:
    """A group's ranges in their order: one row for each, so that the window stays small however many rows the group has."""
    return Window.partitionBy(*(by or [F.lit(0)])).orderBy("__part")


def running(df: DataFrame, by: list[str], order: str, totals: dict[str, str]) -> DataFrame:
    """df with running totals (name: column) up to each row in its group, and __next: the order's value in the row after it.

    The order is unique in a group. A group may fill many ranges: totals run within a range, and what the ranges before it hold is added.
    """
    within, along = Window.partitionBy("__part", *by).orderBy(order), _along(by)
    ends = {f"__sum_{c}": F.sum(c) for c in totals.values()} | {"__first": F.min(order)}
    carry = {f"__carry_{c}": F.coalesce(F.sum(f"__sum_{c}").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for c in totals.values()}
    rows = _carried(placed(df, [*by, order]), by, ends, carry | {"__later": F.lead("__first").over(along)})
    sums = [(F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"__carry_{c}")).alias(name) for name, c in totals.items()]
    return rows.select(*df.columns, *sums, F.coalesce(F.lead(order).over(within), F.col("__later")).alias("__next"))


#: A group of more rows than this is sorted in ranges; others are whole in a task.
MOST_ALONE = 1 << 20
#: Buckets of groups that are counted first, and those that are looked into for large groups.
BUCKETS, FEW_BUCKETS = 1 << 16, 1_000


def crowded(df: DataFrame, by: list[str]) -> tuple[DataFrame | None, int]:
    """The groups of more than MOST_ALONE rows, None if there are none, and the number of all rows.

    Groups are counted in buckets first, which shuffles next to nothing; each group by itself only where a bucket has so many rows.
    """
    bucket = F.pmod(F.xxhash64(*by), F.lit(BUCKETS))
    sizes = df.groupBy(bucket.alias("at")).agg(F.count(F.lit(1)).alias("n"))
    rows, full = sizes.agg(F.sum("n"), F.collect_list(F.when(F.col("n") > MOST_ALONE, F.col("at")))).first()
    if not full:
        return None, rows or 0
    some = df.where(bucket.isin(full)) if len(full) <= FEW_BUCKETS else df
    large = checkpointed(some.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MOST_ALONE).select(*by))
    return (large if large.limit(1).count() else None), rows


def _by_size(df: DataFrame, by: list[str], alone: Callable[[DataFrame], DataFrame], ranged: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups that fit a task by `alone`, after one shuffle, larger ones by `ranged`."""
    if not by:
        return ranged(df)
    large, rows = crowded(df, by)
    if large is None:
        return alone(dealt(df, by, rows))
    told = large.select(*[F.col(c).alias(f"__by_{c}") for c in by])
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return alone(dealt(df.join(told, same, "left_anti"), by, rows)).unionByName(ranged(df.join(told, same, "left_semi")))


def _united(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """(by, start, end): spans of a group as one where a span starts at most gap after the furthest end before it."""
    return _by_size(spans.select(*by, "start", "end"), by, lambda df: _united_alone(df, by, gap), lambda df: _united_ranges(df, by, gap))


def _united_alone(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = spans.withColumn("__new", F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(0))).withColumn("__run", F.sum("__new").over(order))
    return runs.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def _united_ranges(spans: DataFrame, by: list[str], gap: int) -> DataFrame:
    """As _united, for groups of any size.

    Runs are made within ranges of the sorted spans first; of these, the ones that the ends in earlier ranges reach begin no run of their own.
    """
    order, along = Window.partitionBy("__part", *by).orderBy("start", "end"), _along(by)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rows = placed(spans.select(*by, "start", "end"), [*by, "start", "end"])
    begins = lambda reach: F.coalesce((F.col("start") > reach + gap).cast("int"), F.lit(0))
    runs = rows.withColumn("__new", begins(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))).withColumn("__run", F.sum("__new").over(order))
    runs = checkpointed(runs.groupBy("__part", *by, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    runs = _carried(runs, by, {"__last": F.max("end")}, {"__reach": F.max("__last").over(before)}).withColumn("__new", begins(F.col("__reach")))
    # without ends before it, a range's first run begins its group, and the others follow it
    runs = runs.withColumn("__new", F.when(F.col("__reach").isNull() & (F.col("__run") > 0), 1).otherwise(F.col("__new")))
    runs = _carried(runs, by, {"__n": F.sum("__new")}, {"__before": F.coalesce(F.sum("__n").over(before), F.lit(0))})
    every = F.sum("__new").over(Window.partitionBy("__part", *by).orderBy("__run")) + F.col("__before")
    return runs.withColumn("__all", every).groupBy(*by, "__all").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__all")


def ranges(offsets: DataFrame, by: list[str], gap: int = 8) -> DataFrame:
    """(by, start, end): runs of offsets in which none is more than gap after the one before. Nulls count for nothing; a group of nulls only has a run of nulls."""
    return _united(offsets.select(*by, F.col("offset").alias("start"), F.col("offset").alias("end")), by, gap)


def merged(intervals: DataFrame, by: list[str]) -> DataFrame:
    """The union of half-open intervals [start, end) in each group."""
    return _united(intervals, by, 0)


def gaps(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Between the merged intervals of a group: the stretches that none covers."""

    def alone(df: DataFrame) -> DataFrame:
        after = F.lead("start").over(Window.partitionBy(*by).orderBy("start"))
        return _united_alone(df, by, 0).select(*by, F.col("end").alias("start"), after.alias("end"))

    def ranged(df: DataFrame) -> DataFrame:
        return running(_united_ranges(df, by, 0), by, "start", {}).select(*by, F.col("end").alias("start"), F.col("__next").alias("end"))

    return _by_size(intervals.select(*by, "start", "end"), by, alone, ranged).where("`end` > `start`")


def subtracted(keep: DataFrame, cut: DataFrame, by: list[str]) -> DataFrame:
    """The parts of keep's half-open intervals that no interval of cut covers, by a sweep over end points with counts of open ones."""
    ends = lambda df, k, c: df.select(*by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("e")).select(*by, "e.at", (F.col("e.d") * k).alias("k"), (F.col("e.d") * c).alias("c"))
    points = ends(keep, 1, 0).unionByName(ends(cut, 0, 1)).groupBy(*by, "at").agg(F.sum("k").alias("k"), F.sum("c").alias("c"))
    swept = running(points, by, "at", {"open": "k", "closed": "c"})
    pieces = swept.where("open > 0 AND closed = 0 AND `__next` IS NOT NULL").select(*by, F.col("at").alias("start"), F.col("__next").alias("end"))
    return merged(pieces, by)
