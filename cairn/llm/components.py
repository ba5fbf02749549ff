"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import written


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edges (u, v): component is the smallest node reachable.

    Each round is two aggregations and two joins whose one side has a row for each node, so a
    node with very many neighbours is a skewed key of a join that adaptive execution splits.
    Rounds end when the edges no longer change; their number grows with the logarithm of the
    longest path. Self loops, repeated edges and edges with a null change nothing; no edges give no rows.
    """
    now = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("n")).agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
        small = large.join(lower, F.col("u") == F.col("n"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(lower.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()
        now = written(small, "edges")
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    else:
        raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
