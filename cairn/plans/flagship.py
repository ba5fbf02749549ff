"""The first slice: a collection's members, their byte histogram, its commonest bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import aggregates, sets, windows
from cairn.plans.bindings import Bound


def common_bytes(spark: SparkSession, sf_dir: str, name: str = "src0", n: int = 20) -> DataFrame:
    t = Bound(spark, sf_dir)
    ids = t.collections.where(f"name = '{name}'").selectExpr("cid AS oid")
    members = sets.expanded(ids, t.collections, t.members, t.objects)
    counts = aggregates.byte_counts(t.contents.join(members, "oid", "left_semi"), [])
    return windows.top(counts, n, "n", ["byte"])
