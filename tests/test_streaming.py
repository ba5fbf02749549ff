"""Streams give what the rows give at once, however they fall into batches."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest

from cairn.streaming import incremental

START = datetime(2024, 1, 1)
SCHEMA = "k string, ts timestamp, i long, v string"


def run(spark, tmp_path, batches, **options):
    """The grams of a stream that gets a file for each batch."""
    source = tmp_path / "in"
    source.mkdir()
    out = []
    for i, rows in enumerate(batches):
        part = tmp_path / f"part{i}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(part))
        next(part.glob("*.parquet")).rename(source / f"{i:03}.parquet")
        with incremental.rocksdb(spark):
            s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
            if i + 1 == len(batches):
                grams = incremental.ngrams(s, "k", "v", "ts", ["i"], **options)
                grams.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).foreachBatch(lambda df, _: out.extend((r.k, r.gram) for r in df.collect())).start().awaitTermination()
    return Counter(out)


def batch_grams(rows, n):
    want, by = Counter(), {}
    for k, _, _, v in sorted((r for r in rows if r[1] is not None and r[3] is not None), key=lambda r: (r[1], r[2])):
        by.setdefault(k, []).append(v)
    for k, items in by.items():
        want.update((k, ",".join(items[i : i + n])) for i in range(len(items) - n + 1))
    return want


@pytest.mark.parametrize("batches, n", [(1, 3), (3, 1), (3, 2), (10, 3)])
def test_grams_do_not_depend_on_batches(spark, tmp_path, batches, n):
    rnd = random.Random(batches)
    rows = [(rnd.choice(["a", "b", None]), START + timedelta(seconds=rnd.randrange(20_000), microseconds=rnd.randrange(3)), i, rnd.choice(["x", "y", "", None])) for i in range(300)]
    rows += [("a", None, 1, "z"), ("a", rows[0][1], 1000, "t"), ("a", rows[0][1], 1000, "t")]
    end = [(None, START + timedelta(days=2), 0, None)]
    # In order of time but for less than the lateness.
    order = sorted(rows, key=lambda r: (r[1] or START) + timedelta(seconds=rnd.randrange(3000)))
    size = -(-len(order) // batches)
    got = run(spark, tmp_path, [order[i * size : (i + 1) * size] for i in range(batches)] + [end], n=n)
    assert got == batch_grams(rows, n)


def test_late_rows_are_dropped_and_idle_keys_forget(spark, tmp_path):
    at = lambda hours: START + timedelta(hours=hours)
    batches = [[("a", at(0), 0, "a"), ("a", at(1), 1, "b")], [("b", at(9), 2, "z")], [("b", at(9.1), 2, "z")], [("b", at(9.2), 2, "z")], [("a", at(2), 3, "late"), ("a", at(9.5), 4, "c")], [("a", at(30), 5, "d"), ("a", at(30.5), 6, "e")], [(None, at(99), 7, None)]]
    got = run(spark, tmp_path, batches, n=2, idle_ms=10 * 3_600_000)
    assert got == Counter({("a", "a,b"): 1, ("a", "b,c"): 1, ("a", "d,e"): 1, ("b", "z,z"): 2})


def test_no_rows_and_no_grams(spark, tmp_path):
    assert run(spark, tmp_path, [[("a", START, 0, "x")], [(None, START + timedelta(days=1), 0, None)]], n=2) == Counter()
    with pytest.raises(ValueError):
        incremental.ngrams(spark.createDataFrame([], SCHEMA), "k", "v", "ts", n=0)


def test_keys_share_states_and_are_given_out_in_time(spark, tmp_path):
    """A state for each key cost calls of its own; a key's grams don't wait for later rows of a key that shares its state."""
    at = lambda hours: START + timedelta(hours=hours)
    batches = [[(f"k{k}", at(i / 9), i, str(i)) for k in range(40) for i in range(3)] + [("far", at(50), 0, "x"), ("far", at(51), 1, "y")], [("far", at(52), 2, "z")], [(None, at(99), 3, None)]]
    got = run(spark, tmp_path, batches, n=2, groups=2)
    assert got == batch_grams(sum(batches, []), 2)
    state = incremental.Grams("k", "v", "ts", ["i"], 2, None, None)
    put = {}

    class Timed:
        def __init__(self, rows): self.rows = rows  # noqa: E704
        def get(self): return iter(self.rows)  # noqa: E704
        def put(self, rows): self.rows = rows  # noqa: E704
        def clear(self): self.rows = []  # noqa: E704
        def getCurrentWatermarkInMs(self): return 5  # noqa: E704
        def registerTimer(self, ms): put["timer"] = ms  # noqa: E704

    state.handle, state.tails, state.waiting = Timed([]), Timed([("va", ["p"], 1000)]), Timed([("va", 4000, 0, "q"), ("vb", 9000, 0, "r"), ("va", 3000, 1, "s")])
    (out,) = state.handleExpiredTimer((0,), Timed([]), None)
    assert list(zip(out["k"], out["gram"], strict=True)) == [("va", "p,s"), ("va", "s,q")]
    assert state.waiting.rows == [("vb", 9000, 0, "r")] and put["timer"] == 10 and state.tails.rows == [("va", ["q"], 4000)]
