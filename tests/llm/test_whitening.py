import math

import numpy as np
import pytest

from cairn.llm import whitening as w


def brute(vectors, components=32):
    """NumPy on all rows: deviations by whole numbers, whitened rows, shares."""
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * e - t) ** 2 for e, t in zip(row, s, strict=True)) for row in x]
    c = np.array([[(n * e - t) / n for e, t in zip(row, s, strict=True)] for row in x])
    v = c.T @ c / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    return deviation, c @ axes / np.sqrt(values), values / np.trace(v)


def compare(got, ids, vectors, k):
    deviation, white, share = brute(vectors, k)
    assert len(got) == len(ids) * k
    table = {}
    for r in got:
        table.setdefault((r.vec_id, r.component), []).append(r)
    for c in range(1, k + 1):
        rows = [(i, r) for i, key in enumerate(ids) for r in table[key, c]]
        own, want = np.array([r.whitened for _, r in rows]), np.array([white[i, c - 1] for i, _ in rows])
        sign = np.sign(own @ want)
        assert np.abs(own - sign * want).max() < 1e-6
        assert all(r.deviation == deviation[i] and r.n == len(ids) and abs(r.explained / share[c - 1] - 1) < 1e-9 and r.identity_error < 1e-8 for i, r in rows)


@pytest.mark.parametrize("slab", [w.SLAB, 150])
def test_against_numpy(spark, slab):
    """Nulls, entries that are none, repeated rows, clashing columns; in one slab and in several."""
    rnd = np.random.default_rng(1)
    mix = rnd.normal(size=(40, 40))
    vectors = (rnd.normal(size=(700, 40)) @ mix * 0.1).astype("float32").tolist()
    ids = list(range(700))
    bad = [None, [None] * 40, [math.nan] + [0.0] * 39, [math.inf] + [0.0] * 39, [], [1.0] * 3]
    rows = [(i, v, "a", i) for i, v in zip(ids, vectors, strict=True)] + [(1000 + i, v, "b", 0) for i, v in enumerate(bad)]
    rows.append((7000, vectors[3], "c", 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n int").repartition(9, "vec_id")
    got = w.whiten(df, slab=slab)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    compare(got.collect(), [*ids, 7000], [*vectors, vectors[3]], 32)


def test_repeated_ids_and_few_dimensions(spark):
    rnd = np.random.default_rng(2)
    vectors = rnd.normal(size=(50, 3)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(0, vectors[0])], "vec_id long, embedding array<double>")
    got = w.whiten(df).collect()
    assert len(got) == 51 * 3 and sum(r.vec_id == 0 for r in got) == 6
    deviation, _, share = brute([*vectors, vectors[0]], 3)
    assert {(r.vec_id, r.deviation) for r in got} == set(zip([*range(50), 0], deviation, strict=True))
    assert np.allclose(sorted({r.explained for r in got}, reverse=True), share)


def test_no_rows_and_no_spread(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert w.whiten(spark.createDataFrame(rows, schema)).count() == 0
    flat = spark.createDataFrame([(i, [float(i), 5.0]) for i in range(10)], schema)  # one constant dimension: one component
    got = w.whiten(flat).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and all(r.identity_error < 1e-9 for r in got)


def test_deviation_beyond_64_bits_is_null(spark):
    got = w.whiten(spark.createDataFrame([(0, [0.0]), (1, [1e9])], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 2 and all(r.deviation is None for r in got)


def test_query_on_the_table(spark, sf):
    from cairn.llm.queries import op13_whitening

    rows = [r for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect() if r.embedding is not None and all(e is not None and math.isfinite(e) for e in r.embedding)]
    compare(op13_whitening(spark, sf).collect(), [r.vec_id for r in rows], [r.embedding for r in rows], 32)
