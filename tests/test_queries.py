"""Every registered query against DuckDB on the smallest tables."""

import math
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cairn.plans import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return float(f"{float(v):.9g}") if type(v).__name__ == "Decimal" else v


def columns_of(duck, sql):
    return np.array(duck.sql(sql).fetchall(), float)


def name_pairs(duck, rows):
    """One to one, each pair of one name, and no two files left that share a name."""
    names = {s: duck.sql(f"SELECT DISTINCT sha1(text), lang || '_' || floor(n_chars / 400)::INT FROM documents WHERE source = '{s}'").fetchall() for s in ("src0", "src1")}
    of = {s: {} for s in names}
    for s, found in names.items():
        for oid, name in found:
            of[s].setdefault(oid, set()).add(name)
    t, b = [r["t"] for r in rows], [r["b"] for r in rows]
    assert rows and len(set(t)) == len(t) and len(set(b)) == len(b)
    assert all(of["src0"][r["t"]] & of["src1"][r["b"]] for r in rows)
    left = [set().union(*[n for oid, n in of[s].items() if oid not in taken]) for s, taken in (("src0", set(t)), ("src1", set(b)))]
    assert not left[0] & left[1]


def pair_report(duck, rows):
    """Every file of both sides once; equal contents are matched."""
    sides = [{x[0] for x in duck.sql(f"SELECT DISTINCT sha1(text) FROM documents WHERE source = '{s}'").fetchall()} for s in ("src1", "src0")]
    for side, key in zip(sides, ("t", "b"), strict=True):
        assert Counter(r[key] for r in rows if r[key]) == Counter(side)
    assert {r["t"] for r in rows if r["category"] == "matched"} == sides[0] & sides[1]
    assert {r["category"] for r in rows} <= {"matched", "modified", "unmatched_target", "unmatched_baseline"}


def sampled(duck, rows, share=0.2):
    every = Counter(duck.sql("SELECT DISTINCT sha1(text), strlen(text) FROM documents").fetchall())
    got = Counter((r["oid"], r["size"]) for r in rows)
    assert not got - every and sum(got.values()) == max(1, round(share * sum(every.values())))


def packed(duck, rows):
    """The greedy choice again, row by row."""
    ranked = {}
    words = duck.sql("SELECT oid, v, count(*) FROM (SELECT oid, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS v FROM (SELECT DISTINCT sha1(text) AS oid, text FROM documents)) WHERE length(v) >= 4 GROUP BY ALL").fetchall()
    for oid, value, n in sorted(words, key=lambda x: (x[0], -x[2], x[1])):
        ranked.setdefault(oid, []).append(value)
    want = set()
    for oid, values in ranked.items():
        used, kept = 0, []
        for v in values:
            if used + len(v) <= 100:
                used += len(v)
                kept.append(v)
        want |= {(oid, v) for v in kept or values[:1]}
    assert {(r["oid"], r["value"]) for r in rows} == want


def betweenness(duck, rows):
    """By definition: shares of the shortest paths of all pairs, for one function."""
    f = min(r["faddr"] for r in rows)
    edges = {(a, b) for a, b in duck.sql(f"SELECT src, dst FROM (SELECT l_partkey % 128 AS src, lead(l_partkey % 128) OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS dst FROM lineitem WHERE l_suppkey = {f}) WHERE dst IS NOT NULL").fetchall()}
    nodes = sorted({x for e in edges for x in e})
    after = {n: [b for a, b in edges if a == n] for n in nodes}
    far, paths = {}, {}
    for s in nodes:
        far[s, s], paths[s, s], queue = 0, 1, [s]
        for v in queue:
            for w in after[v]:
                if (s, w) not in far:
                    far[s, w], paths[s, w] = far[s, v] + 1, 0
                    queue.append(w)
                if far[s, w] == far[s, v] + 1:
                    paths[s, w] += paths[s, v]
    total = sum(paths[s, v] * paths[v, d] / paths[s, d] for s in nodes for d in nodes if s != d and (s, d) in far for v in nodes if v not in (s, d) and (s, v) in far and (v, d) in far and far[s, v] + far[v, d] == far[s, d])
    want = total / len(nodes) / ((len(nodes) - 1) * (len(nodes) - 2))
    assert abs(next(r["mean_betweenness"] for r in rows if r["faddr"] == f) - want) < 1e-5


def survival(duck, rows):
    """No small step from the coefficients makes the data likelier."""
    x = columns_of(duck, "SELECT l_quantity, (l_quantity > 1.5)::INT, l_extendedprice / 10000, l_discount FROM lineitem")
    at = {r["term"]: r["coefficient"] for r in rows}

    def likelihood(c):
        z = (np.log(x[:, 0]) - x[:, 2] * c["price"] - x[:, 3] * c["l_discount"] - c["intercept"]) / c["scale"]
        return (x[:, 1] * (z - np.log(c["scale"])) - np.exp(z)).sum()

    assert set(at) == {"price", "l_discount", "intercept", "scale"}
    for term in at:
        for step in (-0.1, 0.1):
            assert likelihood(at) >= likelihood(at | {term: at[term] + step})


def components(duck, rows):
    x = columns_of(duck, "SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert np.allclose([r["variance"] for r in sorted(rows, key=lambda r: r["component"])], (values / values.sum())[:2])


def linear(duck, rows):
    x = columns_of(duck, "SELECT l_extendedprice, l_quantity, l_discount, l_tax FROM lineitem")
    fit = np.linalg.lstsq(np.column_stack([x[:, 1:], np.ones(len(x))]), x[:, 0], rcond=None)[0]
    assert np.allclose([r["coefficient"] for r in rows], fit, rtol=1e-4, atol=1e-3)


def largest_assignment(duck, rows):
    """One to one, of given pairs, and no pair left out and no two pairs exchanged make the sum larger by more than epsilon."""
    scores = {(t, b): s for t, b, s in duck.sql(ORACLE["j7_function_mapping"].replace("SELECT t, b, tn.name", "SELECT t, b, similarity, tn.name").replace("similarity, tn.name AS t_name, bn.name AS b_name", "similarity")).fetchall()}
    t, b = {r["t"]: r for r in rows}, {r["b"]: r for r in rows}
    assert rows and len(t) == len(b) == len(rows) and all(scores[r["t"], r["b"]] == r["similarity"] for r in rows)
    value = lambda of, key: of[key]["similarity"] if key in of else 0.0
    for (i, j), s in scores.items():
        if i not in t or j not in b or t[i]["b"] != j:
            other = scores.get((b[j]["t"], t[i]["b"]), 0.0) if i in t and j in b else 0.0
            assert s + other <= value(t, i) + value(b, j) + 3e-4


def cox_of(x, times, events):
    """Newton's method on Efron's partial likelihood, a death at a time."""
    beta = np.zeros(x.shape[1])
    x = x - x.mean(0)
    for _ in range(12):
        w, slope, curve = np.exp(x @ beta), np.zeros(len(beta)), np.zeros((len(beta),) * 2)
        for t in np.unique(times[events]):
            risk, dead = times >= t, (times == t) & events
            d = dead.sum()
            sums = [[(w[m, None] * x[m]).sum(0), (x[m].T * w[m]) @ x[m], w[m].sum()] for m in (risk, dead)]
            slope += x[dead].sum(0)
            for k in range(d):
                first, second, total = (a - k / d * b for a, b in zip(*sums, strict=True))
                slope -= first / total
                curve += second / total - np.outer(first, first) / total**2
        beta = beta + np.linalg.solve(curve, slope)
    return beta, np.sqrt(np.diag(np.linalg.inv(curve)))


def cox(duck, rows):
    x = columns_of(duck, "SELECT l_extendedprice / 10000, l_discount, l_tax, l_quantity FROM lineitem")
    beta, errors = cox_of(x[:, :3], x[:, 3], x[:, 3] > 1.5)
    got = {r["term"]: r for r in rows}
    assert np.allclose([got[c]["coefficient"] for c in ("price", "l_discount", "l_tax")], beta, atol=1e-4, rtol=1e-4)
    assert np.allclose([got[c]["error"] for c in ("price", "l_discount", "l_tax")], errors, atol=1e-4, rtol=1e-4)


def held_out(duck, rows):
    x = columns_of(duck, "SELECT l_extendedprice / 10000, l_discount, l_tax, l_quantity, l_orderkey FROM lineitem")
    test = x[:, 4] % 5 == 0
    beta, _ = cox_of(x[~test, :3], x[~test, 3], x[~test, 3] > 1.5)
    time, predicted = x[test, 3], np.round(-x[test, :3] @ beta, 3)
    earlier = (time[:, None] < time[None, :]) & (time > 1.5)[:, None]
    right = (predicted[:, None] < predicted[None, :]) + 0.5 * (predicted[:, None] == predicted[None, :])
    assert len(rows) == 1 and rows[0]["pairs"] == earlier.sum() and abs(rows[0]["concordance"] - right[earlier].mean()) < 1e-3


def correlation_tests(duck, rows):
    x = columns_of(duck, "SELECT l_quantity, l_extendedprice, l_discount, l_tax, l_partkey, l_suppkey FROM lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    r = np.corrcoef(x.T)
    assert len(rows) == 10
    for row in rows:
        want = r[names.index(row["target"]), names.index(row["column"])]
        assert abs(row["r"] - want) < 2e-6 and 0 <= row["p"] <= 1
    for target in ("l_quantity", "l_tax"):
        own = sorted((r for r in rows if r["target"] == target), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == [1, 2, 3, 4, 5] and [r["r"] for r in own] == sorted((r["r"] for r in own), reverse=True)


def ordered_changes(duck, rows):
    lines = duck.sql("SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) % 2 AS odd, event_type FROM events ORDER BY user_id, ts, event_id").fetchall()
    want = {}
    for f in {x[0] for x in lines}:
        t, b = ([x[2] for x in lines if x[0] == f and x[1] == odd] for odd in (0, 1))
        table = [[0] * (len(b) + 1) for _ in range(len(t) + 1)]
        for i, p in enumerate(t):
            for j, q in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if p == q else max(table[i][j + 1], table[i + 1][j])
        same = table[-1][-1]
        want[f] = (len(t) - same, len(b) - same, sum((Counter(t) & Counter(b)).values()) - same)
    assert {r["faddr"]: (r["added"], r["removed"], r["moved"]) for r in rows} == want


def adaptive(duck, rows):
    """The rounds again, file by file; and no more functions than a tenth beyond those of one choice at a time."""
    held = {}
    for oid, name in duck.sql("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem").fetchall():
        held.setdefault(oid, set()).add(name)

    def run(step, one):
        left, chosen, out = {o: set(x) for o, x in held.items()}, set(), []
        while len(held) - len(left) < 0.95 * len(held) - 1e-9:
            popular = Counter(n for x in left.values() for n in x)
            most = max(popular.values())
            now = {min(n for n, c in popular.items() if c == most)} if one else {n for n, c in popular.items() if c >= most * (1 - step)}
            chosen |= now
            left = {o: x - now for o, x in left.items()}
            left = {o: x for o, x in left.items() if len(x) > len(held[o]) * 0.1 + 1e-9}
            out.append((len(out) + 1, len(chosen), len(held) - len(left)))
        return out

    assert sorted((r["round"], r["functions"], r["files"]) for r in rows) == run(0.1, False)
    assert rows[-1]["functions"] <= 1.1 * run(0, True)[-1][1] + 1


PROPERTIES = {
    "a23_adaptive_coverage": adaptive,
    "m1_cox": cox, "m1_cox_held_out": held_out, "a31_correlation_tests": correlation_tests, "t16_ordered_changes": ordered_changes,
    "j5_assigned_pairs": largest_assignment,
    "j4_name_pairs": name_pairs, "j6_pair_report": pair_report, "w8_random_sample": sampled, "w9_shuffle": lambda duck, rows: sampled(duck, rows, 1), "w15_packed_greedy": packed,
    "g9_betweenness": betweenness, "m1_survival": survival, "m4_principal_components": components, "m5_linear": linear,
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in ORACLE:
        return PROPERTIES[name](duck, [r.asDict() for r in df.collect()])
    want = duck.sql(ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
