"""Decisions and algebra on hand-made frames."""

import json
import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.functions import columns as c
from cairn.operators import aggregates, filters, graph, joins, models, sets, surface, windows
from cairn.sources import files

relaxed = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v"))).first()[0]


def test_cid_is_independent_of_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("x",)], "oid string")
    b = spark.createDataFrame([("y",), ("x",)], "oid string")
    assert sets.collection(a, "n").first().cid == sets.collection(b, "n").first().cid
    assert sets.collection(a.limit(0), "n").count() == 0
    have = sets.collection(a, "n").drop("notes")
    assert not sets.may_create(have, have) and not sets.may_create(have, sets.collection(a.limit(0), "m"))
    assert sets.may_create(have, sets.collection(a.where("oid = 'x'"), "m"))


def test_size_bounds_are_exclusive(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "size long")
    assert [r.size for r in filters.by_size(df, 1, 3).collect()] == [2]
    assert [r.size for r in filters.by_size(df, 1).collect()] == [2, 3]


def test_tag_filter_with_empty_values(spark):
    tags = spark.createDataFrame([("a", "t", "red blue"), ("b", "t", "<empty>"), ("c", "u", "red")], "oid string, tag string, value string")
    assert {r.oid for r in filters.by_tag(tags, "t").collect()} == {"a", "b"}
    assert {r.oid for r in filters.by_tag(tags, "t", "red").collect()} == {"a", "b"}
    assert {r.oid for r in filters.by_tag(tags, "t", "green").collect()} == {"b"}


def test_names_with_a_star_and_bad_patterns(spark):
    names = spark.createDataFrame([("1", "ab.txt"), ("1", "ac.txt"), ("2", "b.c")], "oid string, name string")
    assert [r.oid for r in filters.by_name(names, "a*.txt").collect()] == ["1"]
    assert [r.oid for r in filters.by_name(names, "b.c").collect()] == ["2"]
    symbols = names.withColumn("offset", F.lit(1))
    assert filters.search_names(symbols, "(", 0, 10).count() == 0
    assert filters.search_names(symbols, "B", 0, 10).count() == 2


def test_runs_and_their_compatible_form(spark):
    o = spark.createDataFrame([("a", bytearray(b"\0" * 12 + b"x" + b"\xff" * 11)), ("b", bytearray(b""))], "oid string, data binary")
    assert {tuple(r) for r in windows.padding_runs(o).collect()} == {("a", 0, 12, 0), ("a", 13, 11, 255)}
    assert {tuple(r) for r in windows.padding_runs(o, compat=True).collect()} == {("a", 0, 11, 0)}
    assert windows.padding_runs(o, value=255).count() == 1
    s = spark.createDataFrame([("a", bytearray(b"abcd\0abcde\0tail!"))], "oid string, data binary")
    assert [(r.offset, r.value) for r in windows.printable_runs(s).collect()] == [(5, "abcde"), (11, "tail!")]


def test_types_and_categories(spark):
    assert one(spark, c.types_of, bytearray(b"MZ.."), "binary") == ["PE"]
    assert one(spark, c.types_of, bytearray(b""), "binary") == ["Unknown"]
    assert one(spark, lambda v: c.category_of(F.array(F.lit("Unknown")), v), "PEM") == "certificate"
    assert one(spark, lambda v: c.category_of(F.array(F.lit("ZIP")), v), "jar") == "jar"


@pytest.mark.parametrize("text, kind", [("true", "bool"), ("-12", "int"), ("0x1F", "int"), ("1.5", "float"), ("error", "level"), ("1a", "text"), ("", "text")])
def test_cast_text(spark, text, kind):
    assert one(spark, c.cast_text, text).kind == kind


def test_addresses_and_code(spark):
    assert [one(spark, c.decimal_address, x) for x in ("0xff", "0o17", "0010", "", "zz", None)] == ["255", "15", "10", None, None, None]
    assert one(spark, c.canonical_code, "iVar1 =  local_1c + param_2;  goto LAB_0010;") == "VAR = LOCAL + PARAM; goto LAB;"
    assert [one(spark, c.mnemonic_of, x) for x in ("mov eax, 1", "ret")] == ["mov", "ret"]
    assert [one(spark, c.operands_of, x) for x in ("mov  eax, 1", "ret")] == ["eax, 1", None]


@relaxed
@given(st.lists(st.binary(max_size=20), max_size=6), st.lists(st.binary(max_size=20), max_size=6))
def test_histograms_merge_and_grams_add_up(spark, a, b):
    frame = lambda rows: spark.createDataFrame([(str(i), bytearray(x)) for i, x in enumerate(rows)], "oid string, data binary")
    counts = lambda rows: {r.byte: r.n for r in aggregates.byte_counts(frame(rows), []).collect()}
    merged = {r.byte: r.n for r in aggregates.merge_counts(["byte"], aggregates.byte_counts(frame(a), []), aggregates.byte_counts(frame(b), [])).collect()}
    assert merged == counts(a + b) == {r.byte: r.n for r in aggregates.byte_counts_native(frame(a + b), []).collect()}
    assert sum(r.n for r in windows.byte_ngrams(frame(a)).collect()) == sum(max(0, len(x) - 2) for x in a)


@relaxed
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=8), st.lists(st.tuples(st.integers(0, 40), st.integers(1, 9)), max_size=8))
def test_interval_algebra(spark, keep, cut):
    frame = lambda rows: spark.createDataFrame([(0, a, a + n) for a, n in rows], "g int, start long, end long")
    points = lambda rows: {p for r in rows for p in range(r.start, r.end)}
    k, x = ({p for a, n in rows for p in range(a, a + n)} for rows in (keep, cut))
    assert points(sets.subtracted(frame(keep), frame(cut), ["g"]).collect()) == k - x
    union = sets.merged(frame(keep), ["g"]).collect()
    assert points(union) == k
    if k:
        assert points(sets.gaps(frame(keep), ["g"]).collect()) | k == set(range(min(k), max(k) + 1))


@relaxed
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 6)), max_size=14))
def test_strong_components(spark, pairs):
    edges = spark.createDataFrame([(1, a, b) for a, b in pairs], "g int, src long, dst long")
    nodes = spark.createDataFrame([(1, n) for n in range(7)], "g int, node long")
    got = {r.node: r.component for r in graph.strong_components(edges, nodes, ["g"]).collect()}
    reach = {n: {n} for n in range(7)}
    for _ in range(7):
        for a, b in pairs:
            for n in range(7):
                if a in reach[n]:
                    reach[n].add(b)
    assert got == {n: min(m for m in range(7) if m in reach[n] and n in reach[m]) for n in range(7)}


def test_matching_is_one_to_one_and_complete(spark):
    scores = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.8), (2, 1, 0.85), (2, 2, 0.1), (3, 3, 0.9), (3, 1, 0.9)], "t long, b long, s double")
    assert {tuple(r)[:2] for r in joins.one_to_one(scores, "t", "b", "s").collect()} == {(1, 1), (2, 2), (3, 3)}
    ids = lambda some: spark.createDataFrame([(x,) for x in some], "oid string")
    none = spark.createDataFrame([], "t string, b string")
    scored = spark.createDataFrame([("b", "x", 0.5), ("b", "y", 0.4), ("c", "z", 0.0)], "t string, b string, score double")
    report = joins.pair_files(ids("abc"), ids("axyz"), none, scored).collect()
    count = lambda side: len([r for r in report if r[side] is not None])
    assert count("t") == 3 and count("b") == 4
    assert {(r.t, r.b) for r in report if r.category == "modified"} == {("b", "x")}


def greedy(rows):
    out, left, right = set(), set(), set()
    for a, b, _ in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            out.add((a, b))
            left.add(a)
            right.add(b)
    return out


@pytest.mark.parametrize("few", [0, 50_000])
def test_matching_of_large_tied_groups(spark, monkeypatch, few):
    monkeypatch.setattr(joins, "FEW_PAIRS", few)
    target = spark.createDataFrame([(f"t{i:02}", "same") for i in range(45)] + [("u", "other"), (None, "same")], "oid string, name string")
    baseline = spark.createDataFrame([(f"b{i:02}", "same") for i in range(30)] + [("v", "other")], "oid string, name string")
    assert {tuple(r) for r in joins.pair_by_name(target, baseline).collect()} == {(f"t{i:02}", f"b{i:02}") for i in range(30)} | {("u", "v")}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.tuples(st.integers(0, 5), st.integers(0, 5)), st.integers(1, 2), min_size=1, max_size=30))
def test_matching_by_rounds_is_greedy(spark, monkeypatch, given_pairs):
    monkeypatch.setattr(joins, "FEW_PAIRS", 0)
    rows = [(a, b, float(s)) for (a, b), s in given_pairs.items()]
    got = joins.one_to_one(spark.createDataFrame(rows, "t long, b long, s double"), "t", "b", "s").collect()
    assert len(got) == len({(r.t, r.b) for r in got}) and {(r.t, r.b) for r in got} == greedy(rows)


def test_reachable_has_no_bound_of_its_own(spark):
    assert graph.reachable.__defaults__ == (None, None)  # was 1,000 rounds
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert {(r.node, r.depth) for r in graph.reachable(edges, start).collect()} == {(i, i) for i in range(13)}
    assert graph.reachable(edges, start, rounds=3).count() == 4


def test_scope_names_what_is_outside(spark):
    ids = lambda some: spark.createDataFrame([(x,) for x in some], "oid string")
    assert joins.scope_restricted(ids("ab"), ids("a")).count() == 1
    with pytest.raises(ValueError, match="z"):
        joins.scope_restricted(ids("ab"), ids("az"))


def test_truth_series_and_ground_truth_files(spark, tmp_path):
    (tmp_path / "a.truth").write_text(json.dumps([{"oid": "abc", "type": "functions"}, [16, "main"], [32, "exit"]]))
    got = files.read_truth(spark, str(tmp_path / "a.truth")).collect()
    assert [(r.oid, r.type, r.offset, r.fields) for r in got] == [("abc", "functions", 16, ["main"]), ("abc", "functions", 32, ["exit"])]
    (tmp_path / "s.csv").write_text("# series\n\nnew, old\n")
    known = spark.createDataFrame([("new", "1"), ("old", "2")], "name string, cid string")
    assert [tuple(r) for r in files.read_series(spark, str(tmp_path / "s.csv"), known).collect()] == [("1", "2")]
    (tmp_path / "bad.csv").write_text("a,b,c\n")
    with pytest.raises(ValueError, match="two fields"):
        files.read_series(spark, str(tmp_path / "bad.csv"), known)
    truth = {"samples": {"k": {"backdoor": {"targets": [{"target_addr": "0x10", "target_oid": "o"}, {"target_addr": "32", "target_oid": None}]}}}}
    (tmp_path / "g.json").write_text(json.dumps(truth))
    assert [tuple(r) for r in files.read_ground_truth(spark, str(tmp_path / "g.json")).collect()] == [("k", "16", "o"), ("k", "32", None)]


def test_import_skips_and_finds_new(spark, tmp_path):
    for name, data in (("a.bin", b"one"), ("b.bin", b"one"), ("c.bin", b"two"), ("empty", b""), (".gitignore", b"x")):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    found = files.import_directory(spark, str(tmp_path / "in"))
    assert sorted(r.name for r in found.collect()) == ["a.bin", "b.bin", "c.bin"]
    known = found.where("name = 'c.bin'").select("oid")
    assert files.new_objects(found, known).count() == 1


def test_options_and_pages(spark):
    declared = {"n": ("long", True, 3), "name": ("string", True, None)}
    assert surface.options(declared, {"name": 5}) == {"n": 3, "name": "5"}
    for wrong in ({}, {"name": "x", "other": 1}):
        with pytest.raises(ValueError):
            surface.options(declared, wrong)
    df = spark.range(5)
    assert [(r.id, r.has_more) for r in windows.page(df, ["id"], 3, 5).collect()] == [(3, False), (4, False)]
    with pytest.raises(ValueError):
        windows.page(df, ["id"], -1, 5)


def test_greedy_packing_skips_what_does_not_fit(spark):
    rows = spark.createDataFrame([("a", 1, 6), ("a", 2, 7), ("a", 3, 4), ("b", 1, 99)], "oid string, rank long, cost long")
    assert {(r.oid, r["rank"]) for r in windows.packed_greedy(rows, "oid", "cost", 10).collect()} == {("a", 1), ("a", 3), ("b", 1)}


def test_exact_pairs_of_sets_against_brute_force(spark):
    rnd = random.Random(3)
    sets = [(i, [f"g{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.randrange(25))]) for i in range(70)] + [(None, ["g1"]), (99, []), (98, None)]
    left, right = (spark.createDataFrame(some, "id long, grams array<string>") for some in (sets[:36] + sets[70:], sets[30:]))
    for least in (0.1, 0.35, 0.8, 1.0):
        got = {(r.left, r.right): r.similarity for r in joins.alike_pairs(left, right, least).collect()}
        want = {}
        for i, a in sets[:36]:
            for j, b in sets[30:70]:
                if set(a) | set(b) and len(set(a) & set(b)) >= least * len(set(a) | set(b)):
                    want[i, j] = round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
        assert got == want


def test_numbers_over_ranges(spark):
    rnd = random.Random(4)
    rows = [(rnd.randrange(50), i) for i in range(3000)]
    got = {(r.x, r.i): r["rank"] for r in joins.numbered(spark.createDataFrame(rows, "x long, i long"), [F.desc("x"), "i"]).collect()}
    assert got == {row: k + 1 for k, row in enumerate(sorted(rows, key=lambda r: (-r[0], r[1])))}
    assert joins.numbered(spark.createDataFrame([], "x long"), ["x"]).count() == 0


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else small tables are sorted in one range
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("by", [["g"], []])
def test_sweeps_over_ranges(spark, many_ranges, by):
    rnd = random.Random(7)
    offsets = [(rnd.choice("aab"), rnd.randrange(6000)) for _ in range(1500)] + [("a", None), ("a", 17), ("a", 17), ("c", None), (None, 5), (None, 11), (None, 40)]
    spans = [(g, a, a + rnd.randrange(1, 30)) for g, a in offsets[:300]] + [("a", 1000, 4000), (None, 5, 9), (None, 7, 20), (None, 30, 31)]
    cut = [(g, a, a + 7) for g, a in offsets[300:600]] + [(None, 8, 12)]
    groups = {g for g, _ in offsets} if by else {0}
    of = lambda rows, g: [r[1:] for r in rows if not by or r[0] == g]
    frame = lambda rows: spark.createDataFrame(rows, "g string, start long, end long")
    got = lambda df: sorted(((r["g"] if by else 0, r["start"], r["end"]) for r in df.collect()), key=repr)
    want_runs, want_merged, want_gaps, want_left = [], [], [], []
    for g in groups:
        runs = []
        for (x,) in sorted(of(offsets, g), key=lambda r: -1 if r[0] is None else r[0]):
            if runs and (x is None or runs[-1][1] is None or x - runs[-1][1] <= 8):
                runs[-1] = (x if runs[-1][0] is None else runs[-1][0], x if x is not None else runs[-1][1])
            else:
                runs.append((x, x))
        want_runs += [(g, a, b) for a, b in runs]
        union = []
        for a, b in sorted(of(spans, g)):
            if union and a <= union[-1][1]:
                union[-1] = (union[-1][0], max(b, union[-1][1]))
            else:
                union.append((a, b))
        want_merged += [(g, a, b) for a, b in union]
        want_gaps += [(g, x[1], y[0]) for x, y in zip(union, union[1:], strict=False)]
        left = sorted({p for a, b in of(spans, g) for p in range(a, b)} - {p for a, b in of(cut, g) for p in range(a, b)})
        firsts = [p for i, p in enumerate(left) if not i or left[i - 1] != p - 1]
        lasts = [p + 1 for i, p in enumerate(left) if i + 1 == len(left) or left[i + 1] != p + 1]
        want_left += [(g, a, b) for a, b in zip(firsts, lasts, strict=True)]
    points = spark.createDataFrame(offsets, "g string, offset long")
    assert sets.placed(points, [*by, "offset"]).select("__part").distinct().count() > 3
    assert got(sets.ranges(points, by)) == sorted(want_runs, key=repr)
    assert got(sets.merged(frame(spans), by)) == sorted(want_merged, key=repr)
    assert got(sets.gaps(frame(spans), by)) == sorted(want_gaps, key=repr)
    assert got(sets.subtracted(frame(spans), frame(cut), by)) == sorted(want_left, key=repr)
    nothing = frame([])
    assert not sets.subtracted(nothing, nothing, by).count() and sets.subtracted(frame(spans), nothing, by).count() == len(want_merged)


def test_concordance_against_all_pairs(spark, many_ranges):
    rnd = random.Random(8)
    schema = "time double, event int, predicted double"
    some = lambda n, k: [(float(rnd.randrange(k)), rnd.randrange(2), float(rnd.randrange(k))) for _ in range(n)]
    for rows in (some(300, 40), some(200, 2), [(None, 1, 1.0), (1.0, None, 2.0), (0.5, 1, None), (0.25, 1, 3.0), (2.0, 1, 2.0)], [(1.0, 1, 1.0)] * 3, []):
        pairs = [(a[2], b[2]) for a in rows for b in rows if a[1] == 1 and a[0] is not None and b[0] is not None and a[0] < b[0]]
        right = sum(0 if p is None or q is None else 1 if p < q else 0.5 if p == q else 0 for p, q in pairs)
        got = models.concordance(spark.createDataFrame(rows, schema), "time", "event", "predicted").collect()
        assert [tuple(r) for r in got] == [(round(right / len(pairs), 6), len(pairs)) if pairs else (None, None)]


def test_strong_components_both_ways(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(g, rnd.randrange(12), rnd.randrange(12)) for g in range(4) for _ in range(10 + 6 * g)]
    e = spark.createDataFrame(edges, "g int, src long, dst long")
    nodes = e.selectExpr("g", "src AS node").union(e.selectExpr("g", "dst AS node")).distinct()
    reach = {(g, a): {a} for g, a in {(g, x) for g, s, d in edges for x in (s, d)}}
    for _ in range(12):
        for g, s, d in edges:
            for key in reach:
                if key[0] == g and s in reach[key]:
                    reach[key].add(d)
    want = {(g, a): min(b for b in reach[g, a] if a in reach[g, b]) for g, a in reach}
    for most in (100_000, 20, 0):  # each in a task; the larger ones by joins; all by joins
        monkeypatch.setattr(graph, "SMALL_GRAPH", most)
        assert {(r.g, r.node): r.component for r in graph.strong_components(e, nodes, ["g"]).collect()} == want


def test_nearest_of_each_query_in_blocks(spark, monkeypatch):
    from cairn.operators import text

    monkeypatch.setattr(text, "VECTORS_IN_BLOCK", 40)
    monkeypatch.setattr(text, "QUERIES_IN_BLOCK", 7)
    rnd = random.Random(6)
    rows = [(i, [float(rnd.randrange(-2, 3)) for _ in range(4)], i % 3) for i in range(150)] + [(200, None, 0), (201, [0.0] * 4, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    usable = [r for r in rows if r[1] and any(r[1])]
    cos = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.dist(a, [0] * 4) / math.dist(b, [0] * 4)
    got = {}
    for r in text.nearest_each(df, df.where("vec_id % 5 = 0"), 6).collect():
        got.setdefault(r["query"], []).append((r["rank"], r.vec_id))
    for q in usable:
        if q[0] % 5 == 0:
            want = sorted(usable, key=lambda v: (-round(cos(q[1], v[1]), 9), v[0]))[:6]
            assert sorted(got.pop(q[0])) == [(k + 1, v[0]) for k, v in enumerate(want)]
    assert not got
    by_label = text.nearest_each(df, df.where("vec_id = 5"), 2, within="label").collect()
    assert sorted((r.label, r["rank"]) for r in by_label) == [(g, k) for g in range(3) for k in (1, 2)]


def largest_sum(rows):
    """The largest sum of a one-to-one choice, by trying all of the smaller side (bit masks)."""
    left, right = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    best = {0: 0.0}
    for t in left:
        new = dict(best)
        for mask, total in best.items():
            for a, b, s in rows:
                bit = 1 << right.index(b)
                if a == t and not mask & bit and s > 0:
                    new[mask | bit] = max(new.get(mask | bit, 0.0), total + s)
        best = new
    return max(best.values())


def test_auction_reaches_the_largest_sum():
    rnd = random.Random(9)
    for case in range(150):
        n, m = rnd.randrange(1, 9), rnd.randrange(1, 9)
        kind = rnd.choice([lambda: 1.0, lambda: rnd.random(), lambda: rnd.choice([0.5, 0.9, 1.0])])
        rows = [(t, b, kind()) for t in range(n) for b in range(m) if rnd.random() < rnd.choice([0.3, 0.8, 1.0])]
        if rows:
            got = joins.auction(*map(list, zip(*rows, strict=True)), joins._epsilons(1.0, 1e-4))
            chosen = [rows[i] for i in got]
            assert len({r[0] for r in chosen}) == len({r[1] for r in chosen}) == len(chosen)
            assert sum(r[2] for r in chosen) >= largest_sum(rows) - 1e-4 * len(chosen) - 1e-9, case


@pytest.mark.parametrize("small", [50_000, 0])
def test_assignment_in_tasks_and_by_rounds(spark, monkeypatch, small):
    monkeypatch.setattr(joins, "SMALL_AUCTION", small)
    rnd = random.Random(10)
    rows = [(t, b, rnd.choice([0.25, 0.5, 0.51, 1.0])) for t in range(7) for b in range(6) if rnd.random() < 0.6] + [(20, 30, 0.9), (20, 31, 0.8), (21, 30, 0.85), (21, 32, 0.0)]
    given = [*rows, (None, 1, 1.0), (1, None, 1.0), (5, 99, -1.0), (20, 30, 0.1)]
    got = [tuple(r) for r in joins.assigned(spark.createDataFrame(given, "t long, b int, s double"), "t", "b", "s", 0.01).collect()]
    assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got) and set(got) <= set(rows)
    assert sum(r[2] for r in got) >= largest_sum(rows) - 0.01 * len(got)
    assert {(20, 31), (21, 30)} <= {r[:2] for r in got}  # the greedy choice of (20, 30) leaves 21 alone
    assert joins.assigned(spark.createDataFrame([(1, 2, 0.0)], "t long, b int, s double"), "t", "b", "s").count() == 0


def test_points_in_intervals_of_any_length(spark):
    rnd = random.Random(11)
    spans = [(rnd.choice("ab"), rnd.randrange(-50, 5000), rnd.choice([0, 1, 2, 3, 7, 8, 100, 4096, 5000])) for _ in range(120)] + [("a", 0, 1 << 40), ("a", -(1 << 62), 1 << 62), ("b", 1 << 62, (1 << 62) - 1), ("b", None, 5), ("b", 3, None), (None, 0, 10)]
    points = [(rnd.choice("abc"), rnd.randrange(-60, 9000)) for _ in range(400)] + [("a", (1 << 40) - 1), ("a", 1 << 40), ("b", (1 << 63) - 2), ("b", None), ("a", -(1 << 62)), (None, 3)]
    p, s = spark.createDataFrame(points, "oid string, offset long"), spark.createDataFrame(spans, "oid string, start long, len long")
    got = sorted((r.oid, r.offset, r.start, r.len) for r in joins.contained(p, s).collect())
    assert got == sorted((o, x, a, n) for o, x in points for g, a, n in spans if o == g and None not in (o, x, a, n) and a <= x < a + n)
    assert joins.contained(p, s.limit(0)).count() == 0
    joined = joins.contained(p, s.where("len > 1000000"))
    assert joined.count() == sum(o == g and None not in (x, a, n) and n > 1_000_000 and a <= x < a + n for o, x in points for g, a, n in spans)


def test_greedy_packing_of_long_groups(spark):
    rnd = random.Random(12)
    rows = [(g, i, rnd.choice([1, 2, 3, 5, 8, 30, 31, 60, 0, None, -1])) for g in "abc" for i in range(400)] + [("d", 1, 61), ("d", 2, 99), ("e", 5, None), ("e", 7, 70), ("f", 1, 0), ("f", 2, 100), (None, 1, 4)]
    got = {(r.oid, r["rank"]) for r in windows.packed_greedy(spark.createDataFrame(rows, "oid string, rank long, cost long"), "oid", "cost", 60).collect()}
    want = set()
    for g in {r[0] for r in rows}:
        used, kept = 0, []
        own = sorted((r[1], r[2]) for r in rows if r[0] == g) if g != "e" else [(5, None), (7, 70)]
        for i, c in own:
            if c is not None and c >= 0 and used + c <= 60:
                used += c
                kept.append(i)
        want |= {(g, i) for i in kept or [own[0][0]]}
    assert got == want


def test_closest_sets_without_a_floor(spark):
    rnd = random.Random(13)
    sets = [(rnd.randrange(4), i, [f"g{min(rnd.randrange(40), rnd.randrange(40))}" for _ in range(rnd.choice([0, 1, 3, 12, 20]))]) for i in range(80)] + [(9, 100, ["g1", "g2"]), (8, 101, ["g1", "g2"]), (7, 102, ["lone"])]
    df = spark.createDataFrame(sets, "object long, item long, grams array<string>")
    like = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6) if a or b else 0.0
    for k, least in ((1, 0.0), (3, 0.0), (2, 0.3)):
        want = set()
        for o, i, a in sets:
            best = sorted((-like(a, b), j) for p, j, b in sets if p != o and like(a, b) > 0 and like(a, b) >= least)[:k]
            want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(best)}
        assert {(r.item, r.other, r.similarity, r["rank"]) for r in joins.closest(df, k, least).collect()} == want


def test_samples_and_pages_without_one_task(spark):
    rows = [(i % 7, i) for i in range(2000)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(6)
    got = [tuple(r) for r in windows.sample(df, 300, seed=3).collect()]
    assert len(got) == len(set(got)) == 300 and set(got) <= set(rows)
    assert abs(sum(b for _, b in got) / 300 - 1000) < 120 and set(windows.sample(df, 300, seed=4).collect()) != set(got)
    assert windows.sample(df, 5000).count() == 2000 and windows.sample(df, 0).count() == 0 and windows.sample(df, percent=0.01).count() == 1
    assert windows.sample(df.limit(0), 5).count() == 0 and windows.sample(df.select(F.lit(1).alias("x")), 77).count() == 77
    page = [(r.a, r.b, r.total, r.has_more) for r in windows.page(df, ["a", "b"], 995, 20).collect()]
    assert page == [(a, b, 2000, True) for a, b in sorted(rows)[995:1015]]
    assert windows.page(df, ["b"], 1990, 50).count() == 10 and windows.page(df, ["b"], 3000, 5).count() == 0
    values = graph.checkpointed(spark.createDataFrame([(v,) for v in (-(1 << 63), (1 << 63) - 1, 0, 0, 0, 5, -7)], "k long"))
    assert [windows.smallest(values, "k", n) for n in range(9)] == [None, -(1 << 63), -7, 0, 0, 0, 5, (1 << 63) - 1, None]


def test_common_lines_in_order():
    from cairn.operators.text import common_in_order

    rnd = random.Random(14)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert common_in_order(a, b) == table[-1][-1]
    assert common_in_order(list(range(20_000)), list(range(1, 20_001))) == 19_999 and common_in_order([None, 1], [1, None]) == 1


def test_ordered_changes_of_lone_groups(spark):
    from cairn.operators.text import ordered_changes

    t = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "x"), (4, 1, None)], "g long, o long, line string")
    b = spark.createDataFrame([(1, 1, "c"), (1, 2, "a"), (1, 3, "b"), (3, 1, "y"), (3, 2, "y"), (4, 9, None)], "g long, o long, line string")
    assert {tuple(r) for r in ordered_changes(t, b, ["g"], "o").collect()} == {(1, 1, 1, 1), (2, 1, 0, 0), (3, 0, 2, 0), (4, 0, 0, 0)}
    assert ordered_changes(t.limit(0), b.limit(0), ["g"], "o").count() == 0


def test_tail_of_t_against_a_numeric_integral():
    import numpy as np

    for degrees in (1, 2, 3, 10, 57):
        for r in (0.0, 0.05, -0.3, 0.7, 0.99):
            at = abs(r) * math.sqrt(degrees / (1 - r * r))
            # by the angle whose tangent is t / sqrt(degrees), where the density is a power of its cosine
            angles = np.linspace(0, math.pi / 2, 400_001)
            density = np.cos(angles) ** (degrees - 1)
            share = np.trapezoid(np.where(angles >= math.atan(at / math.sqrt(degrees)), density, 0), angles) / np.trapezoid(density, angles)
            assert abs(aggregates.t_tail(r, degrees) - share) < 1e-4, (degrees, r)
    assert aggregates.t_tail(1.0, 5) == 0 and abs(aggregates.t_tail(0.632, 8) - 0.05) < 1e-3


def test_correlation_tests_with_ties_and_constants(spark):
    rnd = random.Random(15)
    rows = [(float(rnd.randrange(4)), float(rnd.randrange(3)), 1.0) for _ in range(60)]
    rows = [(a, b + a, c) for a, b, c in rows] + [(None, 1.0, 1.0)]
    got = {r.column: r for r in aggregates.correlation_tests(spark.createDataFrame(rows, "a double, b double, c double"), ["a", "b", "c"], ["a"], "spearman").collect()}

    def ranks(x):
        return [sum(y < v for y in x) + (sum(y == v for y in x) + 1) / 2 for v in x]

    a, b = ranks([r[0] for r in rows[:-1]]), ranks([r[1] for r in rows[:-1]])
    mean = lambda x: sum(x) / len(x)
    cov = lambda x, y: sum((p - mean(x)) * (q - mean(y)) for p, q in zip(x, y, strict=True))
    assert abs(got["b"].r - cov(a, b) / math.sqrt(cov(a, a) * cov(b, b))) < 1e-5 and got["b"].p < 1e-6
    assert got["c"].r is None and got["c"].p is None and got["b"]["rank"] == 1 and set(got) == {"b", "c"}


def test_cox_of_ties_and_errors(spark):
    import numpy as np

    from tests.test_queries import cox_of

    rnd = random.Random(16)
    rows = [(float(rnd.randrange(1, 9)), int(rnd.random() < 0.7), rnd.random() * 3, float(rnd.randrange(2))) for _ in range(150)]
    df = spark.createDataFrame([*rows, (None, 1, 1.0, 1.0), (1.0, 1, None, 1.0)], "t double, e int, x double, y double")
    got = {r.term: (r.coefficient, r.error) for r in models.cox(df, "t", "e", ["x", "y"]).collect()}
    x = np.array(rows)
    beta, errors = cox_of(x[:, 2:], x[:, 0], x[:, 1] == 1)
    assert np.allclose([got["x"], got["y"]], np.column_stack([beta, errors]), atol=1e-4)
    with pytest.raises(ValueError):
        models.cox(df.withColumn("e", F.lit(0)), "t", "e", ["x"])


def test_sibling_kinds_of_a_hub(spark):
    rnd = random.Random(17)
    edges = [(0, i) for i in range(300)] + [(rnd.randrange(1, 9), rnd.randrange(300)) for _ in range(200)] + [(0, 5)]
    kinds = [(i, f"k{i % 7}") for i in range(290)]
    got = {(r.x, r.y): r.n for r in graph.sibling_kinds(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(kinds, "node long, kind string")).collect()}
    want = {}
    of = dict(kinds)
    for s in range(9):
        callees = sorted({d for a, d in edges if a == s and d in of})
        for i, a in enumerate(callees):
            for b in callees[i + 1 :]:
                key = tuple(sorted((of[a], of[b])))
                want[key] = want.get(key, 0) + 1
    assert got == want


def test_no_steps_are_no_paths(spark):
    edges = spark.createDataFrame([(1, 0, 5)], "g int, src long, dst long")
    assert graph.path_counts(edges, ["g"], spark.createDataFrame([(1, 0)], "g int, node long"), 5, 0).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3])
def test_density_clusters_against_all_pairs(spark, d):
    rnd = random.Random(18 + d)
    centres = [[rnd.uniform(-6, 6) for _ in range(d)] for _ in range(6)]
    points = [[rnd.gauss(c, 0.4) for c in rnd.choice(centres)] for _ in range(260)] + [[rnd.uniform(-9, 9) for _ in range(d)] for _ in range(40)]
    points += [points[0]] * 3 + [[0.5 * k] + [20.0] * (d - 1) for k in range(12)]  # copies, and a chain whose steps are eps
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(900, None, *[1.0] * (d - 1))], ", ".join(["id long", *[f"c{i} double" for i in range(d)]]))
    near = [[j for j, q in enumerate(points) if sum((a - b) ** 2 for a, b in zip(p, q, strict=True)) <= 0.25] for p in points]
    core = {i for i, n in enumerate(near) if len(n) >= 4}
    label = {i: i for i in core}
    for _ in core:
        new = {i: min([label[j] for j in near[i] if j in core]) for i in core}
        if new == label:
            break
        label = new
    want = {i: label[i] if i in core else min([label[j] for j in near[i] if j in core], default=None) for i in range(len(points))} | {900: None}
    assert {r.id: r.cluster for r in models.density_clusters(df, [f"c{i}" for i in range(d)], 0.5, 4).collect()} == want


def test_density_clusters_of_crowded_cells(spark):
    """Two cells of 50,000 points, apart by a little more than eps or by a little less."""
    for gap, clusters in ((1.0001, 2), (0.9999, 1)):
        left = spark.range(50_000).selectExpr("id", "-0.3 * rand(1) AS x", "0.3 * rand(2) AS y")
        right = spark.range(50_000, 100_000).selectExpr("id", f"{gap} + 0.3 * rand(3) AS x", "0.3 * rand(4) AS y")
        lone = spark.createDataFrame([(200_000, 0.0, 0.1), (200_001, gap, 0.1), (200_002, 50.0, 50.0)], "id long, x double, y double")
        got = models.density_clusters(left.unionByName(right).unionByName(lone), ["x", "y"], 1.0, 4)
        counts = {r.cluster: r["count"] for r in got.groupBy("cluster").count().collect()}
        assert counts.pop(None) == 1 and sorted(counts) == ([0, 50_000] if clusters == 2 else [0]) and sum(counts.values()) == 100_002


def test_file_statistics_of_all_tables(spark):
    files_ = spark.createDataFrame([("a",), ("b",), ("c",)], "oid string")
    names = spark.createDataFrame([("a", "z"), ("a", "y"), ("a", "y"), ("b", "x")], "oid string, name string")
    sections = spark.createDataFrame([("a", "text", 64), ("a", "head", 0)], "oid string, name string, start long")
    blocked = spark.createDataFrame([("a", 1, 1, "mov"), ("a", 1, 2, "mov"), ("a", 2, 9, "add"), ("b", 5, 5, "ret")], "oid string, faddr long, block long, mnemonic string")
    rtti = spark.createDataFrame([("a", True), ("b", False)], "oid string, rtti boolean")
    got = {r.oid: r.asDict() for r in aggregates.file_statistics(files_, names, sections, blocked, rtti, most=1).collect()}
    assert got["a"] == {"oid": "a", "names": ["y", "z"], "sections": 2, "parts": ["head", "text"], "functions": 2, "blocks": 3, "instructions": 3, "listed": [1, 2], "top": ["mov"], "rtti": True}
    assert got["b"]["functions"] == 1 and got["b"]["sections"] is None and got["b"]["rtti"] is False
    assert len(got) == 3 and all(v is None for k, v in got["c"].items() if k != "oid")


def test_pairs_by_name_of_files_with_several_names(spark):
    rnd = random.Random(19)
    some = lambda side: [(f"{side}{i:03}", f"n{min(rnd.randrange(9), rnd.randrange(9))}") for i in range(60) for _ in range(rnd.randrange(1, 4))] + [(None, "n1"), ("x", None)]
    t, b = some("t"), some("b")
    got = [tuple(r) for r in joins.pair_by_name(spark.createDataFrame(t, "oid string, name string"), spark.createDataFrame(b, "oid string, name string")).collect()]
    names = lambda rows: {o: {n for p, n in rows if p == o} for o, _ in rows}
    of_t, of_b = names(t), names(b)
    assert len({x for x, _ in got}) == len({y for _, y in got}) == len(got) > 40 and all((of_t[x] & of_b[y]) - {None} for x, y in got)
    left = [set().union(*[n for o, n in of.items() if o and o not in {r[k] for r in got}]) - {None} for k, of in ((0, of_t), (1, of_b))]
    assert not left[0] & left[1]
