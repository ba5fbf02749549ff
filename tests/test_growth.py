"""What the rounds of an operator read and write must not outgrow its input."""

import hashlib
import random
import time
import uuid
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd

from cairn.operators import aggregates, alike, graph, joins, sets, text, windows


def greedy(pairs):
    taken, out = (set(), set()), set()
    for s, t, b in sorted((-s, t, b) for t, b, s in pairs):
        if t not in taken[0] and b not in taken[1]:
            taken[0].add(t)
            taken[1].add(b)
            out.add((t, b, -s))
    return out


def test_greedy_matching_does_not_write_its_pairs_in_every_round(spark, monkeypatch):
    rnd = random.Random(5)
    # a chain of scores, so that few pairs are settled in a round, with ties and repeats
    pairs = [(t, b, round(rnd.random() + t / 20 + b / 20, 1)) for t in range(40) for b in range(40)]
    pairs += [(t, b, s - 0.5) for t, b, s in pairs[:200]]
    rows, kept = [], joins.checkpointed
    monkeypatch.setattr(joins, "FEW_PAIRS", 20)
    monkeypatch.setattr(joins, "checkpointed", lambda df: rows.append((x := kept(df)).count()) or x)
    given = spark.createDataFrame([*pairs, (None, 1, 9.0), (1, None, 9.0)], "t long, b long, s double")
    out = {tuple(r) for r in joins.one_to_one(given, "t", "b", "s").select("t", "b", "s").collect()}
    assert out == greedy(pairs)
    assert sum(rows) <= 4 * len(pairs)


def test_betweenness_by_matrix_equals_walks():
    rnd = random.Random(7)
    for n, m in ((1, 1), (2, 1), (6, 9), (40, 130), (60, 61)):
        pdf = pd.DataFrame([(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)], columns=["src", "dst"]).drop_duplicates()
        nodes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        got = graph._between_matrix(np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"]), len(nodes))
        assert abs(got - graph._between_walks(pdf, nodes.tolist())) < 1e-9


def test_edge_counts_need_no_paths(spark):
    rows = [("a", 1, 2), ("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("b", 5, 5)]
    got = graph.edge_counts(spark.createDataFrame(rows, "f string, src long, dst long"), "f")
    assert {(r.f, r.edges, r.nodes) for r in got.collect()} == {("a", 3, 3), ("b", 1, 1)}


def test_words_of_a_content_are_ranked_where_it_is_read(spark):
    rows = [("a", "cccc bbbb cccc dd eeeeeeee"), ("b", "x" * 9 + " yyyy"), ("c", None), ("d", "a-b")]
    given = spark.createDataFrame(rows, "oid string, text string")
    of = lambda choose: windows.best_words(given, 4, choose)
    key = lambda df: {(r.oid, r.value, r.score, r["rank"], r.total) for r in df.collect()}
    assert key(of(windows.first_words(2))) == {("a", "cccc", 2, 1, 0), ("a", "bbbb", 1, 2, 0), ("b", "x" * 9, 1, 1, 0), ("b", "yyyy", 1, 2, 0)}
    assert key(of(windows.prefix_words(8))) == {("a", "cccc", 2, 1, 4), ("a", "bbbb", 1, 2, 8), ("b", "x" * 9, 1, 1, 9)}
    assert key(of(windows.fitting_words(8))) == {("a", "cccc", 2, 1, 4), ("a", "bbbb", 1, 2, 4), ("b", "yyyy", 1, 2, 4)}
    assert key(of(windows.fitting_words(3))) == {("a", "cccc", 2, 1, 4), ("b", "x" * 9, 1, 1, 9)}
    assert "Exchange" not in of(windows.first_words(2))._jdf.queryExecution().executedPlan().toString()


def test_contents_come_to_python_in_small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    windows.printable_runs(spark.createDataFrame([("a", bytearray(b"hello"))], "oid string, data binary"))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000


def test_two_blocks_of_vectors_are_a_batch(spark, monkeypatch):
    asked, kept = [], text.row_by_row
    monkeypatch.setattr(text, "row_by_row", lambda df: asked.append(1) or kept(df))
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(8)], "vec_id long, embedding array<double>")
    assert text.nearest_each(vectors, vectors.where("vec_id = 0"), 2).count() == 2 and asked


def test_pieces_of_a_long_text_are_cut_in_one_pass(spark):
    long = "ab\n\u00e9\U0001f600\r\u2028 e\u0301" * 100_000  # 1,000,000 characters
    texts = [long, "", None, "abc", "abcd", "\n\n\n\n\n"]
    want = Counter(x[i : i + 4] for x in texts if x for i in range(0, len(x), 4))
    began = time.monotonic()
    got = {r.gram: r.n for r in aggregates.chunk_counts(spark.createDataFrame([(x,) for x in texts], "text string"), 4).collect()}
    assert got == want
    assert time.monotonic() - began < 30


def covered(spans):
    """Of each group its merged intervals, in order."""
    out = {}
    for g, a, b in sorted(spans, key=lambda x: (str(x[0]), x[1], x[2])):
        own = out.setdefault(g, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return out


def test_intervals_of_small_groups_are_united_in_one_shuffle(spark, monkeypatch):
    rnd = random.Random(11)
    spans = [(g, a := rnd.randrange(400), a + rnd.randrange(1, 12)) for g in [*range(30), None] for _ in range(rnd.randrange(1, 30))] + [(99, rnd.randrange(4000), 4000) for _ in range(300)]
    want = covered(spans)
    given = spark.createDataFrame(spans, "g long, start long, end long").repartition(4)
    key = lambda r: sorted(map(tuple, r), key=str)
    written, kept = [], sets.checkpointed
    monkeypatch.setattr(sets, "checkpointed", lambda df: written.append(1) or kept(df))
    monkeypatch.setattr(graph, "ROWS_IN_TASK", 50)
    for most, bucket in ((1 << 20, 1 << 16), (20, 4), (0, 1 << 16)):  # all alone, some of both, all in ranges
        monkeypatch.setattr(sets, "MOST_ALONE", most)
        monkeypatch.setattr(sets, "BUCKETS", bucket)
        assert key(sets.merged(given, ["g"]).collect()) == key((g, *x) for g, own in want.items() for x in own)
        assert key(sets.gaps(given, ["g"]).collect()) == key((g, x[1], y[0]) for g, own in want.items() for x, y in zip(own, own[1:], strict=False))
        if most == 1 << 20:
            assert not written and sets.merged(given, ["g"]).rdd.getNumPartitions() >= len(spans) // 50  # tasks grow in number, not in size
    assert written


def test_small_graphs_are_walked_many_in_a_batch(spark):
    edges = [(g, i, (i + 1) % 5) for g in range(40) for i in range(4 + g % 2)] + [(None, 1, 2), (None, 2, 1), (7, None, 1)]
    e = spark.createDataFrame(edges, "g long, src long, dst long")
    n = e.select("g", e.src.alias("node")).union(e.select("g", "dst")).union(spark.createDataFrame([(3, 77), (90, 1)], "g long, node long"))
    out = graph.strong_components(e.where("g IS NOT NULL AND src IS NOT NULL"), n.where("g IS NOT NULL AND node IS NOT NULL"), ["g"])
    want = {(g, i): 0 if g % 2 else i for g in range(40) for i in range(5)} | {(3, 77): 77, (90, 1): 1}
    assert {(r.g, r.node): r.component for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_files_of_imports_are_counted_in_parts(spark, monkeypatch):
    rnd = random.Random(2)
    pick = lambda k: rnd.choice([*range(k), None])
    rows = [(pick(40), pick(4), pick(9)) for _ in range(400)]
    files = lambda at, key: len({r[0] for r in rows if at(r) == key and r[0] is not None})
    want = {(r[1], None, files(lambda x: x[1], r[1]), None, "library") for r in rows}
    want |= {(r[1], r[2], files(lambda x: x[1:], r[1:]), None, "pair") for r in rows}
    want |= {(None, r[2], files(lambda x: x[2], r[2]), len({x[1] for x in rows if x[2] == r[2] and x[1] is not None}), "name") for r in rows}
    monkeypatch.setattr(graph, "ROWS_IN_TASK", 20)
    out = aggregates.import_popularity(spark.createDataFrame(rows, "oid long, library long, name long"))
    assert Counter(tuple(r) for r in out.collect()) == Counter(x[:4] for x in want)
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_a_round_of_adaptive_coverage_writes_its_imports_once(spark, monkeypatch):
    written, kept = [], aggregates.checkpointed
    monkeypatch.setattr(aggregates, "checkpointed", lambda df: written.append(1) or kept(df))
    rows = [(o, n) for o in range(30) for n in range(o % 7 + 1)] + [(1, 0), (None, 1), (1, None)]
    rounds = [tuple(r) for r in aggregates.adaptive_coverage(spark.createDataFrame(rows, "oid long, name long"), 0.95, 0.9, 0.0).collect()]
    assert rounds[0] == (1, 1, 5) and rounds[-1][2] == 30 and len(written) <= 1 + 2 * len(rounds)


def test_copies_of_a_set_are_compared_once(spark, monkeypatch):
    rnd = random.Random(4)
    kinds = [sorted({f"g{rnd.randrange(30)}" for _ in range(rnd.choice([1, 6, 14]))}) for _ in range(60)]
    # Set 0 is in one object only, set 1 in two and seldom in one of them, set 2 in all; the others have a copy or none.
    items = [(0, 0)] * 200 + [(1, 1)] * 150 + [(2, 1)] * 2 + [(o, 2) for o in range(8)] * 40 + [(rnd.randrange(8), x) for x in range(3, 60) for _ in range(rnd.choice([1, 2]))]
    rnd.shuffle(items)
    given = [(o, i, kinds[x]) for i, (o, x) in enumerate(items)] + [(None, 9000, kinds[2]), (1, None, kinds[2]), (1, 9001, [None]), (1, 9002, ["alone"])]
    like = lambda a, b: round(len(set(a) & set(b)) / len(set(a) | set(b)), 6)
    whole = [(o, i, g) for o, i, g in given if o is not None and i is not None and g != [None]]
    coded, kept = [], alike.checkpointed
    monkeypatch.setattr(alike, "checkpointed", lambda df: coded.append(df.count() if "codes" in df.columns else 0) or kept(df))
    monkeypatch.setattr(alike, "SETS_IN_BLOCK", 40)
    monkeypatch.setattr(alike, "FEWEST_SETS", 16)
    monkeypatch.setattr(alike, "BLOCKS_IN_STRIP", 2)
    for k, least in ((1, 0.0), (3, 0.4)):
        coded.clear()
        want = set()
        for o, i, g in whole:
            near = sorted((-s, j) for p, j, h in whole if p != o and (s := like(g, h)) > 0 and s >= least)[:k]
            want |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(near)}
        got = joins.closest(spark.createDataFrame(given, "object long, item long, grams array<string>"), k, least).collect()
        assert len(got) == len(want) and {tuple(r) for r in got} == want
        assert 0 < sum(coded) <= 2 * k * 61  # 800 items


def test_a_round_of_a_closure_writes_once(spark, monkeypatch):
    rnd = random.Random(6)
    edges = [(i, i + 1) for i in range(12)] + [(rnd.randrange(20, 90), rnd.randrange(20, 90)) for _ in range(70)] + [(3, 4)] * 5
    start = [(a, rnd.randrange(20, 90)) for a in range(300)] + [(7, 0)]
    ahead = {s: [d for x, d in edges if x == s] for s, _ in edges}
    want = set()
    for anchor, node in start:
        seen, queue = {node}, [node]
        for x in queue:
            new = set(ahead.get(x, ())) - seen
            seen |= new
            queue.extend(new)
        want |= {(anchor, x) for x in seen}
    e, first = spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(start, "anchor long, node long")
    written, kept = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: written.append(1) or kept(df))
    for most, rows in ((500_000, 500_000), (0, 50)):  # broadcast or not, in few tasks or many
        monkeypatch.setattr(graph, "MOST_NEW", most, raising=False)
        monkeypatch.setattr(graph, "ROWS_IN_TASK", rows)
        written.clear()
        got = [tuple(r) for r in graph.reachable_from_each(e, first).collect()]
        assert len(got) == len(want) and set(got) == want
        assert len(written) <= 20  # 13 rounds or some more


def test_an_assignment_is_auctioned_among_few_pairs(spark, monkeypatch):
    rnd = random.Random(13)
    # Equal pairs, hubs that all want, and pairs of no use.
    pairs = [(t, b, 0.9 if t < 6 and b < 7 else round(0.3 * rnd.random() + 0.5 * (b % 9 == 0), 3)) for t in range(20) for b in range(22)]
    sizes, written, kept = [], [], joins.checkpointed
    for few, least, given in ((5, 1, pairs), (1, 2, [(b, t, s) for t, b, s in pairs])):  # in one go or nearly so, and in several
        sizes.clear()
        written.clear()
        monkeypatch.setattr(joins, "SMALL_AUCTION", 300)
        monkeypatch.setattr(joins, "ONE_AUCTION", 30, raising=False)
        monkeypatch.setattr(joins, "BEST_PAIRS", few, raising=False)
        monkeypatch.setattr(joins, "checkpointed", lambda df: written.append(1) or kept(df))
        if hasattr(joins, "_settled"):
            settled = joins._settled
            monkeypatch.setattr(joins, "_settled", lambda df, n, steps, settled=settled: sizes.append(n) or settled(df, n, steps))
        got = [tuple(r) for r in joins.assigned(spark.createDataFrame([*given, given[0][:2] + (0.01,)], "t long, b long, s double"), "t", "b", "s", 1e-3).collect()]
        assert len({r[0] for r in got}) == len({r[1] for r in got}) == len(got) and set(got) <= set(given)
        best = sum(given[i][2] for i in joins.auction(*map(list, zip(*given, strict=True)), joins._epsilons(1.0, 1e-6)))
        assert best - 1e-3 * len(got) <= sum(r[2] for r in got) <= best + 1e-4
        assert len(written) <= 3 + 6 * max(1, len(sizes)) and least <= len(sizes) < 12 and max(sizes) < len(pairs)
        monkeypatch.undo()


def test_reports_of_numbered_pairs(spark):
    side = lambda ids: spark.createDataFrame([(x,) for x in ids], "oid string")
    numbered = lambda rows: spark.createDataFrame(rows, "id long, oid string")
    ids = (numbered([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "n"), (None, "b")]), numbered([(11, "a"), (12, "x"), (13, "x"), (14, "y"), (15, "m"), (16, None)]))
    scored = [(1, 12, 1.0), (2, 12, 0.9), (3, 13, 0.9), (2, 14, 0.8), (4, 12, 0.85), (4, 13, 0.85), (5, 14, 1.0), (4, 16, 1.0), (2, 15, 1.0)]
    report = joins.pair_files(side("abcn"), side("axym"), spark.createDataFrame([("n", "m")], "t string, b string"), spark.createDataFrame(scored, "t long, b long, score double"), ids)
    assert {tuple(r) for r in report.collect()} == {("a", "a", "matched"), ("n", "m", "modified"), ("b", "y", "modified"), ("c", "x", "modified")}


def test_imports_are_written_where_contents_are_read(spark, tmp_path, monkeypatch):
    from cairn.plans import base
    from cairn.plans.registry import QUERIES
    from cairn.sources import files

    texts = [f"text {i} é\r\n\n" for i in range(60)] + ["", None, "text 1", " \n ", "x" * 3_000_000]
    rows = [(i, x, "en", "src0", len(x or "")) for i, x in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/in/documents.parquet")
    want = sorted((hashlib.sha1(x.encode()).hexdigest(), len(x.encode())) for x in set(texts) if x)
    run = lambda: sorted(map(tuple, QUERIES["s1_import_directory"](spark, f"file://{tmp_path}/in").collect()))
    assert run() == want
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    made = max(shared.glob("files-*"), key=lambda p: p.stat().st_mtime)
    assert not list(made.rglob("*.crc")) and {p.name.removesuffix(".txt") for p in made.rglob("*") if p.is_file()} == {x[0] for x in want}
    monkeypatch.setattr(files, "MOST_LISTED", 7)
    assert run() == want  # some folders at a time
    monkeypatch.setattr(base, "_folder", lambda t, name: f"{shared}/other-{uuid.uuid4().hex}")  # a folder that only Spark may know
    assert run() == want
    (tmp_path / "none").mkdir()
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/none/documents.parquet")
    monkeypatch.undo()
    assert QUERIES["s1_import_directory"](spark, f"file://{tmp_path}/none").count() == 0
