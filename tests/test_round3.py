"""Cases of the third review: each failed before its finding was settled."""

import duckdb
import pytest

from __spark_entry__ import oracle_sql, queries


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder of its own, which is returned."""

    def write(**frames):
        for name, df in frames.items():
            df.coalesce(1).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return tmp_path

    return write


def by_sql(name, folder):
    db = duckdb.connect()
    for path in folder.glob("*.parquet"):
        db.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    return db.sql(oracle_sql()[name]).fetchall()


def documents(spark, texts):
    rows = [(i, x, "en", f"src{i % 2}", len(x)) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_sizes_from_100_000_bytes_on(spark, tables):
    folder = tables(documents=documents(spark, ["x" * n for n in (5, 999, 1000, 99_999, 100_000, 2_000_000)]))
    got = sorted(tuple(r) for r in queries()["a12_corpus_summary"](spark, f"file://{folder}").collect())
    assert got == sorted(by_sql("a12_corpus_summary", folder))


def test_likeness_by_blocks(spark, monkeypatch):
    """Several blocks, elements of many sets and of few, nulls; before, all pairs that shared an element carried both their sets."""
    import random

    from cairn.operators import alike

    monkeypatch.setattr(alike, "SETS_IN_BLOCK", 16)
    monkeypatch.setattr(alike, "CELLS", 64)
    rnd = random.Random(5)
    sets = [(f"d{i:02}", [f"g{min(rnd.randrange(60), rnd.randrange(60))}" for _ in range(rnd.choice([0, 1, 3, 12, 40]))]) for i in range(70)]
    df = spark.createDataFrame([(i, [*g, None]) for i, g in sets] + [(None, ["g1"])], "id string, grams array<string>")
    left, right = df.where("id IS NULL OR id < 'd50'"), df.where("id IS NULL OR id > 'd30'")
    like = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 0.0
    for least in (0.02, 0.4):
        want = {(i, j, round(like(a, b), 6)) for i, a in sets if i < "d50" for j, b in sets if j > "d30" and like(a, b) >= least}
        assert {tuple(r) for r in alike.alike_pairs(left, right, least).collect()} == want
    best = set()
    for x, (i, a) in enumerate(sets):
        near = sorted((-round(like(a, b), 6), j) for y, (j, b) in enumerate(sets) if y % 3 != x % 3 and like(a, b) > 0)[:3]
        best |= {(i, j, -s, r + 1) for r, (s, j) in enumerate(near)}
    objects = spark.createDataFrame([(x % 3, i, g) for x, (i, g) in enumerate(sets)], "object long, item string, grams array<string>")
    assert {tuple(r) for r in alike.closest(objects, 3).collect()} == best


def test_matches_are_those_of_the_sql(spark, tables):
    texts = ["a b c d e f g h", "A b c d x y z", "one", "one", "two words", "two words", "", "", "a  b c d", "b c d e f", "q r s t", "q r s t u"]
    folder = tables(documents=documents(spark, texts))
    for name in ("w3_similarity_rank", "a18_file_classes", "j5_similarity_pairs"):
        assert sorted(map(tuple, queries()[name](spark, f"file://{folder}").collect()), key=str) == sorted(by_sql(name, folder), key=str), name


def test_rows_of_a_truth_file_go_alone(spark, tmp_path):
    import re

    from cairn.sources import files

    (tmp_path / "a.truth").write_text('[{"oid": "x", "type": "functions"},\n[5, "f"],\n[9, "g"]]')
    found = files.read_truth(spark, f"file://{tmp_path}/a.truth")
    assert [(r.oid, r.type, r.position, r.offset, list(r.fields)) for r in found.orderBy("offset").collect()] == [("x", "functions", 0, 5, ["f"]), ("x", "functions", 1, 9, ["g"])]
    carried = re.search(r"Generate posexplode\(.*\), \[([^]]*)\], ", found._jdf.queryExecution().executedPlan().toString()).group(1)
    assert "oid" in carried and "rows" not in carried


def test_scores_of_strings_without_their_texts(spark, tables, monkeypatch):
    from cairn.operators import text

    folder = tables(documents=documents(spark, ["The cat sat\nthe  CAT, sat\n\nno", "a b\nthe end of all", "the end of all\nthe end of all", "", "12 34"]))
    for most in (text.MOST_BROADCAST, 0):
        monkeypatch.setattr(text, "MOST_BROADCAST", most)
        for name in ("t4_term_idf", "t5_string_scores", "t6_packed_documents"):
            assert sorted(map(tuple, queries()[name](spark, f"file://{folder}").collect())) == sorted(by_sql(name, folder)), name


def test_points_of_objects_with_few_intervals_are_not_repeated(spark, monkeypatch):
    import random

    from cairn.operators import joins

    rnd = random.Random(3)
    points = [(o, rnd.randrange(-50, 400)) for o in "abc" for _ in range(60)] + [(None, 5), ("a", None)]
    spans = [("a", 0, 64), ("a", 64, 200), ("a", -20, 5)] + [("b", rnd.randrange(-50, 300), rnd.choice([0, 1, 7, 90])) for _ in range(20)] + [("c", None, 5), (None, 0, 90)]
    p, s = spark.createDataFrame(points, "oid string, offset long"), spark.createDataFrame(spans, "oid string, start long, len long")
    want = sorted((o, x, a, n) for o, x in points for q, a, n in spans if o and o == q and x is not None and a is not None and a <= x < a + n)
    for few in (joins.FEW_INTERVALS, 2, 100):
        monkeypatch.setattr(joins, "FEW_INTERVALS", few)
        assert sorted((r.oid, r.offset, r.start, r.len) for r in joins.contained(p, s).collect()) == want
    assert "explode" not in joins.contained(p, s)._jdf.queryExecution().optimizedPlan().toString()


def test_closures_of_many_anchors(spark):
    import random

    from cairn.operators import graph

    rnd = random.Random(8)
    edges = {(rnd.randrange(120), rnd.randrange(120)) for _ in range(170)}
    start = {(a, rnd.randrange(120)) for a in range(-3, 140) for _ in range(2)}
    want = set()
    for anchor, node in start:
        seen, queue = {node}, [node]
        for x in queue:
            new = {d for s, d in edges if s == x} - seen
            seen |= new
            queue.extend(new)
        want |= {(anchor, x) for x in seen}
    got = graph.reachable_from_each(spark.createDataFrame([*edges, (None, 1)], "src long, dst long"), spark.createDataFrame([*start, (None, 1), (1, None)], "anchor long, node long"))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert graph.reachable_from_each(spark.createDataFrame([], "src long, dst long"), spark.createDataFrame([], "anchor long, node long")).count() == 0


def test_files_are_written_side_by_side(spark, tables):
    from pathlib import Path

    folder = tables(documents=documents(spark, [f"text {i}" for i in range(30)] + ["text 1", ""]))
    got = sorted(map(tuple, queries()["s1_import_directory"](spark, f"file://{folder}").collect()))
    assert got == sorted(by_sql("s1_import_directory", folder)) and len(got) == 30
    made = max(Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")).glob("files-*"), key=lambda p: p.stat().st_mtime)
    assert len({p.parent for p in made.rglob("*.txt")}) > 8
