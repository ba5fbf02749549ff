import random

import numpy as np
import pytest

from cairn.llm import simhash_dedup as d
from cairn.llm import simhash_near as n
from cairn.llm.common import written


def test_components_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(n, "GROUP", 60)  # many blocks
    rnd = random.Random(9)
    flip = lambda x, k: x ^ sum({1 << rnd.randrange(64) for _ in range(k)})
    prints = []
    for _ in range(120):
        a, b = rnd.getrandbits(64), rnd.getrandbits(64)
        for _ in range(rnd.randrange(1, 5)):
            prints.append((a, b))
            a, b = flip(a, rnd.randrange(14)), flip(b, rnd.randrange(18))
    a, b = rnd.getrandbits(64), rnd.getrandbits(64)
    prints += [(flip(a, rnd.randrange(9)), flip(b, rnd.randrange(9))) for _ in range(300)]
    prints = sorted({x: y for x, y in prints}.items())
    first, second = (np.array(x, np.uint64) for x in zip(*prints, strict=True))
    parent = list(range(len(first)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(first)):
        for j in np.flatnonzero((np.bitwise_count(first ^ first[i]) <= 11) & (np.bitwise_count(second ^ second[i]) <= 14)):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    rows = [(i, int(x), int(y)) for i, (x, y) in enumerate(zip(first.view(np.int64), second.view(np.int64), strict=True))]
    df = written(spark.createDataFrame(rows, "doc_id long, fp long, fp2 long"), "t")
    found = {r.node: r.component for r in n.fp_components(df, 11, 14).collect()}
    got, at = [found.get(x, x) for _, x, _ in rows], {}
    for i, c in enumerate(got):
        at.setdefault(c, i)
    assert [at[c] for c in got] == [find(i) for i in range(len(rows))]


def test_radii_cover_the_distance(spark):
    df = written(spark.createDataFrame([(random.Random(i).getrandbits(63), i) for i in range(500)], "fp long, fp2 long"), "t")
    for distance in (2, 8, 11):
        probes = n.radii(df, 500, distance)
        assert sum(2 * r + 1 for _, _, r in probes) > distance
        assert all(not a[0] & b[0] for a in probes for b in probes if a is not b)


def test_empty_table(spark):
    df = written(spark.createDataFrame([], "doc_id long, fp long, fp2 long"), "t")
    assert n.fp_components(df, 11, 14).count() == 0
    assert n.prints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_each_second_fingerprint_counts(spark):
    far = (1 << 40) - 1
    df = written(spark.createDataFrame([(1, 0, 0), (2, 0, far), (3, 1, far), (4, -1, -1)], "doc_id long, fp long, fp2 long"), "t")
    assert {r.node: r.component for r in n.fp_components(df, 11, 14).collect()} == {0: 0, 1: 0}


def similarity(a, b):
    """The larger of the Jaccard similarity of the five-word shingles and the share of words in common ones, word by word."""
    words = [(x or "").lower().split() for x in (a, b)]
    grams = [[tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] for w in words]
    one, two = map(set, grams)
    jaccard = len(one & two) / len(one | two)
    covered = [{i + k for i, g in enumerate(own) for k in range(5) if g in other} for own, other in ((grams[0], two), (grams[1], one))]
    return max(jaccard, sum(map(len, covered)) / sum(len(g) + 4 for g in grams))


def edited(rnd, words, base, edits):
    other = list(base)
    for i in rnd.sample(range(len(base)), edits):
        other[i] = rnd.choice(words)
    return other


@pytest.mark.parametrize("members", [1024, 3])
def test_only_texts_alike_in_four_fifths_go(spark, monkeypatch, members):
    monkeypatch.setattr(n, "GROUP", members)  # 3: pivots and blocks
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", None, "one two", "one  two", "One two three", "long " * 30_000]
    for _ in range(12):
        base = rnd.choices(words, k=200)
        texts += [" ".join(edited(rnd, words, base, k)) for k in (0, 0, 2, 4, 5, 8, 14, 22, 30)]
    base = rnd.choices(words, k=120)
    texts += [" ".join(edited(rnd, words, base, 6)) for _ in range(30)]
    df = spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "key long, row long, text string")
    df = written(n.prints(df), "t")
    groups = {r.node: r.component for r in n.fp_components(df, 11, 20).collect()}
    group = [groups.get(r.fp, r.fp) for r in df.orderBy("row").collect()]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if group[i] == group[j] and similarity(texts[i], texts[j]) >= 0.8:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    got = {r.row for r in n.near_rows(df, "key", "row").collect()}
    assert got == {find(i) for i in range(len(texts))}
    assert len(got) > len(set(group))  # some candidates are not alike
    assert n.near_rows(df.limit(0), "key", "row").count() == 0


def test_recall_of_edited_copies(spark):
    """Of pairs that are alike by brute force, nearly all are joined; texts that share nothing stay."""
    rnd = random.Random(8)
    words = [f"w{int(rnd.paretovariate(0.7))}" for _ in range(60_000)]
    texts = []
    for _ in range(150):
        base = rnd.choices(words, k=rnd.randrange(60, 500))
        texts += [" ".join(base), " ".join(edited(rnd, words, base, max(1, len(base) // 22)))]
    df = written(n.prints(spark.createDataFrame([(i, i, x) for i, x in enumerate(texts)], "key long, row long, text string")), "t")
    stay = {r.row for r in n.near_rows(df, "key", "row").collect()}
    near = [i for i in range(0, len(texts), 2) if similarity(texts[i], texts[i + 1]) >= 0.8]
    assert len(near) > 100 and sum(i + 1 not in stay for i in near) >= 0.9 * len(near)
    assert all(i in stay for i in range(0, len(texts), 2))
    assert all(i + 1 in stay for i in range(0, len(texts), 2) if i not in near)
