import random
import re

import numpy as np
import xxhash

from cairn.llm import simhash_dedup as s
from cairn.llm.common import written


def brute_print(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, keys, distance):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    f = np.array(prints, np.uint64)
    for i in range(len(f)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= distance):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        r = find(i)
        least[r] = min(least.get(r, k), k)
    return [least[find(i)] for i in range(len(f))]


def test_fingerprints(spark):
    texts = [None, "", "One", "one two", "A b C", "a b c d É x\x0by\xa0z", "the same the same the same"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r.fingerprint % 2**64 for r in s.fingerprints(df).collect()}
    assert got == {i: brute_print(t) for i, t in enumerate(texts)}


def test_components_against_brute_force(spark):
    rnd = random.Random(11)
    prints = [0, 1, 3, 7, 2**63]
    for _ in range(150):
        base = rnd.getrandbits(64)
        prints.append(base)
        for _ in range(rnd.randrange(4)):
            base ^= 1 << rnd.randrange(64)
            if rnd.random() < 0.5:
                base ^= 1 << rnd.randrange(64)
            prints.append(base)
    hub = rnd.getrandbits(64)  # a crowded neighbourhood: all share most of their bits
    prints += [hub ^ (1 << rnd.randrange(40)) ^ (1 << rnd.randrange(40)) ^ (1 << rnd.randrange(40)) for _ in range(400)]
    prints += prints[:20]
    keys = list(range(1000, 1000 + len(prints)))
    rnd.shuffle(keys)
    df = written(spark.createDataFrame([(k, p - 2**64 if p >> 63 else p) for k, p in zip(keys, prints, strict=True)], "doc_id long, fingerprint long"), "t")
    for distance in (0, 1, 2):
        groups = {r.fingerprint: r.component_id for r in s.dedup(df, distance).collect()}
        got = [groups[p - 2**64 if p >> 63 else p] for p in prints]
        assert got == brute_components(prints, keys, distance), distance


def test_allocation_by_dynamic_programming():
    cost, given = s.allocated([[0, 10, 100], [0, 1, 5], [0, 50, 60]], 2)
    assert sum(t + 1 for t in given) == 3 and cost == min(10 + 5, 5 + 50, 10 + 1 + 50, 100 + 1)
    parts = s.grouped(np.eye(64), 10, 3)
    assert sorted(b for p in parts for b in p) == list(range(64)) and {len(p) for p in parts} <= {21, 22}


def test_empty_table(spark):
    df = written(spark.createDataFrame([], "doc_id long, fingerprint long"), "t")
    assert s.dedup(df).count() == 0
