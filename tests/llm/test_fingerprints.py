import hashlib
import random

from cairn.llm import fingerprints as f


def test_edited_texts_and_next_rows(spark):
    rnd = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "é😀", "zeta"]
    rows = [(i * 3 - 50, " ".join(rnd.choice(words) for _ in range(rnd.randrange(40))) or None) for i in range(2600)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(a, b, "c") for a, b in rows], "doc_id long, text string, fingerprint string")
    got = {r.doc_id: r for r in f.with_next(df).collect()}
    ordered, prints = sorted(rows), f.Prints()
    assert len(got) == len(rows)
    for i, (key, text) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        r = got[key]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == f"{prints(text):016x}" and r.edited_fingerprint == f"{prints(edited):016x}"
        assert r.near_next == f.likeness(prints(text), prints(after)) and r.near_edited == f.likeness(prints(text), prints(edited))


def test_few_and_repeated_rows(spark):
    one = f.with_next(spark.createDataFrame([(7, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(7, hashlib.sha256(b"abab").hexdigest())]
    same = f.with_next(spark.createDataFrame([(7, "ab"), (7, "ab"), (None, "xy")], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.near_next) for r in same)[:2] and len(same) == 3
    assert f.with_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_search_finds_all_within_the_radius(spark):
    rnd = random.Random(2)
    values = [rnd.getrandbits(64) for _ in range(300)]
    for v in values[:100]:
        for _ in range(rnd.randrange(5)):
            v ^= 1 << rnd.randrange(64)
            values.append(v)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in [*signed, signed[0], None]], "fp long")
    for radius in (0, 1, 3, 5):
        got = {(r["query"], r.found, r.distance) for r in f.within(df, df, radius).collect()}
        want = {(a, b, ((a ^ b) % 2**64).bit_count()) for a in signed for b in signed if a != b and ((a ^ b) % 2**64).bit_count() <= radius}
        assert got == want


def test_tables_cover_every_choice_of_blocks():
    for n in (10, 10**6, 10**9):
        for radius in (1, 3):
            masks = f.tables(n, radius)
            for bits in ([0, 1, 2][:radius], [5, 30, 60][:radius]):
                assert any(not any(m >> b & 1 for b in bits) for m in masks)


def brute_print(text):
    """Bit by bit: every distinct word and pair of neighbours votes with 1 + ln of its count."""
    import math
    from collections import Counter

    import xxhash

    own = [xxhash.xxh64_intdigest(w) for w in text.split()]
    terms = Counter(own)
    for a, b in zip(own, own[1:], strict=False):
        p = (a * 0x9E3779B97F4A7C15 + b) % 2**64
        p = (p ^ (p >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        terms[p ^ (p >> 31)] += 1
    out = 0
    for bit in range(64):
        vote = sum((1 if h >> bit & 1 else -1) * (1 + math.log(n)) for h, n in terms.items())
        out |= (vote > 1e-6) << bit
    return out


def test_prints_against_brute_force():
    rnd, prints = random.Random(6), f.Prints()
    texts = [" ".join(rnd.choice(["a", "bb", "é", "x1", "Y"]) + str(rnd.randrange(k)) for _ in range(n)) for n, k in ((1, 9), (2, 9), (9, 3), (41, 10), (333, 50), (2000, 9)) for _ in range(6)]
    for text in [*texts, "", " \n ", "word " * 50_001]:
        a, b = prints(text), brute_print(text)
        assert (a ^ b).bit_count() <= (0 if len(text) > 400 or not text.strip() else 1), text[:60]  # of few terms votes may tie


def test_a_very_long_text(spark):
    long = " ".join(f"w{i % 5003}" for i in range(150_000))
    rows = f.with_next(spark.createDataFrame([(1, long), (2, "short text"), (3, long)], "doc_id long, text string")).collect()
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == len(long) and by[1].fingerprint == by[3].fingerprint and by[3].near_next == 1.0
