import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import alignment as al
from cairn.llm import forced_bpe
from cairn.llm.common import written

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return al.aligner(A, P.PATTERN, B), a, sentencepiece.SentencePieceProcessor(model_file=B)


def brute(both, text):
    """(groups, links) of a text by the libraries on the whole text, with every pair of tokens compared; None without tokens."""
    _, a, b = both
    if not text:
        return None
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    data = (
        [bytes(forced_bpe.AS_BYTE[c] for c in a.id_to_token(i)) for i in ids[0]],
        [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]],
    )
    if any(b"".join(x) != (" " + text).encode() for x in data):
        return None
    spans = []
    for side in data:
        at, own = 0, []
        for x in side:
            own.append((at, at + len(x)))
            at += len(x)
        spans.append(own)
    cuts = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, start = [], 0
    for cut in cuts:
        groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids[k], spans[k], strict=True) if start <= s and e <= cut) for k in (0, 1)))
        start = cut
    links = [(i, j) for i, (s, e) in zip(ids[0], spans[0], strict=True) for j, (x, y) in zip(ids[1], spans[1], strict=True) if s < y and x < e]
    return ";".join(groups), len(ids[0]), len(ids[1]), len(groups), links


def check(both, text):
    want = brute(both, text) or ("", 0, 0, 0, [])
    got = both[0].align(text)
    assert got[:4] == want[:4], text
    keys = memoryview(got[4]).cast("q").tolist(), memoryview(got[5]).cast("q").tolist()
    assert Counter({(k >> 32, k & 0xFFFFFFFF): n for k, n in zip(*keys, strict=True)}) == Counter(want[4])
    return bool(want[4])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\r;'sl19!_　😀ж中▁\x00<", max_size=50))
def test_equal_to_comparing_all_tokens(both, text):
    check(both, text)


def test_words_in_many_languages_and_special_strings(both):
    rnd = random.Random(1)
    words = ["the", "über", "niño", "<s>", "</s>", "<unk>", "<0x0A>", "<|endoftext|>", "данные", "漢字かな", "don't", "1234567", "  ", "\n\n", ";\r\n", "voilà", "\t", "à la", " ", "antidisestablishmentarianism"]
    assert sum(check(both, rnd.choice(["", " "]).join(rnd.choice(words) for _ in range(rnd.randrange(1, 30)))) for _ in range(300)) > 250


def test_a_small_cache_changes_nothing(both):
    own = al.Aligner(A, P.PATTERN, B)
    own.known.entries = 3
    rnd = random.Random(4)
    for _ in range(200):
        text = " ".join(rnd.choice(["a", "b,", "cc", "über", "dd.", "x y", "\n"]) for _ in range(12))
        assert own.align(text)[:4] == both[0].align(text)[:4]
        assert not own.coded


def test_groups_at_shared_cuts():
    rnd = random.Random(2)
    for _ in range(2000):
        end = rnd.randrange(1, 30)
        a, b = (sorted({*rnd.sample(range(1, end + 1), rnd.randrange(end)), end}) for _ in range(2))
        got = al.groups(a, b)
        assert [(a[j - 1], b[m - 1]) for _, j, _, m in got] == [(c, c) for c in sorted(set(a) & set(b))]
        assert [x for i, j, _, _ in got for x in range(i, j)] == list(range(len(a))) and [x for _, _, k, m in got for x in range(k, m)] == list(range(len(b)))
    assert al.groups([], []) == []
    n = 200_000  # no shared cut, only at the far end, and everywhere
    for b in ([2 * n], [*range(1, 2 * n, 2), 2 * n], list(range(1, n + 1)) + [2 * n]):
        a = [*range(2, 2 * n + 1, 2)] if b[0] != 1 or b[1] == 3 else list(range(1, n + 1)) + [2 * n]
        assert len(al.groups(a, b)) == len(set(a) & set(b))


def test_counts_over_the_corpus(spark, both):
    """Documents' sums against brute force, with repeated rows, nulls, long texts and several blocks."""
    rnd = random.Random(3)
    words = ["the", "thing", "über", "x", "niño!", "sun", "1999", "don't", "漢字", "a▁b"]
    texts = [" ".join(rnd.choice(words[: rnd.randrange(2, 11)]) for _ in range(rnd.randrange(1, 12))) for _ in range(120)]
    texts += [None, "", None, "the the the", "the the the", " ", "word " * 2_000, "x" * 5_000]
    df = spark.createDataFrame([(i // 2, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, groups string, n_a long").repartition(5)
    before, al.BLOCK_ROWS = al.BLOCK_ROWS, 7
    try:
        table = written(al.aligned(df, A, P.PATTERN, B, keep=("doc_id", "text")), "aligned")
        got = al.linked(table).collect()
        assert table.select("block").distinct().count() >= 5
    finally:
        al.BLOCK_ROWS = before
    found = [brute(both, t) for t in texts]
    count = Counter(p for f in found if f for p in set(f[4]))
    most: dict = {}
    for (a, _), n in count.items():
        most[a] = max(most.get(a, 0), n)
    want = Counter()
    for i, (t, f) in enumerate(zip(texts, found, strict=True)):
        links = f[4] if f else []
        want[i // 2, t, *(f or ("", 0, 0, 0))[:4], len(links), sum(count[p] == most[p[0]] for p in links), sum(count[p] for p in links)] += 1
    assert Counter(tuple(r) for r in got) == want


def test_empty_table_and_query(spark, sf, both):
    from cairn.llm.queries import op11_alignment

    df = spark.createDataFrame([], "doc_id long, text string")
    assert al.linked(written(al.aligned(df, A, P.PATTERN, B), "aligned")).count() == 0
    rows = {r.doc_id: r for r in op11_alignment(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    found = {d.doc_id: brute(both, d.text) for d in docs if len(d.text or "") < 3000}
    for i, f in found.items():
        assert (rows[i].n_a, rows[i].n_b, rows[i].n_groups, rows[i].n_links) == ((*f[1:4], len(f[4])) if f else (0, 0, 0, 0))
        assert rows[i].groups_sha256 == (hashlib.sha256(f[0].encode()).hexdigest() if f else "")
