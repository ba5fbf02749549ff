import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cairn.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    own = bpe.codec(PATH, P.PATTERN)
    return own, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def ids(own, text):
    return np.frombuffer(own.encode(text), "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\n\t\x1c\x85'sll19!?_　😀Ω", max_size=120), st.sampled_from([2, 5, 17, 4096]))
def test_any_leaf_size_gives_the_library_ids(both, text, leaf):
    own, library = both
    before, bpe.LEAF_CHARS = bpe.LEAF_CHARS, leaf
    try:
        assert ids(own, text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)) == text.encode()
    finally:
        bpe.LEAF_CHARS = before


def test_long_matches_join_by_growing_windows(both):
    own, library = both
    rnd = random.Random(4)
    for alphabet in ("ab", "etaoin shrdlu"[:6], "a", "中文字", "0123456789", "!#"):
        for n in (60, 300, 3000):
            text = "".join(rnd.choice(alphabet) for _ in range(n))
            assert ids(own, text) == library.encode_ordinary(text)


def test_join_is_associative(both):
    own, _ = both
    rnd = random.Random(5)
    for _ in range(200):
        a, b, c = ("".join(rnd.choice("ab \n1é") for _ in range(rnd.randrange(9))) for _ in range(3))
        n = [own.node(x) for x in (a, b, c)]
        assert own.join(own.join(n[0], n[1]), n[2]) == own.join(n[0], own.join(n[1], n[2]))


def test_rows_nulls_and_clashing_columns(spark, both):
    own, _ = both
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "the end", "y"), (3, "word " * 30_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.encode(df, PATH, P.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, bytes(r.decoded)) for r in out.collect()), key=lambda x: (x[0], len(x[1])))
    assert got == [(0, b"the end"), (1, b""), (1, b""), (2, b""), (3, b"word " * 30_000)]
    assert bpe.encode(df.limit(0), PATH, P.PATTERN).count() == 0
    again = bpe.decode(bpe.encode(df, PATH, P.PATTERN), PATH, P.PATTERN)
    assert {bytes(r.decoded) for r in again.collect()} == {x for _, x in got}
