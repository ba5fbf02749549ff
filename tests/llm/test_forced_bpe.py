import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import forced_bpe as fb

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def both():
    return fb.forced_codec(PATH, P.PATTERN), Tokenizer.from_file(PATH)


def same(both, text):
    own, library = both
    want = library.encode(text, add_special_tokens=False).ids
    coded = own.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == want
    assert own.decode(coded).decode() == library.decode(want, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="ab é\n\t\r\x1c\x85\xa0'sll19!?_　😀Ωж中", max_size=80))
def test_equal_to_the_library(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_equal_to_the_library_on_any_characters(both, text):
    same(both, text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "a", "don't", "'s", "-'s", "  x"]), max_size=12))
def test_added_tokens_as_the_library_takes_them(both, parts):
    same(both, "".join(parts))


def test_every_character_in_context(both):
    rnd = random.Random(1)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for _ in range(60):
        same(both, " ".join(chr(rnd.choice(points)) + rnd.choice(["", "a", "1 ", "\n", "'s"]) for _ in range(200)))


def test_cuts_are_certain(both):
    """No token holds a forced pair, and a match's fragments encoded apart are the match encoded whole."""
    own, library = both
    assert own.certain and " " in own.certain
    rnd = random.Random(2)
    several = 0
    for _ in range(3000):
        data = bytes(rnd.randrange(256) for _ in range(rnd.randrange(1, 12)))
        match = fb.printed(data)
        cut = own.fragments(match)
        assert "".join(cut) == match
        several += len(cut) > 1
        assert [t.id for t in own.model.tokenize(match)] == [t.id for f in cut for t in own.model.tokenize(f)]
    assert several > 1000


def test_long_texts_and_matches(both):
    rnd = random.Random(3)
    for alphabet in ("ab", "etaoin shrdlu", "a", "中文字", "0123456789", "!#", " ", "\n "):
        same(both, "".join(rnd.choice(alphabet) for _ in range(20_000)))


def test_rows_nulls_and_clashing_columns(spark):
    rows = [(1, None, "x"), (1, None, "x"), (2, "", None), (None, "the end<|endoftext|>", "y"), (3, "word " * 100_000, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = fb.encode(df, PATH, P.PATTERN, decoded="decoded")
    assert out.columns == ["doc_id", "ids", "decoded"]
    got = sorted(((r.doc_id or 0, bytes(r.decoded)) for r in out.collect()), key=lambda x: (x[0], len(x[1])))
    assert got == [(0, b"the end<|endoftext|>"), (1, b""), (1, b""), (2, b""), (3, b"word " * 100_000)]
    assert fb.encode(df.limit(0), PATH, P.PATTERN).count() == 0
