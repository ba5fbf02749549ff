import random
import zlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm import packing
from cairn.llm.common import written

PATH = P.path("word_bpe_49k.json")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 128), max_size=300))
def test_plan_uses_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=129) if lengths else np.zeros(129, int)
    used = np.zeros(129, int)
    for pattern, repeats in packing.plan(counts, 128):
        assert sum(pattern) <= 128 and repeats > 0
        for n in pattern:
            used[n] += repeats
    assert (used == counts).all()


def test_plan_is_near_the_lower_bound():
    rnd = random.Random(2)
    lengths = [max(1, min(2048, int(rnd.lognormvariate(6.3, 0.9)))) for _ in range(30_000)]
    planned = packing.plan(np.bincount(lengths, minlength=2049), 2048)
    assert sum(r for _, r in planned) <= 1.01 * -(-sum(lengths) // 2048)


def test_words_encode_as_whole_texts():
    rnd = random.Random(3)
    tokenizer = Tokenizer.from_file(PATH)
    own = packing.WordIds(PATH)
    for _ in range(1500):
        text = "".join(rnd.choice(rnd.choice(["a b", "aB'sT", " \n\t", "\x1c\x85", "éñß²½", "İΣς", "12 ", "!?_", "​　", "é", "<|endoftext|> ", "<|startoftext|>", "<|END", "|>"])) for _ in range(rnd.choice([0, 3, 30, 90])))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark):
    rows = [(1, None), (1, None), (2, ""), (3, "word " * 7000), (None, "a b"), (4, "x " * 2047), (5, "x " * 2048)] + [(i, "some words here " * (i % 50)) for i in range(10, 400)]
    df = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, length string")
    out = packing.packed(df, PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    total = sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sum(r.length for r in out) == total
    by_sequence = {}
    for r in out:
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_sequence.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 2
    assert packing.packed(df.limit(0), PATH).count() == 0


def test_one_length_for_a_third_of_all_rows(spark):
    df = written(spark.range(9000).selectExpr("id AS doc_id", "0 AS piece", "if(id % 3 = 0, 700L, id % 90 + 1) AS length"), "t")
    out = packing.pack(df, 2048, chunk_rows=500)
    assert out.count() == 9000 and out.select("sequence_id", "offset").distinct().count() == 9000
