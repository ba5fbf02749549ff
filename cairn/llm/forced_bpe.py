"""Byte-level BPE by forced boundaries.

A merge always makes a token of the vocabulary, so two neighbouring bytes that stand together in
no token are never merged across: their boundary is in the encoding, whatever stands around it.
The table of pairs that do occur inside tokens is taken from the vocabulary once. It gives the cuts
of two levels. A text is cut into chunks where such a pair ends in white space: the splitting
pattern never matches over these places, or only where its match would be cut all the same, so the chunks'
matches are the text's. (Of letters and a blank, only those ending in byte A0 are not certain; no cut is made
after them.) A chunk falls into matches of the pattern, and a match into fragments at its own certain pairs. Each
fragment is encoded alone, once, and the ids are concatenated; decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty

#: For each of two generations of chunks and of matches, in each Python worker.
CACHE_ENTRIES = 300_000
#: Text in which this module's own pattern and the library's agree on every character's class.
LATIN = re.compile("[\x00-ɏ]*\\Z").match
#: A byte as byte-level vocabularies write it: itself where it is printable, else the next character from 256 on.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
AS_PRINTED = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
AS_BYTE = {chr(AS_PRINTED.get(b, b)): b for b in range(256)}
BLANK = chr(AS_PRINTED[32])
SPACES = "\t\n\x0b\x0c\r "


def printed(data: bytes) -> str:
    return data.decode("latin-1").translate(AS_PRINTED)


def cut_before(spaces: str, uncertain: set[int]) -> str:
    """A pattern that finds the chunks of a text: cut before one of spaces after any other character, but for those that end in an uncertain byte."""
    if not spaces:
        return r"(?s:.+)"
    space = f"[{re.escape(spaces)}]"
    # Characters beyond the basic plane all count as uncertain: so many single ones would make the class slow.
    odd = "".join(chr(x) for x in range(128, 0x10000) if not 0xD800 <= x < 0xE000 and (x & 63 | 128) in uncertain) + "\U00010000-\U0010ffff"
    return f"{space}*(?:[^{space[1:-1]}{odd}]+|[{odd}]+{space}*)+|{space}+"


class ForcedCodec:
    """A byte-level BPE file of the tokenizers library: encoding by certain cuts, decoding.

    special: whether the strings of added tokens in a text are these tokens, as they are for the library by default.
    """

    def __init__(self, path: str, pattern: str, special: bool = True):
        import regex
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)["pre_tokenizer"]
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or tokenizer.normalizer is not None:
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.model, self.split = tokenizer.model, tokenizer.pre_tokenizer.pre_tokenize_str
        self.matches = regex.compile(pattern).findall
        vocabulary = tokenizer.get_vocab(with_added_tokens=False)
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items() if t.content}
        self.data = {i: bytes(map(AS_BYTE.__getitem__, t)) for t, i in vocabulary.items()} | {i: t.encode() for t, i in added.items()}
        #: Pairs of neighbouring bytes, as printed, that stand inside a token.
        self.inside = {t[i : i + 2] for t in vocabulary for i in range(len(t) - 1)}
        self.added = {t: array("I", [i]).tobytes() for t, i in added.items()} if special else {}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self.certain, self.uncertain = self.certain_spaces()
        self.chunks = re.compile(cut_before(self.certain, self.uncertain)).findall
        self.cache, self.known, self.pieces = Memo(self.chunk, CACHE_ENTRIES), Memo(self.match, CACHE_ENTRIES), Memo(self.fragment, CACHE_ENTRIES)

    def certain_spaces(self) -> tuple[str, set[int]]:
        """The white space before which a cut is certain, and the last bytes of characters after which it is not."""
        found = set(SPACES)
        while True:
            white = {printed(x.encode()) for x in found}
            before = {c: {AS_BYTE[p[0]] for p in self.inside if p[1] == printed(c.encode()) and p[0] not in white} for c in found}
            if not (gone := {c for c, x in before.items() if x and min(x) < 128}):
                return "".join(sorted(found)), set().union(*before.values())
            found -= gone

    def fragments(self, match: str) -> list[str]:
        """A match, as printed, cut at every pair that is inside no token."""
        inside, start, out = self.inside, 0, []
        if all(map(inside.__contains__, map(add, match, match[1:]))):
            return [match]
        for i in range(1, len(match)):
            if match[i - 1 : i + 1] not in inside:
                out.append(match[start:i])
                start = i
        out.append(match[start:])
        return out

    def fragment(self, text: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def match(self, text: str) -> bytes:
        cut = self.fragments(printed(text.encode()))
        return self.fragment(cut[0]) if len(cut) == 1 else b"".join(map(self.pieces.__getitem__, cut))

    def word(self, text: str) -> list[int]:
        """Ids of letters, with or without a blank before them: one match."""
        cut = self.fragments(text.replace(" ", BLANK) if text.isascii() else printed(text.encode()))
        if len(cut) == 1:
            return [t.id for t in self.model.tokenize(cut[0])]
        return [i for f in cut for i in memoryview(self.pieces[f]).cast("I")]

    def chunk(self, text: str) -> bytes:
        if LATIN(text):
            return b"".join(map(self.known.__getitem__, self.matches(text)))
        return b"".join([self.known[text[a:b]] for _, (a, b) in self.split(text)])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.chunks(text)))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        if not any(x in text for x in self.added):
            return self.plain(text)
        return b"".join([self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.parts(text))])

    def decode(self, ids: bytes) -> bytes:
        """The text of ids, in UTF-8; bytes that are none become the replacement character."""
        data = b"".join(map(self.data.__getitem__, memoryview(ids).cast("I")))
        return data.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def forced_codec(path: str, pattern: str, special: bool = True) -> ForcedCodec:
    return ForcedCodec(path, pattern, special)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without its text column, with ids (binary: little-endian unsigned 32-bit) and, if named, the decoded text's UTF-8.

    path is a byte-level BPE file of the tokenizers library, pattern the one it splits by. Null and empty texts have
    empty ids. Every row gives one row, repeated ones too; a column of df that is named like a new one is
    replaced. A very long text is one row of one task, its fragments are encoded one by one. An empty df gives no rows.
    """
    small_batches(df.sparkSession, 500)
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    new = [ids, *([decoded] if decoded else [])]
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(c, T.BinaryType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forced_codec(path, pattern)
        for batch in batches:
            coded = [own.encode(x) for x in batch.column(len(rest)).to_pylist()]
            out = [pa.array(coded, pa.binary())] + ([pa.array([own.decode(x) for x in coded], pa.binary())] if decoded else [])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + out, names=rest + new)

    return df.select(*[f"`{c}`" for c in rest], text_or_empty(text).alias("__text")).mapInArrow(run, schema)
