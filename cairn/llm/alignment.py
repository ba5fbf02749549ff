"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Both encodings of a text cover the same bytes. A byte offset where a token of either ends is a
shared cut: the search for one begins near the middle of an interval and tests the ends of the one
tokenizer among those of the other by bisection; both halves are treated alike, and an interval without a
shared cut is a leaf, a group of tokens of both sides. The blanks before which neither vocabulary
has a token that reaches across are shared cuts that need no search; what lies between two of
them is encoded, cut and linked once for all texts that hold it.

How many documents hold a pair of ids linked is counted over the whole corpus in Spark. A block of
documents keeps each of its pairs once, so the counts meet the blocks, not the documents, in a join; a
block's pairs then meet its documents in one task, bounded by the size of a block.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty, written
from cairn.llm.forced_bpe import LATIN, ForcedCodec, cut_before

#: For each of two generations of stretches, in each Python worker.
CACHE_ENTRIES = 300_000
MARK = "▁"
#: A block's documents and bytes of text, at most (but a longer text is a block of its own).
BLOCK_ROWS, BLOCK_BYTES = 2000, 16 << 20
#: A pair of ids as one number: the first one's, then 32 bits of the second's.
SIDE = 32


def groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """(i, j, k, l) in order: tokens i to j of A and k to l of B are a group, without a shared cut inside.

    Both lists ascend and have the same last offset.
    """
    out, open_ = [], [(0, len(ends_a), 0, len(ends_b))]
    while open_:
        i, j, k, m = open_.pop()
        if j - i > 1 and m - k > 1:  # else there is no end inside both
            first = ends_a[i - 1] if i else 0
            right = bisect_left(ends_a, (first + ends_a[j - 1]) // 2, i, j - 1)
            left = right - 1
            middle = first + ends_a[j - 1]
            while left >= i or right < j - 1:  # outwards from the middle
                if right >= j - 1 or left >= i and middle - 2 * ends_a[left] < 2 * ends_a[right] - middle:
                    at, left = left, left - 1
                else:
                    at, right = right, right + 1
                other = bisect_left(ends_b, ends_a[at], k, m - 1)
                if other < m - 1 and ends_b[other] == ends_a[at]:
                    open_.append((at + 1, j, other + 1, m))
                    open_.append((i, at + 1, k, other + 1))
                    break
            else:
                out.append((i, j, k, m))
        elif j > i:
            out.append((i, j, k, m))
    return out


def linked_pairs(a: list[int], b: list[int], ends_a: list[int], ends_b: list[int]) -> list[int]:
    """Every pair of ids whose tokens overlap within a group, in order: neighbours overlap until both sides end."""
    if len(a) == 1 or len(b) == 1:
        return [x << SIDE | y for x in a for y in b]
    pairs, i, k = [], 0, 0
    while i < len(a) and k < len(b):
        pairs.append(a[i] << SIDE | b[k])
        end_a, end_b = ends_a[i], ends_b[k]
        i, k = i + (end_a <= end_b), k + (end_b <= end_a)
    return pairs


class Aligner:
    """A: a byte-level BPE file of the tokenizers library. B: a sentencepiece model that puts a blank before a text."""

    def __init__(self, path_a: str, pattern_a: str, path_b: str):
        import sentencepiece

        self.a = ForcedCodec(path_a, pattern_a, special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.size_a = [len(self.a.data.get(i, b"")) for i in range(max(self.a.data) + 1)]
        self.data_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace(MARK, " ").encode() for i, x in enumerate(pieces)]
        self.size_b = list(map(len, self.data_b))
        self.names = list(map(str, range(max(len(self.size_a), len(self.size_b)))))
        inside = {x[i : i + 2].replace(MARK, " ") for n, x in enumerate(pieces) if not self.b.is_byte(n) for i in range(len(x) - 1)}
        reached = {p[1] for p in inside if p[0] != p[1]}
        self.stretches = re.compile(self.shared_cuts("".join(c for c in self.a.certain if c not in reached), inside)).findall
        #: What is put before a stretch that begins otherwise than by a blank, so that the blank of the library's own stays apart.
        self.before = self.b.encode("\n") if not any("\n" in p for p in inside) else None
        self.blank = [i for i, x in enumerate(pieces) if x == MARK]
        self.known, self.coded = Memo(self.unit, CACHE_ENTRIES), {}

    def shared_cuts(self, spaces: str, inside: set[str]) -> str:
        """A pattern that finds the stretches of a text: cut before spaces that neither vocabulary reaches across, and between a Latin letter or
        digit and a mark, where the pattern of A cuts and no piece of B reaches across."""
        uncertain = {c for c in map(chr, range(128, 0x10000)) if not "\ud800" <= c <= "\udfff" and c.encode()[-1] in self.a.uncertain}
        letters = "".join(c for c in [*map(chr, range(48, 58)), *map(chr, range(65, 91)), *map(chr, range(97, 123)), *map(chr, range(0xC0, 0x250))] if c not in uncertain and c not in "×÷")
        reached = {p[1] for p in inside if p[0] in letters}
        marks = "".join(re.escape(c) for c in map(chr, range(33, 127)) if not c.isalnum() and c not in reached)
        space, odd = re.escape(spaces), "".join(sorted(uncertain)) + "\U00010000-\U0010ffff"
        if not space or not marks:
            return cut_before(spaces, self.a.uncertain)
        return f"[{space}]*+(?:[^{space}{letters}{odd}]++|[{odd}]++[{space}]*+|[{letters}]++(?![{marks}]))*+[{letters}]*+"

    def code(self, texts: list[str]) -> None:
        """B's ids of stretches, all at once."""
        given = [x[1:] if x[0] == " " else "\n" + x for x in texts]
        for x, ids in zip(texts, self.b.encode(given, num_threads=1), strict=True):
            if x == " ":  # the library gives nothing for no text, not even its blank
                ids = self.blank
            elif x[0] != " ":
                ids = ids[len(self.before) :] if self.before and ids[: len(self.before)] == self.before else None
            self.coded[x] = ids

    def unit(self, text: str) -> tuple[str, bytes] | bool:
        """Of a stretch: its groups written out; as 64-bit numbers how many tokens both sides have, how many groups, and its linked pairs with repeats. False where the tokens of one side do not give the text back."""
        if text not in self.coded:  # it was known a moment ago, but the cache has turned over since
            self.code([text])
        word = text[1:] if text[0] == " " else text
        a = self.a.word(text) if word.isalpha() and LATIN(word) else memoryview(self.a.chunk(text)).cast("I").tolist()
        b = self.coded.pop(text)
        if b is None or b"".join(map(self.data_b.__getitem__, b)) != text.encode():
            return False
        names = self.names
        listed = lambda ids: ",".join(map(names.__getitem__, ids))
        if len(a) == 1 == len(b):
            return f"{names[a[0]]}|{names[b[0]]}", array("q", (1, 1, 1, a[0] << SIDE | b[0])).tobytes()
        if len(a) == 1 or len(b) == 1:  # no end inside both
            return f"{listed(a)}|{listed(b)}", array("q", (len(a), len(b), 1, *linked_pairs(a, b, [], []))).tobytes()
        ends_a, ends_b = list(accumulate(map(self.size_a.__getitem__, a))), list(accumulate(map(self.size_b.__getitem__, b)))
        parts, pairs = [], []
        for i, j, k, m in groups(ends_a, ends_b):
            if j - i == 1 == m - k:
                parts.append(f"{names[a[i]]}|{names[b[k]]}")
                pairs.append(a[i] << SIDE | b[k])
            else:
                parts.append(f"{listed(a[i:j])}|{listed(b[k:m])}")
                pairs += linked_pairs(a[i:j], b[k:m], ends_a[i:j], ends_b[k:m])
        return ";".join(parts), array("q", (len(a), len(b), len(parts), *pairs)).tobytes()

    def align(self, text: str) -> tuple[str, int, int, int, bytes, bytes]:
        """(groups, n_a, n_b, n_groups, pairs, times): each linked pair once, ascending, and how often it is linked."""
        stretches = self.stretches(" " + text) if text else []
        if stretches and not stretches[-1]:  # the pattern also matches the end
            stretches.pop()
        counts = Counter(stretches)
        self.code([x for x in counts if x not in self.known and x not in self.known.old])
        units = {x: self.known[x] for x in counts}
        if not counts or not all(units.values()):
            return "", 0, 0, 0, b"", b""
        written_out, held = zip(*units.values(), strict=True)
        data, size = np.frombuffer(b"".join(held), np.int64), np.fromiter(map(len, held), np.int64, len(held)) // 8
        often, first = np.fromiter(counts.values(), np.int64, len(held)), np.cumsum(size) - size
        n_a, n_b, n_groups = (int(data[first + i] @ often) for i in range(3))
        linked = np.ones(len(data), bool)
        linked[np.concatenate([first, first + 1, first + 2])] = False
        pairs, place = np.unique(data[linked], return_inverse=True)
        times = np.bincount(place, np.repeat(often, size - 3), len(pairs)).astype(np.int64)
        text_of = dict(zip(units, written_out, strict=True))
        return ";".join(map(text_of.__getitem__, stretches)), n_a, n_b, n_groups, pairs.tobytes(), times.tobytes()


@lru_cache(maxsize=2)
def aligner(path_a: str, pattern_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, pattern_a, path_b)


NEW = T.StructType(
    [T.StructField("groups", T.StringType())]
    + [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups")]
    + [T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("block", T.LongType())]
)


def aligned(df: DataFrame, path_a: str, pattern_a: str, path_b: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row for each of df's: the columns in keep, groups (`a1,a2|b1;a3|b2`), n_a, n_b, n_groups, pairs, times, block.

    A encodes a blank and the text, B the text to which it adds the blank itself; strings of special tokens are plain text.
    A null or empty text, and one that a side's tokens don't give back byte for byte, has no tokens: no groups ('') and
    zeros. pairs (a << 32 | b, ascending) and times are binary, 64 bits each. Repeated rows count as so many
    documents. A very long text is cut like any other and is a block of its own. block numbers the documents that linked()
    looks at together; it is meant for a written table. An empty df gives no rows; columns not in keep are left out.
    """
    small_batches(df.sparkSession, 500)
    schema = T.StructType([df.schema[c] for c in keep] + list(NEW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, block, rows, size = aligner(path_a, pattern_a, path_b), TaskContext.get().partitionId() << 32, 0, 0
        for batch in batches:
            texts, blocks = batch.column(len(keep)).to_pylist(), []
            for x in texts:
                if rows == BLOCK_ROWS or rows and size + len(x) > BLOCK_BYTES:
                    block, rows, size = block + 1, 0, 0
                rows, size = rows + 1, size + len(x)
                blocks.append(block)
            columns = list(zip(*map(own.align, texts), strict=True)) or [()] * 6
            new = [pa.array(x, t) for x, t in zip([*columns, blocks], pa_types(NEW), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + new, names=schema.names)

    return df.select(*[f"`{c}`" for c in keep], text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def pa_types(schema: T.StructType) -> list[pa.DataType]:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    return [kinds[f.dataType.simpleString()] for f in schema]


def pair_counts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of aligned()'s written table: (block, pair) for each block's pairs, and (pair, n, best) over the corpus.

    n is the number of documents that hold the pair linked; best says that no pair of its A id has more.
    """
    small_batches(table.sparkSession, BLOCK_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column(0).to_numpy(zero_copy_only=False)
            held = [np.frombuffer(x, np.int64) for x in batch.column(1).to_pylist()]
            for b in np.unique(blocks):
                pairs, n = np.unique(np.concatenate([held[i] for i in np.flatnonzero(blocks == b)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), b)), pa.array(pairs), pa.array(n.astype(np.int64))], names=["block", "pair", "n"])

    held = written(table.where("n_a > 0").select("block", "pairs").mapInArrow(run, "block long, pair long, n long"), "pairs")
    counts = held.groupBy("pair").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.shiftright("pair", SIDE).alias("of")).agg(F.max("n").alias("most"))
    best = counts.join(most, F.shiftright("pair", SIDE) == F.col("of")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    return held.select("block", "pair"), best


def linked(table: DataFrame) -> DataFrame:
    """aligned()'s written table without pairs, times and block, with n_links, n_best, count_sum.

    n_links counts linked pairs of token occurrences, n_best those whose count of documents is the highest of their A id,
    ties included, count_sum is the sum of their counts. Documents without tokens have zeros.
    """
    held, counts = pair_counts(table)
    of_block = held.join(counts, "pair").select("block", "pair", "n", "best")
    kept = [c for c in table.columns if c not in ("pairs", "times", "block")]
    new = ("n_links", "n_best", "count_sum")
    schema = T.StructType([table.schema[c] for c in kept] + [T.StructField(c, T.LongType()) for c in new])

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        pairs = known.column("pair").to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, n, best = pairs[order], known.column("n").to_numpy()[order], known.column("best").to_numpy()[order].astype(np.int64)
        out: list[list[int]] = [[], [], []]
        for own, times in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
            at = np.searchsorted(pairs, np.frombuffer(own, np.int64))
            times = np.frombuffer(times, np.int64)
            for column, value in zip(out, (times.sum(), (times * best[at]).sum(), (times * n[at]).sum()), strict=True):
                column.append(int(value))
        return pa.Table.from_arrays([docs.column(c) for c in kept] + [pa.array(x, pa.int64()) for x in out], names=[*kept, *new])

    return table.groupBy("block").cogroup(of_block.groupBy("block")).applyInArrow(run, schema)
