"""Byte-level BPE as a monoid.

A stretch of text is a node: an unstable head, the ids of a stable middle, an unstable tail.
A place where white space follows something else is never inside a match of the splitting
pattern, so what lies between two such places is encoded alike in any context. Joining two
nodes encodes again only the window left.tail + right.head; a stretch with no such place stays
open and its window grows with the next join. A single match that is very long is encoded in
halves, too: two encodings join when every pair of neighbouring tokens across the window's
edges is one that encoding the pair's bytes gives back; otherwise the window grows.
Decoding halves the ids likewise and concatenates the leaves' bytes up the tree.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import WHITE, Memo, small_batches, text_or_empty

CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LEAF_CHARS = 4096
LEAF_BYTES = 48
LEAF_IDS = 4096
#: For each of two generations of chunks and of matches, in each Python worker.
CACHE_ENTRIES = 300_000


class Codec:
    """The ranks of a byte-level vocabulary, with encoding and decoding by tree reduction."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.matches = ranks, regex.compile(pattern).findall
        self.table = {i: b for b, i in ranks.items()}
        self.cache, self.known = Memo(self.chunk, CACHE_ENTRIES), Memo(self.match_ids, CACHE_ENTRIES)

    def merge(self, data: bytes) -> list[int]:
        """The plain merge loop: always the lowest rank, leftmost first."""
        ranks = self.ranks
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_long(self, data: bytes) -> list[int]:
        """The same merges for a wide window: a heap of the pairs that can merge, over a linked list."""
        ranks, n = self.ranks, len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, size = heappop(heap)
            j = after[i]
            if not alive[i] or j >= n or len(part[i]) + len(part[j]) != size:
                continue
            part[i] += part[j]
            alive[j] = False
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(part[i] + part[k])) is not None:
                    heappush(heap, (r, i, len(part[i]) + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + part[i])) is not None:
                heappush(heap, (r, h, len(part[h]) + len(part[i])))
        return [ranks[p] for p, a in zip(part, alive, strict=True) if a]

    def _data(self, ids: list[int]) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))

    def _holds(self, left: int, right: int) -> bool:
        return self.merge(self.table[left] + self.table[right]) == [left, right]

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two encodings' bytes together, by a window that grows until its edges hold."""
        if not left or not right:
            return left or right
        k = 2
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            data = self._data(left[i:] + right[:j])
            window = self.merge(data) if len(data) <= 4 * LEAF_BYTES else self.merge_long(data)
            if (i == 0 or window[0] == left[i] or self._holds(left[i - 1], window[0])) and (j == len(right) or window[-1] == right[j - 1] or self._holds(window[-1], right[j])):
                return left[:i] + window + right[j:]
            k *= 2

    def bytes_ids(self, data: bytes) -> list[int]:
        if len(data) <= LEAF_BYTES:
            return self.merge(data)
        cut = len(data) // 2
        return self.joined(self.bytes_ids(data[:cut]), self.bytes_ids(data[cut:]))

    def match_ids(self, match: str) -> bytes:
        """A match that is a token is that token, else its bytes are merged."""
        data = match.encode()
        rank = self.ranks.get(data)
        return array("I", [rank] if rank is not None else self.bytes_ids(data)).tobytes()

    def chunk(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.matches(text)))

    def chunks(self, parts: list[str]) -> bytes:
        return b"".join(map(self.cache.__getitem__, parts))

    # A node is (head, middle, tail), or (head, None, "") while it has no stable place.
    def node(self, text: str) -> tuple:
        parts = CHUNK.findall(text)
        if len(parts) < 2:
            return text, None, ""
        return parts[0], self.chunks(parts[1:-1]), parts[-1]

    def join(self, a: tuple, b: tuple) -> tuple:
        if a[1] is None and b[1] is None:
            return self.node(a[0] + b[0])
        parts = CHUNK.findall((a[0] if a[1] is None else a[2]) + b[0])
        if a[1] is None:
            return (parts[0], self.chunks(parts[1:]) + b[1], b[2]) if parts else b
        if b[1] is None:
            return (a[0], a[1] + self.chunks(parts[:-1]), parts[-1]) if parts else a
        return a[0], a[1] + self.chunks(parts) + b[1], b[2]

    def tree(self, text: str) -> tuple:
        if len(text) <= LEAF_CHARS:
            return self.node(text)
        cut = len(text) // 2
        return self.join(self.tree(text[:cut]), self.tree(text[cut:]))

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        head, middle, tail = self.tree(text)
        if middle is None:
            return self.chunk(head) if head else b""
        return self.chunk(head) + middle + self.chunk(tail)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of ids that encode() gave."""
        return self.decoded(memoryview(ids).cast("I"))

    def decoded(self, ids: memoryview) -> bytes:
        """A leaf's tokens joined, or what both halves give, one after the other."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.table.__getitem__, ids))
        cut = len(ids) // 2
        return self.decoded(ids[:cut]) + self.decoded(ids[cut:])


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return Codec(ranks, pattern)


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """df without its text column, with ids (binary: little-endian unsigned 32-bit) and, if named, the decoded bytes.

    Null and empty texts have empty ids. Every row gives one row, whatever its other columns
    hold; a column of df that is named like a new one is replaced.
    """
    small_batches(df.sparkSession, 500)
    rest = [c for c in df.columns if c not in (text, ids, decoded)]
    given = df.select(*[f"`{c}`" for c in rest], text_or_empty(text).alias("__text"))
    new = [ids, *([decoded] if decoded else [])]
    schema = T.StructType([*[df.schema[c] for c in rest], *[T.StructField(c, T.BinaryType()) for c in new]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            coded = [own.encode(x) for x in batch.column(len(rest)).to_pylist()]
            out = [pa.array(coded, pa.binary())] + ([pa.array([own.decode(x) for x in coded], pa.binary())] if decoded else [])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(rest))] + out, names=rest + new)

    return given.mapInArrow(run, schema)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for; null ids stand for none."""
    small_batches(df.sparkSession, 500)
    rest = [c for c in df.columns if c != decoded]
    schema = T.StructType([*[df.schema[c] for c in rest], T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_path, pattern)
        for batch in batches:
            out = pa.array([own.decode(x or b"") for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=rest + [decoded])

    return df.select(*[f"`{c}`" for c in rest]).mapInArrow(run, schema)
