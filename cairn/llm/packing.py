"""Packing documents into fixed-length sequences by patterns of a few lengths.

Token counts become a histogram of piece lengths, which is never longer than a sequence.
Patterns of up to three lengths that fill a sequence are enumerated from the lengths that
occur, non-negative least squares fits how often to repeat each, the counts are rounded to
what the histogram holds, and what is left is packed best-fit decreasing, again by length and
count. All of that works on at most `limit` numbers on the driver, however many documents
there are. Pieces then get a rank among those of their length, in Spark, and the plan says in
which sequence and at which offset the r-th piece of a length stands.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty, written

#: For each of two generations of words and of matches, in each Python worker.
CACHE_ENTRIES = 200_000
LATIN = re.compile("[\x20-&(-~À-ɏ]*\\Z").match
MATCH = re.compile(r"[^\W\d_]+|\d|[\W_]+").findall
#: Byte-level vocabularies write a byte as a printable character: itself, or the next one from 256 on for the others.
PRINTED = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
AS_PRINTED = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
PIECE = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])


class WordIds:
    """Ids of a text by a tokenizer that drops white space: what blanks and line ends part is encoded alone, once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.content}
        self.added = {content: array("I", [i]).tobytes() for content, i in added.items()}
        self.parts = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else lambda text: [text]
        self.model = self.tokenizer.model
        self.words, self.matches = Memo(self.word, CACHE_ENTRIES), Memo(self.match, CACHE_ENTRIES)

    def match(self, text: str) -> bytes:
        """Ids of what the tokenizer's pattern takes as one match."""
        return array("I", [t.id for t in self.model.tokenize(text.encode().decode("latin-1").translate(AS_PRINTED))]).tobytes()

    def word(self, text: str) -> bytes:
        if text.isascii() and text.isalpha():
            return self.matches[text.lower()]
        # Plain Latin text without apostrophes falls into letters, single digits and the rest.
        if LATIN(text):
            return b"".join(map(self.matches.__getitem__, MATCH(unicodedata.normalize("NFC", text).lower())))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text; the strings of the vocabulary's added tokens are these tokens, as they are for the library."""
        if not any(x in text for x in self.added):
            return self.plain(text)
        return b"".join([self.added[x] if k % 2 else self.plain(x) for k, x in enumerate(self.parts(text))])

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, tokenizer_path: str, limit: int = 2048, end_id: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True) -> DataFrame:
    """A row for each piece of at most `limit` ids: the columns in keep, piece, start, length, ids_crc32, ids.

    A document is its ids and then end_id, so an empty or null text is one piece of one id.
    Only a document longer than limit is cut, into pieces of limit and a shorter last one.
    ids (binary, little-endian unsigned 32-bit) is left out without with_ids.
    """
    small_batches(df.sparkSession, 500)
    fields = [f for f in PIECE if with_ids or f.name != "ids"]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    end = array("I", [end_id]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = word_ids(tokenizer_path)
        for batch in batches:
            rows, out = [], ([], [], [], [], [])
            for row, x in enumerate(batch.column(len(keep)).to_pylist()):
                ids = own.encode(x) + end
                for k, at in enumerate(range(0, len(ids), 4 * limit)):
                    part = ids[at : at + 4 * limit]
                    rows.append(row)
                    for column, value in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part), part), strict=True):
                        column.append(value)
            taken = pa.array(rows, pa.int64())
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            given = [batch.column(i).take(taken) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays(given + [pa.array(x, t) for x, t in zip(out, kinds, strict=True)][: len(fields)], names=[f.name for f in schema])

    return df.select(*[f"`{c}`" for c in keep], text_or_empty(text).alias("__text")).mapInArrow(run, schema)


def patterns(counts: np.ndarray, limit: int) -> list[tuple[int, ...]]:
    """Patterns of one to three of the lengths that occur, each closed by the largest length that still fits.

    counts[n] is the number of pieces of length n. For three, the first two are the lengths themselves
    with a step that keeps the number of patterns near 16 for each length.
    """
    have = np.flatnonzero(counts)
    fits = np.zeros(limit + 1, int)  # the largest length that occurs and is not longer
    fits[have] = have
    fits = np.maximum.accumulate(fits)
    found = {(int(n),) for n in have if n == limit}
    for a in have[::-1]:
        if a < limit and (b := int(fits[limit - a])):
            found.add(tuple(sorted((int(a), b), reverse=True)))
        seconds = have[have <= min(a, limit - a - 1)]
        for b in seconds[:: max(1, len(seconds) // 16)]:
            if c := int(fits[limit - a - b]):
                found.add(tuple(sorted((int(a), int(b), c), reverse=True)))
    return sorted(found, reverse=True)


def nnls(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, weight: np.ndarray, width: int, rounds: int = 400) -> np.ndarray:
    """min |W(Ax - target)| over x >= 0 for a sparse A, by accelerated projected gradient."""
    a = values * weight[rows]
    b = target * weight
    times = lambda x: np.bincount(rows, a * x[cols], len(target))
    back = lambda y: np.bincount(cols, a * y[rows], width)
    v = np.ones(width)
    for _ in range(20):  # the largest eigenvalue, for the step
        v = back(times(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / (1.05 * np.linalg.norm(back(times(v))) or 1)
    x = z = np.zeros(width)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, z - step * back(times(z) - b))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        z, x, t = new + (t - 1) / t_new * (new - x), new, t_new
    return x


def plan(counts: np.ndarray, limit: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram once."""
    left = counts.astype(np.int64).copy()
    out: list[tuple[tuple[int, ...], int]] = []
    found = patterns(left, limit)
    if found:
        rows = np.array([n for p in found for n in p])
        cols = np.repeat(np.arange(len(found)), [len(p) for p in found])
        fit = nnls(rows, cols, np.ones(len(rows)), left.astype(float), np.sqrt(np.arange(limit + 1) / limit), len(found))
        full = np.array([sum(p) == limit for p in found])
        for i in np.lexsort((-fit, ~full)):  # those without waste first
            if fit[i] < 0.5 or not full[i] and sum(found[i]) < limit - 4:
                continue
            most = min(int(left[n]) // found[i].count(n) for n in set(found[i]))
            if repeats := min(int(round(fit[i])), most):
                for n in found[i]:
                    left[n] -= repeats
                out.append((found[i], repeats))
    while left.any():  # the rest: the longest, then always the longest that still fits
        have = np.flatnonzero(left)
        pattern, room = [], limit
        while room > 0:
            fitting = have[: np.searchsorted(have, room, side="right")]
            n = next((int(n) for n in fitting[::-1] if left[n] > pattern.count(int(n))), None)
            if n is None:
                break
            pattern.append(n)
            room -= n
        repeats = min(int(left[n]) // pattern.count(n) for n in set(pattern))
        for n in pattern:
            left[n] -= repeats
        out.append((tuple(pattern), repeats))
    return out


def slots(planned: list[tuple[tuple[int, ...], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """For each length: (first rank, repeats, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for lengths, repeats in planned:
        offset = 0
        for n in lengths:
            out.setdefault(n, []).append((used.get(n, 0), repeats, sequence, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        sequence += repeats
    return out


def pack(df: DataFrame, limit: int = 2048, length: str = "length", key: tuple[str, ...] = ("doc_id", "piece"), chunk_rows: int = 4_000) -> DataFrame:
    """df with sequence_id and offset: every row has a place of its own in a sequence of at most `limit`.

    df is read twice, so it should be a written table. length holds 1 to limit. Ranks are
    taken within chunks of the rows of a length, so that one very common length is no single task:
    a chunk's first rank is the number of rows in the chunks before it. An empty df gives no rows.
    """
    spark = df.sparkSession
    counted = {r[0]: r[1] for r in df.groupBy(length).count().collect()}  # at most `limit` rows
    counts = np.zeros(limit + 1, np.int64)
    for n, c in counted.items():
        counts[n] = c
    total = int(counts.sum())
    schema = "`__n` long, `__slots` array<struct<rank: long, repeats: long, sequence: long, offset: long>>"
    where = spark.createDataFrame([(n, x) for n, x in slots(plan(counts, limit)).items()], schema)
    chunks = max(1, -(-total // chunk_rows))
    salted = df.withColumn("__chunk", F.pmod(F.xxhash64(*key), F.lit(chunks)))
    sizes = salted.groupBy(length, "__chunk").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(length).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    firsts = sizes.select(F.col(length).alias("__of"), F.col("__chunk").alias("__in"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy(length, "__chunk").orderBy(*key)
    ranked = salted.withColumn("__row", F.row_number().over(within) - 1).join(firsts, (F.col(length) == F.col("__of")) & (F.col("__chunk") == F.col("__in"))).withColumn("__rank", F.col("__row") + F.col("__first"))
    placed = ranked.join(F.broadcast(where), F.col(length) == F.col("__n")).withColumn("__slot", F.expr("element_at(filter(`__slots`, s -> s.rank <= `__rank` AND `__rank` < s.rank + s.repeats), 1)"))
    return placed.select(*[F.col(c) for c in df.columns], (F.col("__slot.sequence") + F.col("__rank") - F.col("__slot.rank")).alias("sequence_id"), F.col("__slot.offset").alias("offset"))


def packed(df: DataFrame, tokenizer_path: str, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """Pieces of the documents with their places: pieces() in a written table, then pack()."""
    cut = written(pieces(df, tokenizer_path, limit, keep=keep, with_ids=with_ids), "pieces")
    return pack(cut, limit, key=(*keep, "piece"))
