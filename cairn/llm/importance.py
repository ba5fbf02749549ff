"""Quality classifier by importance resampling.

Two generative models of hashed word unigrams and bigrams are counted: one on target text (rows labelled
good), one on all rows. A document's log weight is that of the ratio of its probability under
the two; so that length alone decides nothing, it is taken for each n-gram and then for a passage of
PASSAGE n-grams, which is the temperature: the importance weight of a document is that of a passage of its kind. Gumbel noise on these
makes the k largest keys a sample without replacement in proportion to the weights, so noise decides where weights lie close
to each other and no longer where a passage tells target from raw text. k may be given; else it is the
number of documents whose weight lies above a cut that parts the labelled rows best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import Memo, small_batches, text_or_empty, written

BUCKETS = 1 << 16
#: At most about so many labelled rows are used, chosen by a hash of their ids; they are broadcast.
MOST_LABELLED = 200_000
SMOOTHING = 1.0
SEED = 20_240_101
#: Cuts are tried at steps of so much weight per n-gram, and the largest share of good rows that a cut may lose.
STEP = 0.005
MOST_LOST = 0.001
#: N-grams of the passage that a weight stands for; fewer leave more to noise.
PASSAGE = 16


class Grams:
    """Buckets of a text's words and neighbouring words."""

    def __init__(self) -> None:
        import xxhash

        self.hashes = Memo(lambda w: xxhash.xxh64_intdigest(w), 200_000)

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        own = np.fromiter(map(self.hashes.__getitem__, words), np.uint64, len(words))
        pairs = own[:-1] * np.uint64(0x9E3779B97F4A7C15) + own[1:]
        return (np.concatenate([own, pairs ^ (pairs >> np.uint64(29))]) % np.uint64(BUCKETS)).astype(np.int64)


def labelled(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, good) of about `most` labelled rows at most; null labels and ids are left out, the best of several labels counts."""
    usable = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    n = usable.count()
    if n > most:
        usable = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * most / n))
    return usable.groupBy("doc_id").agg((F.max("quality") >= 1).alias("good"))


def models(df: DataFrame, labels: DataFrame, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Counts of the buckets in the target rows and in all rows: two vectors, summed in tasks and then by Spark."""
    small_batches(df.sparkSession, 1000)
    known = F.broadcast(labelled(labels).where("good").select(F.col("doc_id").alias("__id"), F.lit(1).alias("__good")))
    given = df.join(known, F.col("doc_id") == F.col("__id"), "left").select(text_or_empty(text).alias("t"), (F.col("__good") == 1).alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, counts = Grams(), np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            texts, good = batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist()
            for some, side in ((texts, 1), ([t for t, g in zip(texts, good, strict=True) if g], 0)):
                for at in range(0, len(some), 64):
                    counts[side] += np.bincount(np.concatenate([grams(t) for t in some[at : at + 64]]), minlength=BUCKETS)
        some = np.flatnonzero(counts[1])
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[0][some]), pa.array(counts[1][some])], names=["bucket", "target", "raw"])

    sums = given.mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target"), F.sum("raw")).collect()  # BUCKETS rows at most
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, a, b in sums:
        target[bucket], raw[bucket] = a, b
    return target, raw


def log_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of target over raw probability for every bucket, both smoothed towards the raw model."""
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    own = (target + SMOOTHING * BUCKETS * share) / (target.sum() + SMOOTHING * BUCKETS)
    return np.log(own / share)


def shrunk_ratio(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log of found over expected target counts for every bucket, SMOOTHING added to both: where raw text would have few in so much target, the bucket tells little, and nothing where raw has none."""
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    return np.log((target + SMOOTHING) / (share * target.sum() + SMOOTHING))


def weighed(df: DataFrame, ratio: np.ndarray, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with n_grams, log_weight and per_gram, which is log_weight over n_grams, or 0 without any."""
    new = ["n_grams", "log_weight", "per_gram"]
    rest = [c for c in df.columns if c not in (*new, "gumbel_key", "kept") and (keep_text or c != text)]
    schema = T.StructType([df.schema[c] for c in rest] + [T.StructField("n_grams", T.LongType()), T.StructField("log_weight", T.DoubleType()), T.StructField("per_gram", T.DoubleType())])
    ratio = ratio.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams()
        for batch in batches:
            found = [grams(x or b"") for x in batch.column(text).cast(pa.binary()).to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            weight = np.array([float(ratio[x].sum()) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in rest] + [pa.array(n), pa.array(weight), pa.array(weight / np.maximum(n, 1))], names=rest + new)

    small_batches(df.sparkSession, 1000)
    return df.select(*[f"`{c}`" for c in rest], *([] if keep_text else [text])).mapInArrow(run, schema)


def cut(table: DataFrame, labels: DataFrame) -> float:
    """The weight per n-gram that parts good from other labelled rows best, and loses few of the good ones."""
    known = F.broadcast(labelled(labels).withColumnRenamed("doc_id", "__id"))
    step = F.floor(F.col("per_gram") / STEP).cast("long").alias("step")
    counts = table.join(known, F.col("doc_id") == F.col("__id")).groupBy(step).agg(F.count_if("good"), F.count_if(~F.col("good"))).collect()
    if not any(b for _, _, b in counts) or not any(g for _, g, _ in counts):
        return -float("inf")
    good, other = sum(g for _, g, _ in counts), sum(b for _, _, b in counts)
    best, at, lost, dropped = -1.0, -float("inf"), 0, 0
    for step, g, b in sorted(counts):
        if lost <= MOST_LOST * good and (score := dropped / other - lost / good) > best:
            best, at = score, step * STEP
        lost, dropped = lost + g, dropped + b
    return at


def kth_key(table: DataFrame, k: int, column: str = "gumbel_key", bits: int = 16) -> float | None:
    """The k-th largest value, exactly: a few counts of 2^16 buckets at most, each within the bucket found before."""
    if k <= 0:
        return None
    ranges = table.agg(F.min(column), F.max(column)).first()
    low, high, left = ranges[0], ranges[1], k
    if low is None:
        return None
    for _ in range(8):
        width = (high - low) / (1 << bits)
        if width <= 0 or low + width == low:
            break
        inside = table.where((F.col(column) >= low) & (F.col(column) <= high))
        place = F.least(F.floor((F.col(column) - low) / width), F.lit((1 << bits) - 1)).cast("long").alias("b")
        stats = sorted(inside.groupBy(place).agg(F.count(F.lit(1)), F.min(column), F.max(column)).collect(), reverse=True)
        for _, n, least, most in stats:
            if left <= n:
                low, high = least, most
                break
            left -= n
        else:
            return ranges[0]
        if low == high:
            break
    return low


def sampled(table: DataFrame, labels: DataFrame, seed: int = SEED, passage: int = PASSAGE, k: int | None = None, judged: DataFrame | None = None) -> DataFrame:
    """A written table of weighed() rows with gumbel_key and kept: whether a row is among the k largest keys.

    The key is per_gram times passage, with noise that doc_id and seed fix.
    Texts without words carry no evidence and keep their weight of 0. Repeated rows have equal
    keys and stay or go together; ties with the k-th key stay. Without k it is the number of rows above the cut that parts the labelled rows of judged
    (a weighed() table, the rows themselves if not given) best; without labels of both kinds all rows are kept. An empty table gives no rows.
    """
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    table = table.withColumn("gumbel_key", F.col("per_gram") * float(passage) - F.log(-F.log(uniform)))
    if k is None:
        at = cut(table if judged is None else judged, labels)
        if at == -float("inf"):
            return table.withColumn("kept", F.lit(True))
        k = table.where(F.col("per_gram") >= at).count()
    least = kth_key(table, k)
    return table.withColumn("kept", F.lit(False) if least is None else F.col("gumbel_key") >= F.lit(least))


def resample(df: DataFrame, labels: DataFrame, text: str = "text", keep_text: bool = False, seed: int = SEED, passage: int = PASSAGE, k: int | None = None, raw: DataFrame | None = None) -> DataFrame:
    """df with its weights, keys and verdicts; see sampled(). The weighed rows are a written table.

    raw (doc_id and text) is the text that df was chosen from, df itself if not given: the models are counted on it, and the cut is found on its labelled
    rows. So rows that an earlier filter has taken out still show what is to go. Of raw's labelled rows one half, by a hash of their ids, is the target, and the
    cut is found on the other half: a row weighs more where it is in the target itself, so a cut among these would take clean rows without a label for worse.
    Half of the labelled rows know few words, so a word that they don't have is no sign against a text; see shrunk_ratio().
    """
    if raw is None:
        return sampled(written(weighed(df, log_ratio(*models(df, labels, text)), text, keep_text), "weighed"), labels, seed, passage, k)
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(2))
    ratio = shrunk_ratio(*models(raw, labels.where(half == 0), text))
    held = labels.where(half == 1)
    known = F.broadcast(labelled(held).select(F.col("doc_id").alias("__id")))  # MOST_LABELLED rows, about
    judged = written(weighed(raw.join(known, F.col("doc_id") == F.col("__id"), "left_semi").select("doc_id", text), ratio, text), "judged")
    return sampled(written(weighed(df, ratio, text, keep_text), "weighed"), held, seed, passage, k, judged)
