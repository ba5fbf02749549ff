"""Documents to packed training sequences, in stages that each write a table and read it again."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import importance, packing, pii, quality_rules, simhash_near
from cairn.llm.common import noting, release, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE = 2048
#: The place of the last stage.
LAST = 4


#: Input folder and place of a stage -> the tables that the stage works with. A stage's result is written before the next one begins,
#: which then deletes them; what the last stage's result reads stays.
_held: dict[tuple[str, int], list[str]] = {}


def _stage(place: int) -> Callable:
    """A stage that first deletes what the stage before it has left for the same input, so that the disk holds the working tables of one stage."""

    def wrapped(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        @wraps(f)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            release(spark, _held.pop((sf_dir, place - 1), []))
            with noting() as paths:
                out = f(spark, docs, sf_dir)
            if place < LAST:
                _held.setdefault((sf_dir, place), []).extend(paths)
            return out

        return run_stage

    return wrapped


def _apart(docs: DataFrame, *named: str) -> DataFrame:
    """The text, the named columns under names of their own, and all columns but the text in one struct: no operator's column can clash."""
    rest = [f"`{c}`" for c in docs.columns if c != "text"]
    return docs.select("text", *named, F.struct(*rest).alias("__row"))


def _together(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*[F.col("text") if c == "text" else F.col("__row")[c].alias(c) for c in docs.columns])


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep (operator 2)."""
    table = written(quality_rules.measured(_apart(docs, "lang", "source"), keep_text=True), "measured")
    return _together(quality_rules.judge(table).where("kept"), docs)


@_stage(1)
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling keeps (operator 6), by the labels that come with the input.

    Raw text are all documents of the input: of those that the rules have left, few are labelled bad, and little could be learnt from them.
    """
    labels, raw = spark.read.parquet(f"{sf_dir}/labels.parquet"), spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _together(importance.resample(_apart(docs, "doc_id"), labels, keep_text=True, raw=raw).where("kept"), docs)


@_stage(2)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (operator 8): the one of the smallest doc_id, null last, or any of its repeated rows.

    Near are texts of which four fifths are alike: of their sets of five-word shingles by Jaccard similarity, or of their
    words, which then stand in five-word shingles that both have. See simhash_near for how candidates are found.
    """
    prints = simhash_near.prints(_apart(docs, "doc_id")).withColumn("__n", F.monotonically_increasing_id())
    table = written(prints.withColumn("__order", F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "__n")).drop("doc_id"), "prints")
    stay = simhash_near.near_rows(table, key="__order", row="__n")
    return _together(table.join(stay, "__n", "left_semi"), docs)


@_stage(3)
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by its kind (operator 9); n_chars follows where there is one."""
    table = written(pii.found(_apart(docs), keep_text=True), "candidates")
    rows = pii.spans(table).withColumn("text", pii.redacted())
    if "n_chars" in docs.columns:
        longer = F.col("__row").withField("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
        rows = rows.withColumn("__row", F.when(F.size("spans") > 0, longer).otherwise(F.col("__row")))
    return _together(rows, docs)


@_stage(4)
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids and their places in sequences (operator 10)."""
    return packing.packed(docs, TOKENIZER, SEQUENCE, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("quality_classifier", classifier),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]
#: Fingerprints, word hashes and tokenizers are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's result is deleted when the next one's is written; that of the last but one stays with the result.

    Further runs leave the rows of earlier ones as they are.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < LAST:
            with noting() as paths:
                docs = written(docs, name)
            release(spark, before)
            before = paths
    return docs
