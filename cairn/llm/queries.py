"""The queries of this package: name -> function of (spark, sf_dir), and DuckDB's SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import quality_rules, url_lists


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by tree reduction, and their decoding, as digests; null texts are empty."""
    import public_tokenizers

    from cairn.llm.bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and both verdicts of every document; null texts have no words."""
    from cairn.llm.common import written
    from cairn.llm.quality_rules import BASE, judge, measured

    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return judge(written(measured(docs), "measured")).select("doc_id", *BASE, "base_failed", "kept")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page; null and empty pages have none."""
    from cairn.llm.html_text import extract

    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts in every document: coverage and span of each."""
    from cairn.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edit with the next one's beginning, and near fingerprints of every twentieth id."""
    from cairn.llm.common import written
    from cairn.llm.fingerprints import with_next, within

    prints = written(with_next(_table(spark, sf_dir, "documents").select("doc_id", "text")), "prints")
    as_long = F.expr("shiftleft(bigint(conv(left(fingerprint, 8), 16, 10)), 32) | bigint(conv(right(fingerprint, 8), 16, 10))")
    known = prints.withColumn("fp", as_long)
    # The searches: every row whose id is divisible by 20, against all rows.
    near = within(known.where("doc_id % 20 = 0"), known, radius=3).groupBy("query").agg(F.count(F.lit(1)).alias("found"))
    joined = known.join(near.hint("merge"), F.col("fp") == F.col("query"), "left")
    return joined.select(*prints.columns, F.when(F.expr("doc_id % 20 = 0"), F.coalesce("found", F.lit(0))).alias("n_within_3_bits"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights, Gumbel keys and verdicts of every document."""
    from cairn.llm.importance import resample

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return resample(docs, _table(spark, sf_dir, "labels")).select("doc_id", "n_grams", "log_weight", "per_gram", "gumbel_key", "kept")


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the list entries that were active at its capture."""
    pages = _table(spark, sf_dir, "pages")
    captures = spark.sql(url_lists.CAPTURES.replace("FROM pages", "FROM {pages}"), pages=pages)
    entries = spark.sql(url_lists.ENTRIES.replace("FROM pages", "FROM {pages}"), pages=pages)
    return url_lists.judged(captures, entries).select("page_id", "url", "blocked", "rule", "since")


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document; fingerprints link at two bits."""
    from cairn.llm.common import written
    from cairn.llm.simhash_dedup import dedup, fingerprints

    prints = written(fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text")), "fingerprints")
    groups = dedup(prints, distance=2)
    return prints.join(groups, "fingerprint").select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of the spans of personal data in every document."""
    from cairn.llm import pii
    from cairn.llm.common import written

    table = written(pii.found(_table(spark, sf_dir, "documents").select("doc_id", "text")), "candidates")
    of = lambda k: F.size(F.filter("base", lambda c: c.kind == k)).cast("long").alias(f"n_{list(pii.BASE)[k]}")
    return pii.spans(table).select("doc_id", *[of(k) for k in range(len(pii.BASE))], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences."""
    import public_tokenizers

    from cairn.llm.packing import packed

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packed(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers' tokens in every document, with the links' counts over all documents."""
    import public_tokenizers

    from cairn.llm.alignment import aligned, linked
    from cairn.llm.common import written

    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = aligned(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") == 0, F.lit("")).otherwise(F.sha2("groups", 256))
    table = written(found.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return linked(table).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12_forced_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document by certain cuts, and their decoding, as digests."""
    import public_tokenizers

    from cairn.llm.forced_bpe import encode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, decoded="decoded")
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole vector on the 32 first principal components, with unit variances."""
    from cairn.llm.whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"), "embedding", keep=("vec_id",), components=32)


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_html_text": op3_html_text,
    "op4_licenses": op4_licenses,
    "op5_fingerprints": op5_fingerprints,
    "op6_importance": op6_importance,
    "op7_url_lists": op7_url_lists,
    "op8_simhash_dedup": op8_simhash_dedup,
    "op9_pii": op9_pii,
    "op10_packing": op10_packing,
    "op11_alignment": op11_alignment,
    "op12_forced_bpe": op12_forced_bpe,
    "op13_whitening": op13_whitening,
}
ORACLE: dict[str, str] = {"op2_quality_rules": quality_rules.ORACLE, "op7_url_lists": url_lists.ORACLE}
