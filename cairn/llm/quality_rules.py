"""Quality rules whose thresholds follow the corpus.

Each text's base counts become rates in whole numbers. For every language and source the rates
and sizes of the texts that pass the base rules go into a sketch: counts in buckets whose width is a sixteenth of their power of two, so a
quantile is off by a sixteenth at most and two sketches merge by adding counts. The sketches of a
language's sources, merged, give the language's quantiles; a group's own quantiles are drawn towards
them as if it had some more texts of its language, so a small group follows its language and a large
one itself. A text is rejected where a rate lies further above its group's upper quantile than a
multiple of the distance from the median to that quantile, and than a few occurrences make in a text of the group's median
size. No limit is a constant: each follows from the group's own quantiles. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import text_or_empty, written

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ!"
WHITE = " \t\n\x0b\x0c\r"
#: Rate -> (occurrences that a text of median size may have beyond the spread, what one adds, the size that it is counted against).
RATES = {
    "symbols": (6, 10_000, "word_chars"),
    "dup_lines": (2, 10_000, "n_lines"),
    "repeats": (6, 50_000, "n_words"),
    "shouts": (6, 10_000, "word_chars"),
    "word_length": (6, 100, "n_words"),
    "short_words": (6, 100, "n_words"),
}
#: What else is sketched: the sizes of texts, for their medians.
SIZES = ("word_chars", "n_lines", "n_words")
#: The upper quantile, in tenths, and how often its distance from the median may lie above it.
UPPER = 8
SPREAD = 8
#: So many texts of its language does a group count besides its own.
PRIOR = 100
MOST_BROADCAST = 100_000


def count_of(chars: str, text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def measured(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """df with the base counts and the rates (whole numbers: per ten thousand; word_length in hundredths; then the sizes)."""
    own = [*BASE, "n_lines", "rates", "base_failed", "kept", "rejected_by"]
    rest = [c for c in df.columns if c not in own and c != text]
    x = F.col("__text")
    out = df.select(*[f"`{c}`" for c in rest], text_or_empty(text).alias("__text"))
    out = out.withColumn("__words", F.filter(F.split(x, r"[\x20\x09-\x0D]+", -1), lambda w: w != ""))
    out = out.withColumn("__lines", F.filter(F.split(x, "\n", -1), lambda w: F.translate(w, WHITE, "") != ""))
    out = out.withColumn(
        "__windows",
        F.expr("CASE WHEN size(`__words`) >= 5 THEN transform(sequence(0, size(`__words`) - 5), i -> xxhash64(`__words`[i], `__words`[i + 1], `__words`[i + 2], `__words`[i + 3], `__words`[i + 4])) ELSE array() END"),
    )
    out = out.select(
        *[f"`{c}`" for c in rest],
        x,
        F.size("__words").cast("long").alias("n_words"),
        F.length(F.translate(x, WHITE, "")).cast("long").alias("word_chars"),
        count_of(SYMBOLS, x).alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.size("__lines").cast("long").alias("n_lines"),
        count_of(CAPITALS, x).alias("__shouts"),
        # Texts that repeat a window sort their windows; the others need no more than the distinct count.
        F.expr("CASE WHEN size(array_distinct(`__windows`)) < size(`__windows`) THEN array_sort(transform(`__windows`, (h, i) -> struct(h, i))) END").alias("__sorted"),
    )
    out = out.withColumn(
        "__at",
        F.expr("array_sort(transform(filter(`__sorted`, (x, i) -> (i > 0 AND `__sorted`[i - 1].h = x.h) OR (i < size(`__sorted`) - 1 AND `__sorted`[i + 1].h = x.h)), x -> x.i))"),
    )
    covered = F.expr("coalesce(aggregate(`__at`, struct(0L AS past, 0L AS n), (a, p) -> struct(p + 5L AS past, a.n + p + 5L - greatest(a.past, cast(p AS BIGINT)) AS n), a -> a.n), 0L)")
    out = out.withColumn("n_repeat_words", covered)
    per = lambda n, d, by=10_000: F.when(F.col(d) > 0, F.expr(f"`{n}` * {by} div `{d}`")).otherwise(F.lit(0).cast("long"))
    rates = F.array(per("n_symbols", "word_chars"), per("n_dup_lines", "n_lines"), per("n_repeat_words", "n_words"), per("__shouts", "word_chars"), per("word_chars", "n_words", 100), per("n_words", "word_chars"), *[F.col(c) for c in SIZES])
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return out.select(*[f"`{c}`" for c in rest], *([x.alias(text)] if keep_text else []), *BASE, rates.alias("rates"), failed.alias("base_failed"))


def bucket(value: str) -> Column:
    """The lower end of a value's bucket: all but its five leading binary digits are zero."""
    low = f"greatest(length(bin(`{value}`)) - 5, 0)"
    return F.expr(f"shiftleft(shiftright(`{value}`, {low}), {low})")


def sketches(df: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, rate, bucket, n): the sketch of every rate and size in every group, of the texts that pass the base rules."""
    each = df.where("NOT base_failed").select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.posexplode("rates").alias("rate", "value"))
    return each.groupBy("lang", "source", "rate", bucket("value").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def limits(sketch: DataFrame, spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """(lang, source, limits): the largest value of each rate that a text of the group may have."""
    end = F.expr("bucket + shiftleft(1L, greatest(length(bin(bucket)) - 5, 0)) - 1")

    def quantiles(counts: DataFrame, *by: str) -> DataFrame:
        group = Window.partitionBy(*by)
        ordered = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        run = counts.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(group))
        at = lambda tenths, value: F.min(F.when(F.col("upto") * 10 >= F.col("all") * tenths, value))
        return run.groupBy(*by).agg(at(5, F.col("bucket")).alias("middle"), at(UPPER, end).alias("upper"), F.max("all").alias("texts"))

    own = quantiles(sketch, "lang", "source", "rate")
    merged = quantiles(sketch.groupBy("lang", "rate", "bucket").agg(F.sum("n").alias("n")), "lang", "rate")
    merged = merged.select(F.col("lang").alias("m_lang"), F.col("rate").alias("m_rate"), F.col("middle").alias("m_middle"), F.col("upper").alias("m_upper"))
    both = own.join(merged, F.col("lang").eqNullSafe(F.col("m_lang")) & (F.col("rate") == F.col("m_rate")))
    drawn = lambda q: F.expr(f"(texts * `{q}` + {prior} * `m_{q}`) div (texts + {prior})")
    at = lambda name, i: F.max(F.when(F.col("rate") == i, F.col(name)))
    wide = both.select("lang", "source", "rate", drawn("middle").alias("middle"), drawn("upper").alias("upper")).groupBy("lang", "source")
    wide = wide.agg(*[at(name, i).alias(f"{name}{i}") for i in range(len(RATES) + len(SIZES)) for name in ("middle", "upper")])
    tops = []
    for i, (some, adds, size) in enumerate(RATES.values()):
        median = f"greatest(middle{len(RATES) + SIZES.index(size)}, 1)"
        tops.append(F.expr(f"upper{i} + {spread} * (upper{i} - middle{i}) + {some * adds} div {median}"))
    return wide.select("lang", "source", F.array(*tops).alias("limits"))


def judge(table: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """A written table of measured() texts with kept, and rejected_by: the rates beyond their limits.

    Equal rows get equal verdicts. Null languages and sources are groups of their own. A text
    that fails the base rules is not kept; a group without any that passes has no limits. An empty table gives no rows.
    """
    tops = written(limits(sketches(table, lang, source)), "limits")
    tops = tops.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), F.col("limits").alias("__limits"))
    small = tops.count() <= MOST_BROADCAST
    joined = table.join(F.broadcast(tops) if small else tops.hint("merge"), F.col(lang).eqNullSafe(F.col("__lang")) & F.col(source).eqNullSafe(F.col("__source")), "left")
    names = F.array(*[F.lit(n) for n in RATES])
    beyond = F.filter(F.transform(names, lambda n, i: F.when(F.get("rates", i) > F.get("__limits", i), n)), lambda n: n.isNotNull())
    return joined.select(*[table[c] for c in table.columns], (~F.col("base_failed") & (F.size(beyond) == 0)).alias("kept"), beyond.alias("rejected_by"))


def _oracle_tops() -> str:
    tops = []
    for i, (some, adds, size) in enumerate(RATES.values()):
        tops.append(f"u{i} + {SPREAD} * (u{i} - m{i}) + {some * adds} // greatest(m{len(RATES) + SIZES.index(size)}, 1) AS t{i}")
    return ", ".join(tops)


ORACLE = """
WITH docs AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
windows AS (SELECT doc_id, i, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM words WHERE len(w) >= 5)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeats AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(0, 5) AS r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM docs),
counts AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z!]+', '', 'g')) AS shouts
  FROM docs d JOIN words USING (doc_id) JOIN lines USING (doc_id) LEFT JOIN repeats r USING (doc_id)),
rates AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols * 10000 // word_chars ELSE 0 END AS r0, CASE WHEN n_lines > 0 THEN n_dup_lines * 10000 // n_lines ELSE 0 END AS r1,
    CASE WHEN n_words > 0 THEN n_repeat_words * 10000 // n_words ELSE 0 END AS r2, CASE WHEN word_chars > 0 THEN shouts * 10000 // word_chars ELSE 0 END AS r3,
    CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END AS r4, CASE WHEN word_chars > 0 THEN n_words * 10000 // word_chars ELSE 0 END AS r5 FROM counts),
sketch AS (
  SELECT lang, source, rate, (v >> greatest(length(bin(v)) - 5, 0)) << greatest(length(bin(v)) - 5, 0) AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest(range(0, 9)) AS rate, unnest([r0, r1, r2, r3, r4, r5, word_chars, n_lines, n_words]) AS v FROM rates WHERE NOT base_failed) GROUP BY ALL),
run AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, rate) AS texts FROM sketch),
own AS (SELECT lang, source, rate, min(bucket) FILTER (upto * 10 >= texts * 5) AS middle, min(bucket + (1::BIGINT << greatest(length(bin(bucket)) - 5, 0)) - 1) FILTER (upto * 10 >= texts * 8) AS upper, max(texts) AS texts FROM run GROUP BY ALL),
merged AS (
  SELECT lang, rate, min(bucket) FILTER (upto * 10 >= texts * 5) AS middle, min(bucket + (1::BIGINT << greatest(length(bin(bucket)) - 5, 0)) - 1) FILTER (upto * 10 >= texts * 8) AS upper
  FROM (SELECT *, sum(n) OVER (PARTITION BY lang, rate ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, rate) AS texts FROM (SELECT lang, rate, bucket, sum(n) AS n FROM sketch GROUP BY ALL)) GROUP BY ALL),
drawn AS (
  SELECT o.lang, o.source, o.rate, ((o.texts * o.middle + 100 * m.middle) // (o.texts + 100))::BIGINT AS middle, ((o.texts * o.upper + 100 * m.upper) // (o.texts + 100))::BIGINT AS upper
  FROM own o JOIN merged m ON o.lang IS NOT DISTINCT FROM m.lang AND o.rate = m.rate),
wide AS (SELECT lang, source, """ + ", ".join(f"max(middle) FILTER (rate = {i}) AS m{i}, max(upper) FILTER (rate = {i}) AS u{i}" for i in range(9)) + """ FROM drawn GROUP BY ALL),
tops AS (SELECT lang, source, """ + _oracle_tops() + """ FROM wide)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(r0 <= t0 AND r1 <= t1 AND r2 <= t2 AND r3 <= t3 AND r4 <= t4 AND r5 <= t5, true) AS kept
FROM rates LEFT JOIN tops ON rates.lang IS NOT DISTINCT FROM tops.lang AND rates.source IS NOT DISTINCT FROM tops.source
"""
