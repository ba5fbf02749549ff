"""Histograms, entropy, profiles and summary statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import checkpointed, dealt
from cairn.session import small_batches

CHUNK = 1024


def byte_counts(objects: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """(by, byte, n): how often each byte value occurs, counted in Arrow batches and added up by Spark."""
    schema = ", ".join([f"{c} {objects.schema[c].dataType.simpleString()}" for c in by] + ["byte int", "n long"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            counts = [np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256) for x in batch[data]]
            table = np.stack(counts) if counts else np.zeros((0, 256), int)
            if not by:
                table = table.sum(axis=0, keepdims=True)
            row, byte = np.nonzero(table)
            yield batch[by].iloc[row].assign(byte=byte.astype("int32"), n=table[row, byte]) if by else pd.DataFrame({"byte": byte.astype("int32"), "n": table[row, byte]})

    small_batches(objects.sparkSession)
    return objects.select(*by, data).mapInPandas(run, schema).groupBy(*by, "byte").agg(F.sum("n").alias("n"))


def byte_counts_native(objects: DataFrame, by: list[str], data: str = "data") -> DataFrame:
    """The same without Python: pairs of hexadecimal digits of each content."""
    byte = F.explode(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)))
    each = objects.where(F.length(data) > 0).select(*by, byte.alias("h"))
    return each.groupBy(*by, F.conv("h", 16, 10).cast("int").alias("byte")).agg(F.count(F.lit(1)).alias("n"))


def merge_counts(key: list[str], *frames: DataFrame) -> DataFrame:
    """Keywise sum of histograms (key, n)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.groupBy(*key).agg(F.sum("n").alias("n"))


def chunk_counts(objects: DataFrame, n: int, text: str = "text") -> DataFrame:
    """Counts of the non-overlapping pieces of n characters, the last one shorter."""
    # One pass over a text: a substring by its place would walk from the text's start each time. (explode_outer, since explode would have Spark cut the text a second time, to filter empty ones.)
    piece = F.explode_outer(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{n}}}"), F.lit(0)))
    return objects.where(F.length(text) > 0).select(piece.alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def entropy(counts: DataFrame, by: list[str], base: int, key: str = "byte") -> DataFrame:
    """Shannon entropy of each group's histogram; groups of entropy 0 are left out."""
    total = Window.partitionBy(*by)
    p = F.col("n") / F.sum("n").over(total)
    return counts.withColumn("__p", p).groupBy(*by).agg(F.round(-F.sum(F.col("__p") * F.log(float(base), F.col("__p"))), 6).alias("entropy")).where("entropy > 0")


def chunk_entropy(objects: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(oid, address, entropy): entropy of each chunk in bits over 8, rounded to five places."""
    pieces = objects.where(F.length("data") > 0).select("oid", F.explode(F.expr(f"transform(sequence(0, length(data) - 1, {chunk}), i -> struct(i AS address, substring(data, i + 1, {chunk}) AS data))")).alias("c")).select("oid", "c.address", "c.data")
    counts = byte_counts(pieces, ["oid", "address"])
    p = F.col("n") / F.sum("n").over(Window.partitionBy("oid", "address"))
    return counts.withColumn("p", p).groupBy("oid", "address").agg(F.round(-F.sum(F.col("p") * F.log2("p")) / 8, 5).alias("entropy"))


def entropy_profile(chunks: DataFrame) -> DataFrame:
    """Mean and largest chunk entropy of every object, and the first address of the largest."""
    return chunks.groupBy("oid").agg(F.round(F.avg("entropy"), 9).alias("mean"), F.max("entropy").alias("highest"), F.min_by("address", F.struct(-F.col("entropy"), "address")).alias("at"))


def shares(counts: DataFrame) -> DataFrame:
    """n over the total of the histogram."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(*[c for c in counts.columns if c != "n"], F.round(F.col("n") / F.col("total"), 9).alias("share"))  # one row


def aligned(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, x, y): both histograms over all keys of either, 0 where one has none."""
    left, right = a.select(key, F.col("n").alias("x")), b.select(key, F.col("n").alias("y"))
    return left.join(right, key, "full").select(key, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def pearson(pairs: DataFrame) -> DataFrame:
    """r of x and y; 1 where a deviation is 0."""
    r = F.corr("x", "y")
    return pairs.agg(F.round(F.coalesce(F.nanvl(r, F.lit(1.0)), F.lit(1.0)), 6).alias("r"))


def collocations(grams: DataFrame, k: int = 20) -> DataFrame:
    """Of bigrams (x, y): the k largest p(xy) ln(p(xy) / (p(x) p(y))), with marginals of their first and second items."""
    pairs = grams.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.agg(F.sum("n").alias("total"))
    left = pairs.groupBy("x").agg(F.sum("n").alias("nx"))
    right = pairs.groupBy("y").agg(F.sum("n").alias("ny"))
    p = F.col("n") / F.col("total")
    score = p * F.log(p / (F.col("nx") / F.col("total") * F.col("ny") / F.col("total")))
    return pairs.join(left, "x").join(right, "y").crossJoin(F.broadcast(total)).select("x", "y", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "x", "y").limit(k)


#: Limits of the size buckets and their names; what no limit is above is "above".
SIZES = ((1_000, "<1k"), (10_000, "<10k"), (100_000, "<100k"), (1_000_000, "<1M"), (10_000_000, "<10M"))


def size_bucket(size: Column, limits: tuple[tuple[int, str], ...] = SIZES) -> Column:
    out = F.lit("above")
    for limit, name in reversed(limits):
        out = F.when(size < limit, name).otherwise(out)
    return out


def corpus_summary(objects: DataFrame, names: DataFrame, limits: tuple[tuple[int, str], ...] = SIZES) -> DataFrame:
    """(what, value, n): extensions by name, one type for each object, size buckets."""
    from cairn.functions.columns import extension_of

    one = lambda df, what, value: df.groupBy(F.lit(what).alias("what"), F.coalesce(value, F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return one(names, "extension", extension_of("name")).unionByName(one(objects, "type", F.array_min("types"))).unionByName(one(objects, "size", size_bucket(F.col("size"), limits)))


def triage(objects: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """Objects in the first category whose rule holds, with the share of all; a category without objects has a row with 0."""
    reason = F.lit("rest")
    for name, test in reversed(rules):
        reason = F.when(test, name).otherwise(reason)
    counts = objects.groupBy(reason.alias("category")).agg(F.count(F.lit(1)).alias("n"))
    every = objects.sparkSession.createDataFrame([(n,) for n, _ in rules] + [("rest",)], "category string")
    total = counts.agg(F.sum("n").alias("total"))
    return every.join(counts, "category", "left").crossJoin(F.broadcast(total)).select("category", F.coalesce("n", F.lit(0)).alias("n"), F.round(100 * F.coalesce("n", F.lit(0)) / F.col("total"), 4).alias("percent"))


def stats(column: str, prefix: str) -> list[Column]:
    c = F.col(column)
    return [F.round(F.avg(c), 6).alias(f"{prefix}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{prefix}_stdev"), F.round(F.percentile(c, F.lit(0.5)), 6).alias(f"{prefix}_median")]


def log_bin(time: Column, ends: list[float]) -> Column:
    """Number of the bin of a positive time, by ends that grow by factors."""
    out = F.lit(len(ends))
    for i in reversed(range(len(ends))):
        out = F.when(time <= ends[i], i).otherwise(out)
    return out.cast("int")


#: Parts that the files of one library or function are counted in first.
SALTS = 64


def import_popularity(imports: DataFrame) -> DataFrame:
    """Files for each library, each library's function and each function; a function also has the number of its libraries. Repeated rows count once.

    Files are counted in parts, so a function that every file imports is no task of its own, and a task's rows don't grow with the table.
    """
    rows = imports.count()
    none = F.lit(None).cast("long")

    def parts(*by: str) -> DataFrame:
        salt = F.pmod(F.xxhash64("oid"), F.lit(SALTS)).alias("__salt")
        once = dealt(imports.select("oid", *by, salt), [*by, "__salt"], rows).distinct()
        return once.groupBy(*by, "__salt").agg(F.count("oid").alias("files")).drop("__salt")

    def added(df: DataFrame, *by: str) -> DataFrame:
        return dealt(df, list(by), rows).groupBy(*by).agg(*[F.sum(c).alias(c) for c in df.columns if c not in by])

    pairs = added(parts("library", "name"), "library", "name")
    names = added(parts("name").withColumn("libraries", F.lit(0).cast("long")).unionByName(pairs.select("name", F.lit(0).cast("long").alias("files"), F.col("library").isNotNull().cast("long").alias("libraries"))), "name")
    libraries = added(parts("library"), "library")
    kind = lambda c: imports.schema[c].dataType
    out = libraries.select("library", F.lit(None).cast(kind("name")).alias("name"), "files", none.alias("libraries"))
    out = out.unionByName(pairs.withColumn("libraries", none))
    return out.unionByName(names.select(F.lit(None).cast(kind("library")).alias("library"), "name", "files", "libraries"))


def import_coverage(imports: DataFrame, share: float, covered: float = 1.0) -> DataFrame:
    """How many of the most popular functions cover `covered` of the imports of a share of the files.

    A file is covered by the k most popular when k is at least its ceil(covered x n)-th smallest rank.
    """
    from cairn.operators.joins import numbered

    popular = imports.groupBy("name").agg(F.count_distinct("oid").alias("files"))
    ranked = numbered(popular, [F.desc("files"), "name"])
    inside = imports.select("oid", "name").distinct().join(ranked, "name")
    by_rank = Window.partitionBy("oid").orderBy("rank")
    placed = inside.withColumn("i", F.row_number().over(by_rank)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("oid")))
    needs = placed.where(F.col("i") == F.ceil(F.col("n") * covered - 1e-9)).select("oid", "rank")
    return needs.agg(F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY rank)").cast("long").alias("functions"), F.count(F.lit(1)).alias("files"))


def file_statistics(files: DataFrame, names: DataFrame | None = None, sections: DataFrame | None = None, blocked: DataFrame | None = None, rtti: DataFrame | None = None, most: int = 10) -> DataFrame:
    """files (oid and more) with what the tables that are given tell of each, null where they have nothing of a file.

    names (oid, name): names. sections (oid, name, start): sections, parts (their names by start). blocked instructions (oid, faddr, block, mnemonic): functions, blocks, instructions, listed (the
    functions), top (the commonest mnemonics, at most `most`). rtti (oid, rtti): whether run-time type information was found. Each list is as long as the file's own names, sections or functions.
    """
    out = files
    if names is not None:
        out = out.join(names.groupBy("oid").agg(F.array_sort(F.collect_set("name")).alias("names")), "oid", "left")
    if sections is not None:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "name"))), lambda x: x["name"])
        out = out.join(sections.groupBy("oid").agg(F.count(F.lit(1)).alias("sections"), parts.alias("parts")), "oid", "left")
    if blocked is not None:
        shape = blocked.groupBy("oid").agg(F.count_distinct("faddr").alias("functions"), F.count_distinct("faddr", "block").alias("blocks"), F.count(F.lit(1)).alias("instructions"), F.array_sort(F.collect_set("faddr")).alias("listed"))
        ranked = Window.partitionBy("oid").orderBy(F.desc("n"), "mnemonic")
        best = blocked.groupBy("oid", "mnemonic").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most)
        top = best.groupBy("oid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "mnemonic"))), lambda x: x["mnemonic"]).alias("top"))
        out = out.join(shape, "oid", "left").join(top, "oid", "left")
    if rtti is not None:
        out = out.join(rtti.select("oid", "rtti"), "oid", "left")
    return out


def adaptive_coverage(imports: DataFrame, share: float, covered: float = 0.9, step: float = 0.1) -> DataFrame:
    """(round, functions, files): how many functions were chosen, and how many files had `covered` of their imports among them, after each round, until a share of the files has.

    Popularity counts only files that are not covered yet. A round chooses every function with at least 1 - step of the largest popularity left; so each was within that factor of the best
    choice of its round, and the number of rounds grows with the logarithm of the popularity, not with the number of functions. With step 0 a round takes the most popular function and its ties.
    Files without imports don't count; null files and names are no imports. Only counts come to the driver.
    """
    given = imports.where("oid IS NOT NULL AND name IS NOT NULL").select("oid", "name")
    of = Window.partitionBy("oid")
    first = (F.row_number().over(of.orderBy("name")) == 1).alias("first")
    # Imports of files that are not covered, of functions not chosen: n is the file's size, first marks a row of each file. A round writes them once.
    left = checkpointed(dealt(given, ["oid"], imports.count()).distinct().select("oid", "name", F.count(F.lit(1)).over(of).alias("n"), first))
    files = left.where("first").count()
    chosen, done, rows = 0, 0, []
    while done < share * files - 1e-9:
        popular = checkpointed(left.groupBy("name").agg(F.count(F.lit(1)).alias("files")))
        most = popular.agg(F.max("files")).first()[0]
        if most is None:
            break
        now = popular.where(F.col("files") >= most * (1 - step)).select("name")
        # What a file still lacks: it is covered when that is no more than the share that it may lack.
        rest = dealt(left.join(now, "name", "left_anti").select("oid", "name", "n"), ["oid"], left.count())
        rest = rest.select("oid", "name", "n", F.count(F.lit(1)).over(of).alias("lacks"), first)
        left = checkpointed(rest.where(F.col("lacks") > F.col("n") * (1 - covered) + 1e-9).drop("lacks"))
        chosen, done = chosen + now.count(), files - left.where("first").count()
        rows.append((len(rows) + 1, chosen, done))
    return imports.sparkSession.createDataFrame(rows, "round int, functions long, files long")


def pair_occurrences(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Unordered pairs with counts and percent of all."""
    counts = pairs.groupBy(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("x", "y", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("percent"))


def correlations(df: DataFrame, columns: list[str], method: str = "pearson") -> DataFrame:
    """(a, b, r) of every two columns."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.stat import Correlation

    vectors = VectorAssembler(inputCols=columns, outputCol="v").transform(df.na.drop(subset=columns))
    matrix = Correlation.corr(vectors, "v", method).first()[0].toArray()
    rows = [(a, b, round(float(matrix[i][j]), 6)) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_tests(df: DataFrame, columns: list[str], targets: list[str], method: str = "pearson") -> DataFrame:
    """(target, column, r, p, rank) of every column with each target, by falling r: the correlation and the two-sided probability of one as large by chance, by Student's t with n - 2 degrees.

    method is pearson or spearman (ranks, ties averaged). Rows with a null are left out. A column without variation, and fewer than three rows, have no r or p.
    """
    wanted = list(dict.fromkeys([*columns, *targets]))
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in wanted]).na.drop()
    n = rows.count()
    found = {(r.a, r.b): r.r for r in correlations(rows, wanted, method).collect()} if n > 1 else {}  # a row for each two columns
    out = []
    for t in targets:
        own = [(c, found.get((t, c))) for c in columns if c != t]
        own = [(c, None if r is None or r != r else max(-1.0, min(1.0, r))) for c, r in own]
        for rank, (c, r) in enumerate(sorted(own, key=lambda x: (x[1] is None, -(x[1] or 0.0), x[0])), 1):
            out.append((t, c, r, None if r is None or n < 3 else t_tail(r, n - 2), rank))
    return df.sparkSession.createDataFrame(out, "target string, column string, r double, p double, rank int")


def t_tail(r: float, degrees: int) -> float:
    """The probability that Student's t is further from nought than that of a correlation r: the regularised incomplete beta function of 1 - r^2, by its continued fraction (Lentz)."""
    from math import exp, lgamma, log

    x, a, b = 1 - r * r, degrees / 2, 0.5
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0

    def fraction(x: float, a: float, b: float) -> float:
        tiny, c = 1e-300, 1.0
        d = 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        out = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                out *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return out

    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x))
    return front * fraction(x, a, b) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(1 - x, b, a) / b


def first_reason(rules: list[tuple[str, Column]], otherwise: str = "kept") -> Column:
    out = F.lit(otherwise)
    for name, test in reversed(rules):
        out = F.when(test, name).otherwise(out)
    return out


def binned(counts: DataFrame, column: str, bins: list[tuple[str, int, int]]) -> DataFrame:
    """(bin, n) for each (name, least, most), also for bins without rows."""
    name = F.lit(None).cast("string")
    for label, least, most in bins:
        name = F.when(F.col(column).between(least, most), label).otherwise(name)
    found = counts.groupBy(name.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = counts.sparkSession.createDataFrame([(b[0],) for b in bins], "bin string")
    return every.join(found, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def coverage(intervals: DataFrame, sizes: DataFrame, by: list[str]) -> DataFrame:
    """Bytes and percent of each object that the union of a group's intervals (start, end) covers."""
    from cairn.operators.sets import merged

    united = merged(intervals, by).groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("bytes"))
    return united.join(sizes, "oid").select(*by, "bytes", F.round(100 * F.col("bytes") / F.col("size"), 4).alias("percent"))
