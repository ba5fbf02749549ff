"""Projections, filters and predicates over objects, names and tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truthy(df: DataFrame, column: str) -> Column:
    """What counts as a value: not null, and not zero, false, empty text or an empty list."""
    kind, c = df.schema[column].dataType.typeName(), F.col(column)
    if kind in ("string", "binary"):
        return c.isNotNull() & (F.length(c) > 0)
    if kind in ("array", "map"):
        return c.isNotNull() & (F.size(c) > 0)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False))
    return c.isNotNull() & (c != 0) if kind in ("byte", "short", "integer", "long", "float", "double", "decimal") else c.isNotNull()


def select_field(df: DataFrame, field: str) -> DataFrame:
    """The truthy values of one field."""
    return df.where(truthy(df, field)).select(field)


def extract_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """The field of a JSON column at depth one, two or three; a deeper hit overrides."""
    any_key = "map<string, string>"
    below = lambda c: F.filter(F.map_values(F.from_json(c, any_key)), lambda v: v.startswith("{"))
    at = lambda cs: F.element_at(F.filter(F.transform(cs, lambda v: F.get_json_object(v, f"$.{field}")), lambda v: v.isNotNull()), -1)
    one = F.get_json_object(F.col(column), f"$.{field}")
    level2 = below(F.col(column))
    level3 = F.flatten(F.transform(level2, below))
    last = lambda cs: F.when(F.size(F.filter(F.transform(cs, lambda v: F.get_json_object(v, f"$.{field}")), lambda v: v.isNotNull())) > 0, at(cs))
    return df.withColumn(field, F.coalesce(last(level3), last(level2), one))


def clean(df: DataFrame, key: list[str]) -> DataFrame:
    """Records that have a truthy field outside key; falsy fields become null."""
    rest = [c for c in df.columns if c not in key]
    out = df.select(*key, *[F.when(truthy(df, c), F.col(c)).alias(c) for c in rest])
    return out.na.drop(how="all", subset=rest)


def by_size(objects: DataFrame, least: int = 0, most: int = 0) -> DataFrame:
    """Objects larger than least and smaller than most, both bounds exclusive; most 0 is none."""
    kept = objects.where(F.col("size") > least)
    return kept.where(F.col("size") < most) if most else kept


def by_name(names: DataFrame, pattern: str) -> DataFrame:
    """Distinct ids with a name equal to the pattern, or with its prefix and suffix where it has a star."""
    prefix, star, rest = pattern.partition("*")
    name = F.col("name")
    test = name.startswith(prefix) & name.endswith(rest.split("*")[0]) if star else name == pattern
    return names.where(test).select("oid").distinct()


def by_bytes(objects: DataFrame, text: str) -> DataFrame:
    return objects.where(F.contains("data", F.encode(F.lit(text), "utf-8")))


def by_type(objects: DataFrame, wanted: str) -> DataFrame:
    """Objects of which a type contains the wanted text in any case; exe stands for all executables."""
    some = ["pe", "elf", "macho", "universal"] if wanted.lower() == "exe" else [wanted.lower()]
    return objects.where(F.exists("types", lambda t: reduce(lambda a, b: a | b, [F.contains(F.lower(t), F.lit(s)) for s in some])))


def by_section(objects: DataFrame, sections: DataFrame, names: list[str], having: bool = True) -> DataFrame:
    """Objects with (or without) a section of one of the names: linker, stripped and debug symbols are such tests."""
    return objects.join(sections.where(F.col("name").isin(names)).select("oid"), "oid", "left_semi" if having else "left_anti")


def by_key(results: DataFrame, key: str, value: str | None = None) -> DataFrame:
    """Ids whose result map has the key, with a value that contains a text."""
    held = F.try_element_at("result", F.lit(key))
    return results.where(held.isNotNull() & (held.contains(value) if value is not None else F.lit(True))).select("oid").distinct()


def by_extension(names: DataFrame, extension: str) -> DataFrame:
    from cairn.functions.columns import extension_of

    return names.where(F.lower(extension_of("name")) == extension.lower()).select("oid").distinct()


EMPTY = "<empty>"


def by_tag(tags: DataFrame, tag: str, value: str = EMPTY) -> DataFrame:
    """Ids with the tag, where the stored or the asked value is empty or the stored one contains the asked."""
    kept = tags.where(F.col("tag") == tag)
    if value != EMPTY:
        kept = kept.where((F.col("value") == EMPTY) | F.contains("value", F.lit(value)))
    return kept.select("oid").distinct()


def by_time(tags: DataFrame, year: int | None = None, month: int | None = None, day: int | None = None) -> DataFrame:
    """Ids of which a numeric tag with time in its name lies in the given year, month and day (session time zone)."""
    at = F.timestamp_seconds(F.expr("try_cast(value AS BIGINT)"))
    parts = [f(at) == v for f, v in ((F.year, year), (F.month, month), (F.dayofmonth, day)) if v is not None]
    return tags.where(F.contains("tag", F.lit("time")) & at.isNotNull() & reduce(lambda a, b: a & b, parts, F.lit(True))).select("oid").distinct()


def cached(ids: DataFrame, results: DataFrame, on: list[str], having: bool = True) -> DataFrame:
    """Ids that have (or lack) a result for the same options."""
    return ids.join(results.select(*on).distinct(), on, "left_semi" if having else "left_anti")


def split_valid(ids: DataFrame, known: DataFrame) -> DataFrame:
    """Each id with valid: whether any source holds it, in one pass."""
    held = known.select("oid").distinct().withColumn("__held", F.lit(True))
    return ids.join(held, "oid", "left").select(*ids.columns, F.col("__held").isNotNull().alias("valid"))


def executables(objects: DataFrame) -> DataFrame:
    """Objects of the executable category none of whose names has .so or .ko."""
    return objects.where((F.col("category") == "executable") & ~F.exists("names", lambda n: F.contains(n, F.lit(".so")) | F.contains(n, F.lit(".ko"))))


def rule_column(rule: dict) -> Column:
    """A rule card as a predicate: a list under and holds groups of alternatives, a list under or is one group."""
    alternatives = lambda names: reduce(lambda a, b: a | b, [F.col(n) != 0 for n in names])
    if "and" in rule:
        return reduce(lambda a, b: a & b, [alternatives(group) for group in rule["and"]])
    return alternatives(rule["or"])


def by_rule(features: DataFrame, rule: dict, name: str) -> DataFrame:
    """The features with a category: the rule's name where it holds, modified where not."""
    return features.withColumn("category", F.when(rule_column(rule), name).otherwise("modified"))


def search_names(symbols: DataFrame, pattern: str, offset: int, limit: int) -> DataFrame:
    """Symbols whose name matches in any case, by name; a pattern that is no regular expression is literal."""
    import re

    try:
        re.compile(pattern)
    except re.error:
        pattern = re.escape(pattern)
    return symbols.where(F.col("name").rlike("(?i)" + pattern)).orderBy("name", "offset").offset(offset).limit(limit)


def search_strings(strings: DataFrame, text: str, offset: int, limit: int) -> DataFrame:
    return strings.where(F.contains("value", F.lit(text))).orderBy("oid", "offset").offset(offset).limit(limit)


MOST_READ = 4096


def read_bytes(objects: DataFrame, offset: int, size: int) -> DataFrame:
    """Hexadecimal of the bytes from offset on, null past the end."""
    part = F.substring("data", offset + 1, min(size, MOST_READ))
    return objects.select("oid", F.when(F.col("size") > offset, F.hex(part)).alias("bytes"))


def slow_sample(functions: DataFrame, least: float, n: int) -> DataFrame:
    """The first n objects that have functions of at least that time, each with the sorted functions."""
    slow = functions.where(F.col("time") >= least).groupBy("oid").agg(F.array_sort(F.collect_list("function")).alias("functions"))
    return slow.orderBy("oid").limit(n)


def outliers(df: DataFrame, columns: list[str], above: float) -> DataFrame:
    return df.where(F.greatest(*columns) > above) if len(columns) > 1 else df.where(F.col(columns[0]) > above)
