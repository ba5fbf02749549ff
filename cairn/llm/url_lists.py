"""URL filters by lists that change with time.

Dated list entries become validity intervals: an entry holds for its key until the next entry of
the key, and a removal leaves none. An as-of join finds, for every key of a captured URL, the
interval in which the capture lies. Both ends of the work are done in ranges of time within a
key, and what one range hands to later ones is a row for each range, so a key with very many
captures or entries is no single task. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm.common import written

#: Rows of one time range, all keys together; a range of a key has no more.
ROWS_IN_RANGE = 5_000
MOST_RANGES = 10_000


def host(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def url_keys(url: str = "url") -> Column:
    """The keys a list may have for a URL: its host, the domains above down to two labels, host and first path segment."""
    labels = F.split(host(url), r"\.")
    above = F.transform(F.sequence(F.lit(0), F.greatest(F.size(labels) - 2, F.lit(0))), lambda i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    segment = F.coalesce(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)", 1), F.lit(""))
    return F.filter(F.array_distinct(F.concat(above, F.when(segment != "", F.array(F.concat_ws("/", host(url), segment))).otherwise(F.array().cast("array<string>")))), lambda k: k != "")


def ranged(spark_df: DataFrame, at: str, low: int, width: int) -> DataFrame:
    return spark_df.withColumn("range", F.floor((F.col(at) - F.lit(low)) / F.lit(width)).cast("long"))


def intervals(entries: DataFrame, low: int, width: int) -> DataFrame:
    """(key, since, until, action, range) from entries (key, dated, action): until is the next entry's time, or null.

    Of several entries of a key at one time, block counts before allow before remove. Entries
    without key, time or action are left out.
    """
    rank = F.when(F.col("action") == "block", 0).when(F.col("action") == "allow", 1).otherwise(2)
    one = entries.where("key IS NOT NULL AND dated IS NOT NULL AND action IS NOT NULL").groupBy("key", "dated").agg(F.min_by("action", rank).alias("action"))
    one = ranged(one, "dated", low, width)
    later = one.groupBy("key", "range").agg(F.min("dated").alias("first"))
    later = later.select(F.col("key").alias("k"), F.col("range").alias("r"), F.lead("first").over(Window.partitionBy("key").orderBy("range")).alias("then"))
    inside = one.withColumn("next", F.lead("dated").over(Window.partitionBy("key", "range").orderBy("dated")))
    joined = inside.join(later, (F.col("key") == F.col("k")) & (F.col("range") == F.col("r")))
    return joined.select("key", F.col("dated").alias("since"), F.coalesce("next", "then").alias("until"), "action", "range")


def as_of(asked: DataFrame, spans: DataFrame, low: int, width: int) -> DataFrame:
    """asked (key, t), distinct, with the interval (since, action) that holds at t, where there is one that blocks or allows."""
    asked = ranged(asked, "t", low, width).select("key", "range", "t", F.lit(None).cast("struct<since: bigint, until: bigint, action: string>").alias("span"))
    starts = spans.select("key", "range", F.col("since").alias("t"), F.struct("since", "until", "action").alias("span"))
    last = starts.groupBy("key", "range").agg(F.max_by("span", "t").alias("last"))
    ranges = last.unionByName(asked.select("key", "range").distinct().withColumn("last", F.lit(None).cast("struct<since: bigint, until: bigint, action: string>"))).groupBy("key", "range").agg(F.first("last", True).alias("last"))
    before = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges.select(F.col("key").alias("k"), F.col("range").alias("r"), F.last("last", True).over(before).alias("carried"))
    within = Window.partitionBy("key", "range").orderBy("t", F.col("span").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = asked.withColumn("ask", F.lit(True)).unionByName(starts.withColumn("ask", F.lit(False))).withColumn("span", F.last("span", True).over(within)).where("ask")
    held = both.join(carried, (F.col("key") == F.col("k")) & (F.col("range") == F.col("r")), "left").withColumn("span", F.coalesce("span", "carried"))
    return held.where("span IS NOT NULL AND span.action <> 'remove' AND (span.until IS NULL OR t < span.until)").select("key", "t", "span.since", "span.action")


def judged(captures: DataFrame, entries: DataFrame, id: str = "page_id", url: str = "url", at: str = "fetched") -> DataFrame:
    """captures with blocked, rule and since: what the longest key with an active entry says at the time of the fetch.

    Times are whole seconds. A capture without url or time, or without an active entry, is not
    blocked and has no rule. Repeated captures are judged alike. id needn't be unique.
    """
    base = captures.select(*[c for c in captures.columns if c not in ("blocked", "rule", "since")])
    asked = written(base.select(F.explode(url_keys(url)).alias("key"), F.col(at).alias("t")).where("t IS NOT NULL").distinct(), "asked")
    span = asked.agg(F.count(F.lit(1)), F.min("t"), F.max("t")).first()
    low, high = span[1] or 0, span[2] or 0
    width = max(1, -(-(high - low + 1) // max(1, min(MOST_RANGES, span[0] // ROWS_IN_RANGE))))
    found = as_of(asked, intervals(entries, low, width), low, width)
    keyed = base.select(F.col(url).alias("u"), F.col(at).alias("f")).where("u IS NOT NULL AND f IS NOT NULL").distinct().withColumn("key", F.explode(url_keys("u")))
    best = keyed.join(found, (keyed.key == found.key) & (keyed.f == found.t)).groupBy("u", "f").agg(F.max(F.struct(F.length(keyed.key).alias("n"), keyed.key.alias("rule"), "since", "action")).alias("best"))
    out = base.join(best, (F.col(url) == F.col("u")) & (F.col(at) == F.col("f")), "left")
    return out.select(*[base[c] for c in base.columns], F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"), F.col("best.rule").alias("rule"), F.col("best.since").alias("since"))


#: The tables that the query derives: every page is a capture, a minute apart by id, and gives a list entry half a minute later.
CAPTURES = "SELECT page_id, url, 1704067200 + page_id * 60 AS fetched FROM pages"
ENTRIES = """
SELECT CASE page_id % 3 WHEN 0 THEN host WHEN 1 THEN concat(host, '/', segment) ELSE domain END AS key,
  1704067230 + page_id * 60 AS dated,
  CASE (page_id * 7) % 4 WHEN 2 THEN 'allow' WHEN 3 THEN 'remove' ELSE 'block' END AS action
FROM (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1) AS segment,
  regexp_extract(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '([^.]+[.][^.]+)$', 1) AS domain FROM pages WHERE url IS NOT NULL) x
"""
ORACLE = f"""
WITH captures AS ({CAPTURES}),
entries AS (SELECT key, dated, arg_min(action, CASE action WHEN 'block' THEN 0 WHEN 'allow' THEN 1 ELSE 2 END) AS action FROM ({ENTRIES}) GROUP BY key, dated),
parts AS (SELECT page_id, fetched, lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]+/([^/?#]+)', 1) AS segment FROM captures),
keys AS (
  SELECT page_id, fetched, unnest(list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.'))) AS key FROM parts
  UNION SELECT page_id, fetched, concat(host, '/', segment) FROM parts WHERE segment <> ''),
held AS (SELECT k.page_id, k.key, e.dated, e.action FROM keys k ASOF JOIN entries e ON k.key = e.key AND k.fetched >= e.dated WHERE k.key <> ''),
best AS (SELECT page_id, arg_max(struct_pack(rule := key, since := dated, action := action), (length(key), key)) AS b FROM held WHERE action <> 'remove' GROUP BY page_id)
SELECT c.page_id, c.url, coalesce(b.action = 'block', false) AS blocked, b.rule AS rule, b.since AS since FROM captures c LEFT JOIN best USING (page_id)
"""
