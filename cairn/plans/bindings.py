"""The model's tables over the driver's tables: as DataFrames, and as DuckDB's common table expressions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.columns import cid_of, oid_of
from cairn.operators.alike import alike_pairs
from cairn.operators.graph import checkpointed
from cairn.session import table

#: Epoch second of 2024-01-01, the first import.
EPOCH = 1_704_067_200
#: So many ids of repeated contents are broadcast at most.
MOST_BROADCAST = 2_000_000
#: Pairs of documents that are less alike are no matches.
LEAST_ALIKE = 0.02


class Bound:
    """Each property is one table of the data model, bound to the driver tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").withColumn("oid", oid_of(F.encode("text", "utf-8")))

    @cached_property
    def objects(self) -> DataFrame:
        """(oid, size), one row for each content."""
        return self.documents.select("oid", F.octet_length("text").cast("long").alias("size")).dropDuplicates(["oid"])

    @cached_property
    def contents(self) -> DataFrame:
        """(oid, data, text, size), one row for each content; contents stay in the tasks that read them.

        Only ids are shuffled: they tell which rows repeat a content, and these rows are left out where they are read. A list of
        them that is too long to broadcast is joined.
        """
        ids = self.documents.select("oid", "doc_id")
        first = ids.groupBy("oid").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("oid", "first")
        again = checkpointed(ids.join(first, "oid").where("doc_id <> first").select("doc_id"))
        again = F.broadcast(again) if again.count() <= MOST_BROADCAST else again.hint("merge")
        return self.documents.join(again, "doc_id", "left_anti").select("oid", F.encode("text", "utf-8").alias("data"), "text", F.octet_length("text").cast("long").alias("size"))

    @cached_property
    def names(self) -> DataFrame:
        return self.documents.select("oid", F.concat_ws("", "source", F.lit("_"), "doc_id", F.lit("."), "lang").alias("name"), "doc_id", "source")

    @cached_property
    def members(self) -> DataFrame:
        return self.documents.select(F.col("source").alias("name"), "oid").distinct()

    @cached_property
    def collections(self) -> DataFrame:
        return self.members.groupBy("name").agg(cid_of("oid").alias("cid"), F.count(F.lit(1)).alias("num_oids"))

    @cached_property
    def tags(self) -> DataFrame:
        labels = self.raw("labels").join(self.documents.select("doc_id", "oid"), "doc_id")
        each = labels.select("oid", "doc_id", F.explode(F.create_map(F.lit("quality"), F.col("quality").cast("string"), F.lit("toxic"), F.col("toxic").cast("string"), F.lit("import_time"), (F.col("doc_id") * 3600 + EPOCH).cast("string"))).alias("tag", "value"))
        return each.withColumnRenamed("doc_id", "version")

    @cached_property
    def instructions(self) -> DataFrame:
        order = Window.partitionBy("user_id").orderBy("ts", "event_id")
        e = self.raw("events")
        return e.select(
            (F.col("user_id") % 10).alias("oid"), F.col("user_id").alias("faddr"), (F.row_number().over(order) * 4).cast("long").alias("offset"), F.col("event_type").alias("mnemonic"), F.get_json_object("props", "$.k").cast("long").alias("operand")
        )

    @cached_property
    def blocked(self) -> DataFrame:
        """Instructions with the block they stand in: a block ends after each error."""
        order = Window.partitionBy("faddr").orderBy("offset")
        ends = F.coalesce(F.sum(F.when(F.col("mnemonic") == "error", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        i = self.instructions.withColumn("island", ends)
        return i.withColumn("block", F.min("offset").over(Window.partitionBy("faddr", "island"))).drop("island")

    @cached_property
    def block_edges(self) -> DataFrame:
        order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
        e = self.raw("lineitem").select(F.col("l_suppkey").alias("faddr"), (F.col("l_partkey") % 128).alias("src"), F.lead(F.col("l_partkey") % 128).over(order).alias("dst"))
        return e.where("dst IS NOT NULL")

    @cached_property
    def call_edges(self) -> DataFrame:
        return self.listed_calls.distinct()

    @cached_property
    def listed_calls(self) -> DataFrame:
        """Calls with their repeats, for what doesn't count them."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
        e = self.raw("lineitem").select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst"))
        return e.where("dst IS NOT NULL AND src <> dst")

    def among(self, ids: DataFrame) -> DataFrame:
        """A written list of ids for a semi join: broadcast where it is short enough."""
        ids = checkpointed(ids)
        return F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids.hint("merge")

    @cached_property
    def tool_offsets(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_returnflag").alias("tool"), (F.col("l_partkey") * 64 + F.col("l_quantity").cast("long")).alias("offset")).distinct()

    @staticmethod
    def section_list() -> Column:
        """The sections of an object by its size."""
        return F.when(F.col("size") >= 96, F.array(*[F.struct(F.lit(n).alias("name"), a.cast("long").alias("start"), b.cast("long").alias("end")) for n, a, b in (("head", F.lit(0), F.lit(64)), ("body", F.lit(64), F.col("size") - 32), ("tail", F.col("size") - 32, F.col("size")))])).otherwise(F.array(F.struct(F.lit("head").alias("name"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))))

    @cached_property
    def sections(self) -> DataFrame:
        return self.objects.select("oid", F.explode(self.section_list()).alias("s")).select("oid", "s.name", "s.start", (F.col("s.end") - F.col("s.start")).alias("len"))

    @cached_property
    def imports(self) -> DataFrame:
        return self.listed_imports.distinct()

    @cached_property
    def listed_imports(self) -> DataFrame:
        """Imports with their repeats, for what doesn't count them."""
        return self.raw("lineitem").select(F.col("l_orderkey").alias("oid"), F.col("l_suppkey").alias("library"), F.col("l_partkey").alias("name"))

    @cached_property
    def words(self) -> DataFrame:
        """(oid, offset, value): the extracted strings, here the runs of letters and digits of a text, with their order as offset."""
        found = F.posexplode(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("offset", "value")
        return self.contents.select("oid", found)

    @cached_property
    def matches(self) -> DataFrame:
        """Scored pairs of documents of src1 (target) and src0 (baseline): Jaccard of their sets of word trigrams."""
        words = self.raw("documents").where("source IN ('src0', 'src1')").select("doc_id", "source", F.split(F.lower("text"), " ").alias("w"))
        # Of three lists: a function of places would split the text again for each of them.
        at = lambda i: F.slice("w", i, F.greatest(F.size("w") - 2, F.lit(0)))
        joined = lambda x, y: F.concat(x, F.lit(" "), y)
        grams = F.when(F.size("w") < 3, F.array(F.array_join("w", " "))).otherwise(F.zip_with(F.zip_with(at(1), at(2), joined), at(3), joined))
        side = lambda source: words.where(f"source = '{source}'").select(F.col("doc_id").alias("id"), grams.alias("grams"))
        return alike_pairs(side("src1"), side("src0"), LEAST_ALIKE).select(F.col("left").alias("t"), F.col("right").alias("b"), "similarity")


#: Name -> (bindings it reads, SELECT).
CTES: dict[str, tuple[str, str]] = {
    "docs": ("", "SELECT *, sha1(text) AS oid FROM documents"),
    "objects": ("docs", "SELECT DISTINCT oid, text, strlen(text) AS size FROM docs"),
    "names": ("docs", "SELECT oid, source || '_' || doc_id || '.' || lang AS name, doc_id, source FROM docs"),
    "members": ("docs", "SELECT DISTINCT source AS name, oid FROM docs"),
    "collections": ("members", "SELECT name, sha1(string_agg(oid, '' ORDER BY oid)) AS cid, count(*) AS num_oids FROM members GROUP BY name"),
    "tags": ("docs", "SELECT oid, doc_id AS version, unnest(['quality', 'toxic', 'import_time']) AS tag, unnest([quality::VARCHAR, toxic::VARCHAR, (doc_id * 3600 + 1704067200)::VARCHAR]) AS value FROM labels JOIN docs USING (doc_id)"),
    "instructions": ("", "SELECT user_id % 10 AS oid, user_id AS faddr, 4 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS \"offset\", event_type AS mnemonic, (props->>'$.k')::BIGINT AS operand FROM events"),
    "blocked": ("instructions", "SELECT oid, faddr, \"offset\", mnemonic, operand, min(\"offset\") OVER (PARTITION BY faddr, island) AS block FROM (SELECT *, coalesce(sum((mnemonic = 'error')::INT) OVER (PARTITION BY faddr ORDER BY \"offset\" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM instructions)"),
    "block_edges": ("", "SELECT faddr, src, dst FROM (SELECT l_suppkey AS faddr, l_partkey % 128 AS src, lead(l_partkey % 128) OVER w AS dst FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)) WHERE dst IS NOT NULL"),
    "call_edges": ("", "SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst"),
    "tool_offsets": ("", "SELECT DISTINCT l_returnflag AS tool, l_partkey * 64 + l_quantity::BIGINT AS \"offset\" FROM lineitem"),
    "sections": ("objects", "SELECT oid, s.name AS name, s.start AS start, s.len AS len FROM (SELECT oid, unnest(CASE WHEN size >= 96 THEN [{'name': 'head', 'start': 0, 'len': 64}, {'name': 'body', 'start': 64, 'len': size - 96}, {'name': 'tail', 'start': size - 32, 'len': 32}] ELSE [{'name': 'head', 'start': 0, 'len': size}] END) AS s FROM objects)"),
    "imports": ("", "SELECT DISTINCT l_orderkey AS oid, l_suppkey AS library, l_partkey AS name FROM lineitem"),
    "words": ("objects", "SELECT oid, unnest(w) AS value, unnest(range(0, len(w))) AS \"offset\" FROM (SELECT oid, regexp_extract_all(text, '[A-Za-z0-9]+') AS w FROM objects)"),
    "grams": ("", "SELECT doc_id, source, len(g) AS n, unnest(g) AS g FROM (SELECT doc_id, source, list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM (SELECT doc_id, source, string_split(lower(text), ' ') AS w FROM documents WHERE source IN ('src0', 'src1')))"),
    "matches": ("grams", "SELECT t, b, round(c / (tn + bn - c), 6) AS similarity FROM (SELECT t.doc_id AS t, b.doc_id AS b, t.n AS tn, b.n AS bn, count(*) AS c FROM grams t JOIN grams b ON t.g = b.g AND t.source = 'src1' AND b.source = 'src0' GROUP BY ALL) WHERE c / (tn + bn - c) >= 0.02"),
}
