"""Queries over objects, names, collections and tags: scans, filters, sets of ids."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import columns as c
from cairn.operators import aggregates, filters, sets
from cairn.operators.graph import checkpointed
from cairn.plans.bindings import Bound
from cairn.plans.registry import query
from cairn.sources import files


def _folder(t: Bound, name: str) -> str:
    """A new path in the shared folder, with file: where Spark's paths without a scheme are such."""
    made = checkpointed(t.spark.range(1)).inputFiles()[0]  # makes sure that there is a shared folder, and tells of what kind
    path = f"{t.spark.conf.get('spark.checkpoint.dir').rstrip('/')}/{name}-{uuid.uuid4().hex}"
    return f"file://{path}" if path.startswith("/") and made.startswith("file:") else path


@query("s1_new_objects", "objects members", "SELECT oid, size FROM objects WHERE oid NOT IN (SELECT oid FROM members WHERE name = 'src1')")
def _(t: Bound) -> DataFrame:
    known = t.members.where("name = 'src1'").select("oid")
    return files.new_objects(t.objects, known).select("oid", "size")


@query("s1_import_directory", "objects", "SELECT oid, size FROM objects WHERE size > 0")
def _(t: Bound) -> DataFrame:
    """Contents written as files, a file for each, and imported again by their bytes.

    Where the shared folder is one of file:, the tasks that read contents write them as they are, and of very many files those of some folders are listed and read at a time. Elsewhere Spark writes them as text, dealt to 64 folders, so that all cores write files, whatever
    the tables' partitions; the tasks move the files to their place, not the driver one after the other.
    """
    path = _folder(t, "files")
    contents = t.contents.where("size > 0")

    def imported(folders: str | list[str], content: Column) -> DataFrame:
        found = files.import_directory(t.spark, folders).where(F.col("name").endswith(".txt"))
        return found.select(c.oid_of(content).alias("oid"), F.length(content).cast("long").alias("size"))

    if path.startswith("file:"):
        lists = files.write_files(contents.select("oid", "data"), path)
        if len(lists) == 1:
            return imported(path, F.col("data"))
        return reduce(DataFrame.unionByName, [checkpointed(imported(folders, F.col("data")).repartition("oid")) for folders in lists])  # ids in few files, not one for each task
    files_of = contents.select(F.base64("data").alias("value"), F.pmod(F.xxhash64("oid"), F.lit(64)).alias("folder"))
    files_of.repartition(64, "folder").write.partitionBy("folder").option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(path)
    return imported(path, F.unbase64(F.regexp_replace(F.decode("data", "utf-8"), r"\s", "")))


@query("s2_file_metadata", "names objects", "SELECT oid, list_sort(list_distinct(list(name))) AS names, count(*) AS imports, max(size) AS size FROM names JOIN objects USING (oid) GROUP BY oid")
def _(t: Bound) -> DataFrame:
    return files.metadata(t.names.join(t.objects.select("oid", "size"), "oid"))


@query("s3_content_store", "objects", "SELECT oid, size, sha256(text) AS digest FROM objects")
def _(t: Bound) -> DataFrame:
    return t.contents.select("oid", "size", F.sha2("data", 256).alias("digest"))


@query("s4_collections", "collections", "SELECT name, cid, num_oids FROM collections")
def _(t: Bound) -> DataFrame:
    return t.collections.select("name", "cid", "num_oids")


@query("s5_rename_and_prune", "members", "SELECT CASE name WHEN 'src2' THEN 'second' ELSE name END AS name, sha1(string_agg(oid, '' ORDER BY oid)) AS cid, count(*) AS num_oids FROM members WHERE oid NOT IN (SELECT oid FROM members WHERE name = 'src0') GROUP BY name")
def _(t: Bound) -> DataFrame:
    return sets.renamed(sets.pruned(t.members, t.members.where("name = 'src0'")), "src2", "second").select("name", "cid", "num_oids")


@query("s5_create_collection", "docs", "SELECT sha1(string_agg(oid, '' ORDER BY oid)) AS cid, 'short' AS name, count(*) AS num_oids FROM (SELECT DISTINCT oid FROM docs WHERE n_chars < 500)")
def _(t: Bound) -> DataFrame:
    new = sets.collection(t.documents.where("n_chars < 500"), "short")
    return new.select("cid", "name", "num_oids") if sets.may_create(t.collections, new) else new.limit(0).select("cid", "name", "num_oids")


@query("s6_result_keys", "objects", "SELECT count(*) AS records, count(DISTINCT oid) AS keys FROM objects")
def _(t: Bound) -> DataFrame:
    return t.objects.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("oid").alias("keys"))


@query("s7_missing_results", "docs", "SELECT DISTINCT oid, lang FROM docs WHERE (oid, lang) NOT IN (SELECT oid, lang FROM docs WHERE source < 'src15')")
def _(t: Bound) -> DataFrame:
    done = t.documents.where("source < 'src15'")
    return files.missing(t.documents.select("oid", "lang").distinct(), done, ["oid", "lang"])


@query("s8_delete_results", "objects members", "SELECT oid, size FROM objects WHERE oid NOT IN (SELECT oid FROM members WHERE name IN ('src3', 'src4'))")
def _(t: Bound) -> DataFrame:
    return files.without(t.objects.select("oid", "size"), t.members.where("name IN ('src3', 'src4')"))


@query("s9_json_round_trip", "", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Bound) -> DataFrame:
    path = _folder(t, "json")
    files.write_json(t.raw("customer").select("c_custkey", "c_name", "c_acctbal"), path)
    return files.read_json(t.spark, path, "c_custkey long, c_name string, c_acctbal double")


@query("s10_fact_dump", "instructions", "SELECT oid::VARCHAR AS oid, CASE WHEN operand % 2 = 0 THEN 'even' ELSE 'odd' END AS tool, count(*) AS facts FROM instructions GROUP BY ALL")
def _(t: Bound) -> DataFrame:
    path = _folder(t, "facts")
    tool = F.when(F.col("operand") % 2 == 0, "even").otherwise("odd")
    files.write_facts(t.instructions.select("oid", tool.alias("tool"), F.lit("instruction").alias("kind"), "offset", F.col("mnemonic").alias("value")), path)
    return files.read_json(t.spark, path, "oid string, tool string, kind string, offset long, value string").groupBy("oid", "tool").agg(F.count(F.lit(1)).alias("facts"))


@query("s11_truth_files", "", "SELECT p_brand AS oid, 'functions' AS type, p_partkey AS \"offset\", p_name AS name FROM part")
def _(t: Bound) -> DataFrame:
    """Truth files, one for each object, written and read again."""
    path = _folder(t, "truth")
    row = F.concat(F.lit("["), "p_partkey", F.lit(", "), F.to_json(F.struct(F.col("p_name").alias("n"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("p_name").alias("n")))) - 6), F.lit("]"))
    head = F.to_json(F.struct(F.col("p_brand").alias("oid"), F.lit("functions").alias("type")))
    held = t.raw("part").groupBy("p_brand").agg(F.collect_list(row).alias("rows")).select(F.col("p_brand").alias("file"), F.concat(F.lit("["), F.array_join(F.concat(F.array(head), "rows"), ",\n"), F.lit("]")).alias("value"))
    held.repartition("file").write.partitionBy("file").text(path)
    return files.read_truth(t.spark, path).select("oid", "type", "offset", F.get("fields", F.lit(0)).alias("name"))


@query("s13_ground_truth", "", "SELECT s_name AS sample, s_suppkey::VARCHAR AS addr, CASE WHEN s_acctbal > 0 THEN n_name END AS oid FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def _(t: Bound) -> DataFrame:
    """Ground truth as JSON, a file for each nation, written and read again; addresses are hexadecimal there."""
    path = _folder(t, "ground")
    target = F.struct(F.concat(F.lit("0x"), F.lower(F.hex("s_suppkey"))).alias("target_addr"), F.when(F.col("s_acctbal") > 0, F.col("n_name")).alias("target_oid"))
    sample = F.struct(F.struct(F.array(target).alias("targets")).alias("backdoor"))
    rows = t.raw("supplier").join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("s_name", sample.alias("s")))).alias("samples"))
    rows.select("n_nationkey", F.to_json(F.struct("samples")).alias("value")).write.partitionBy("n_nationkey").text(path)
    return files.read_ground_truth(t.spark, path).select("sample", "addr", "oid")


@query("s12_comparison_series", "collections", "SELECT t.cid AS target, b.cid AS baseline FROM collections t JOIN collections b ON t.name = 'src' || (substr(b.name, 4)::INT + 1)")
def _(t: Bound) -> DataFrame:
    """Every numbered collection against the one before it."""
    path = _folder(t, "series")
    after = F.concat(F.lit("src"), (F.substring("name", 4, 9).cast("int") + 1).cast("string"))
    t.collections.select(F.concat_ws(",", after, "name").alias("value")).unionByName(t.spark.createDataFrame([("# a comment",), ("",)], "value string")).write.text(path)
    return files.read_series(t.spark, path, t.collections)


@query("s14_report", "", "SELECT source, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source")
def _(t: Bound) -> DataFrame:
    path = _folder(t, "report")
    files.write_report(t.documents.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("chars")), path)
    return t.spark.read.schema("source string, files long, chars long").csv(path, header=True)


@query("p1_field", "", "SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def _(t: Bound) -> DataFrame:
    result = F.from_json("props", "map<string, bigint>")
    return t.raw("events").select("event_id", F.try_element_at(result, F.lit("k")).alias("k"))


@query("p2_select", "instructions", "SELECT operand FROM instructions WHERE operand IS NOT NULL AND operand <> 0")
def _(t: Bound) -> DataFrame:
    return filters.select_field(t.instructions, "operand")


@query("p3_extract_field", "", "SELECT event_id, CASE WHEN event_type = 'click' THEN event_id ELSE event_id + 1 END AS x FROM events")
def _(t: Bound) -> DataFrame:
    """A field of nested records: the deeper hit overrides the shallow one."""
    e = t.raw("events").select("event_id", F.when(F.col("event_type") == "click", F.to_json(F.struct(F.col("event_id").alias("x")))).otherwise(F.to_json(F.struct(F.col("event_id").alias("x"), F.struct(F.struct((F.col("event_id") + 1).alias("x")).alias("c")).alias("b")))).alias("record"))
    return filters.extract_field(e, "record", "x").select("event_id", F.col("x").cast("long").alias("x"))


@query("p4_clean", "", "SELECT event_id, nullif(value, 0) AS value, nullif(user_id, 0) AS user_id FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 0 ELSE value END AS value, user_id % 2 AS user_id FROM events) WHERE value <> 0 OR user_id <> 0")
def _(t: Bound) -> DataFrame:
    e = t.raw("events").select("event_id", F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("value"), (F.col("user_id") % 2).alias("user_id"))
    return filters.clean(e, ["event_id"])


@query("p5_size_filter", "objects", "SELECT oid, size FROM objects WHERE size > 1000 AND size < 5000")
def _(t: Bound) -> DataFrame:
    return filters.by_size(t.objects, 1000, 5000).select("oid", "size")


@query("p6_name_filter", "names", "SELECT DISTINCT oid FROM names WHERE starts_with(name, 'src1') AND ends_with(name, '.en')")
def _(t: Bound) -> DataFrame:
    return filters.by_name(t.names, "src1*.en")


@query("p7_byte_filter", "objects", "SELECT oid FROM objects WHERE contains(text, 'License')")
def _(t: Bound) -> DataFrame:
    return filters.by_bytes(t.contents, "License").select("oid")


TYPED = """
WITH heads AS (SELECT oid, size, CASE (size % 4)::INT WHEN 0 THEN 'MZ' WHEN 1 THEN chr(127) || 'ELF' WHEN 2 THEN '%PDF' ELSE 'plain' END AS head FROM objects),
typed AS (SELECT oid, size, CASE (size % 4)::INT WHEN 0 THEN ['PE'] WHEN 1 THEN ['ELF'] WHEN 2 THEN ['PDF'] ELSE ['Unknown'] END AS types FROM heads)
"""


def typed(t: Bound) -> DataFrame:
    """Objects behind a magic prefix that their size picks, with the types found from it."""
    n = F.col("size") % 4
    head = F.when(n == 0, F.lit("4D5A")).when(n == 1, F.lit("7F454C46")).when(n == 2, F.lit("25504446")).otherwise(F.lit("706C61696E"))
    o = t.contents.select("oid", "size", F.concat(F.unhex(head), F.substring("data", 1, 16)).alias("head"))
    return o.select("oid", "size", c.types_of("head").alias("types"))


@query("c3_magic_types", "objects", TYPED + "SELECT oid, types FROM typed")
def _(t: Bound) -> DataFrame:
    return typed(t).select("oid", "types")


@query("p8_type_filter", "objects", TYPED + "SELECT oid FROM typed WHERE list_has_any(types, ['PE', 'ELF'])")
def _(t: Bound) -> DataFrame:
    return filters.by_type(typed(t), "exe").select("oid")


@query("c4_category", "objects names", TYPED + "SELECT oid, name, CASE WHEN types[1] IN ('PE', 'ELF') THEN 'executable' WHEN types[1] = 'PDF' THEN 'document' ELSE 'other' END AS category FROM typed JOIN names USING (oid)")
def _(t: Bound) -> DataFrame:
    return typed(t).join(t.names, "oid").select("oid", "name", c.category_of(F.col("types"), c.extension_of("name")).alias("category"))


@query("p9_symbol_filter", "objects sections", "SELECT oid FROM objects WHERE oid NOT IN (SELECT oid FROM sections WHERE name = 'tail')")
def _(t: Bound) -> DataFrame:
    return filters.by_section(t.objects, t.sections, ["tail"], having=False).select("oid")


@query("p10_key_filter", "", "SELECT DISTINCT event_id AS oid FROM events WHERE props->>'$.k' LIKE '%7%'")
def _(t: Bound) -> DataFrame:
    results = t.raw("events").select(F.col("event_id").alias("oid"), F.from_json("props", "map<string, string>").alias("result"))
    return filters.by_key(results, "k", "7")


@query("p11_extension_filter", "names", "SELECT DISTINCT oid FROM names WHERE ends_with(name, '.de')")
def _(t: Bound) -> DataFrame:
    return filters.by_extension(t.names, "DE")


@query("p12_tag_filter", "tags", "SELECT DISTINCT oid FROM tags WHERE tag = 'quality' AND contains(value, '1')")
def _(t: Bound) -> DataFrame:
    return filters.by_tag(t.tags, "quality", "1")


@query("p13_time_filter", "tags", "SELECT DISTINCT oid FROM tags WHERE contains(tag, 'time') AND month(to_timestamp(value::BIGINT) AT TIME ZONE 'UTC') = 1 AND day(to_timestamp(value::BIGINT) AT TIME ZONE 'UTC') = 3 AND year(to_timestamp(value::BIGINT) AT TIME ZONE 'UTC') = 2024")
def _(t: Bound) -> DataFrame:
    return filters.by_time(t.tags, 2024, 1, 3)


@query("p14_not_cached", "docs", "SELECT DISTINCT oid FROM docs WHERE oid NOT IN (SELECT oid FROM docs JOIN labels USING (doc_id))")
def _(t: Bound) -> DataFrame:
    done = t.documents.join(t.raw("labels"), "doc_id").select("oid")
    return filters.cached(t.objects.select("oid"), done, ["oid"], having=False)


@query("p15_valid_split", "docs members", "SELECT DISTINCT oid, oid IN (SELECT oid FROM members WHERE name < 'src5') AS valid FROM docs")
def _(t: Bound) -> DataFrame:
    return filters.split_valid(t.objects.select("oid"), t.members.where("name < 'src5'"))


@query("p16_executables", "objects names", TYPED + "SELECT oid FROM (SELECT oid, types, list(name) AS n FROM typed JOIN names USING (oid) GROUP BY ALL) WHERE types[1] IN ('PE', 'ELF') AND len(list_filter(n, lambda x: contains(x, '.so') OR contains(x, '.ko'))) = 0")
def _(t: Bound) -> DataFrame:
    named = t.names.groupBy("oid").agg(F.collect_list("name").alias("names"))
    return filters.executables(typed(t).join(named, "oid").withColumn("category", c.category_of(F.col("types"), F.lit("")))).select("oid")


RULE = {"and": [["added", "removed"], ["nodes"]]}


@query("p17_rule_filter", "", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity::INT % 3 <> 0 OR l_linenumber % 2 <> 0) AND l_partkey % 5 <> 0 THEN 'Structural' ELSE 'modified' END AS category FROM lineitem")
def _(t: Bound) -> DataFrame:
    f = t.raw("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") % 3).alias("added"), (F.col("l_linenumber") % 2).alias("removed"), (F.col("l_partkey") % 5).alias("nodes"))
    return filters.by_rule(f, RULE, "Structural").select("l_orderkey", "l_linenumber", "category")


@query("p18_symbol_search", "", "SELECT p_name AS name, p_partkey AS \"offset\" FROM part WHERE regexp_matches(p_name, '(?i)PART.*7') ORDER BY p_name, p_partkey LIMIT 20 OFFSET 5")
def _(t: Bound) -> DataFrame:
    return filters.search_names(t.raw("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("offset")), "PART.*7", 5, 20)


@query("p19_string_search", "words", "SELECT oid, \"offset\", value FROM words WHERE contains(value, 'tion') ORDER BY oid, \"offset\" LIMIT 50 OFFSET 10")
def _(t: Bound) -> DataFrame:
    return filters.search_strings(t.words, "tion", 10, 50).select("oid", F.col("offset").cast("long").alias("offset"), "value")


@query("p20_read_bytes", "objects", "SELECT oid, CASE WHEN size > 100 THEN upper(substr(hex(encode(text)), 201, 64)) END AS bytes FROM objects")
def _(t: Bound) -> DataFrame:
    return filters.read_bytes(t.contents, 100, 32)


@query("p21_slow_sample", "", "SELECT l_suppkey AS oid, list_sort(list(l_orderkey * 10 + l_linenumber)) AS functions FROM lineitem WHERE l_quantity >= 49 GROUP BY 1 ORDER BY 1 LIMIT 10")
def _(t: Bound) -> DataFrame:
    f = t.raw("lineitem").select(F.col("l_suppkey").alias("oid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("function"), F.col("l_quantity").alias("time"))
    return filters.slow_sample(f, 49, 10)


@query("p22_outliers", "", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE greatest(l_quantity, l_extendedprice / 1000) > 60")
def _(t: Bound) -> DataFrame:
    f = t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_extendedprice") / 1000).alias("price"))
    return filters.outliers(f, ["l_quantity", "price"], 60).select("l_orderkey", "l_linenumber")


@query("o1_intersection", "members", "SELECT oid FROM members WHERE name IN ('src0', 'src1') GROUP BY oid HAVING count(DISTINCT name) = 2")
def _(t: Bound) -> DataFrame:
    return sets.intersection(t.members, ["src0", "src1"])


@query("o2_union", "members", "SELECT DISTINCT oid FROM members WHERE name IN ('src0', 'src1')")
def _(t: Bound) -> DataFrame:
    return sets.union(t.members.where("name = 'src0'"), t.members.where("name = 'src1'"))


@query("o3_orphans", "objects members", "SELECT oid FROM objects WHERE oid NOT IN (SELECT oid FROM members WHERE name <> 'src7')")
def _(t: Bound) -> DataFrame:
    return sets.orphans(t.objects, t.members.where("name <> 'src7'"))


@query("o4_offset_union", "tool_offsets", "SELECT DISTINCT \"offset\" FROM tool_offsets")
def _(t: Bound) -> DataFrame:
    return t.tool_offsets.where("offset IS NOT NULL").select("offset").distinct()


@query("o5_difference_matrix", "tool_offsets", "SELECT y, x, (SELECT count(*) FROM tool_offsets o WHERE o.tool = y AND o.\"offset\" NOT IN (SELECT \"offset\" FROM tool_offsets p WHERE p.tool = x)) AS only FROM (SELECT DISTINCT tool AS y FROM tool_offsets), (SELECT DISTINCT tool AS x FROM tool_offsets) UNION ALL SELECT tool, NULL, count(*) FROM tool_offsets GROUP BY tool")
def _(t: Bound) -> DataFrame:
    return sets.difference_matrix(t.tool_offsets, "tool", ["offset"])


BLOCKS_BY_TOOL = "WITH tb AS (SELECT l_returnflag AS tool, l_suppkey AS oid, l_partkey % 64 AS block, list_distinct(list(l_quantity::INT % 16)) AS dests FROM lineitem GROUP BY ALL)"


@query("o6_block_agreement", "", BLOCKS_BY_TOOL + " SELECT a.tool AS y, b.tool AS x, count(*) FILTER (list_sort(a.dests) = list_sort(b.dests)) AS same, count(*) FILTER (list_sort(a.dests) <> list_sort(b.dests)) AS diff, sum(len(list_filter(a.dests, lambda d: NOT list_contains(b.dests, d))))::BIGINT AS destinations FROM tb a JOIN tb b USING (oid, block) GROUP BY ALL")
def _(t: Bound) -> DataFrame:
    b = t.raw("lineitem").groupBy(F.col("l_returnflag").alias("tool"), F.col("l_suppkey").alias("oid"), (F.col("l_partkey") % 64).alias("block")).agg(F.collect_set(F.col("l_quantity").cast("int") % 16).alias("dests"))
    return sets.block_agreement(b)


@query("o7_jaccard_distance", "instructions", "SELECT a.oid AS x, b.oid AS y, round(1 - len(list_intersect(a.s, b.s)) / len(list_distinct(a.s || b.s)), 6) AS distance FROM (SELECT oid, list_distinct(list(operand)) AS s FROM instructions GROUP BY oid) a JOIN (SELECT oid, list_distinct(list(operand)) AS s FROM instructions GROUP BY oid) b ON a.oid < b.oid")
def _(t: Bound) -> DataFrame:
    s = t.instructions.groupBy("oid").agg(F.collect_set("operand").alias("s"))
    return s.alias("a").join(s.alias("b"), F.col("a.oid") < F.col("b.oid")).select(F.col("a.oid").alias("x"), F.col("b.oid").alias("y"), F.round(sets.jaccard_distance(F.col("a.s"), F.col("b.s")), 6).alias("distance"))


RANGES = "WITH r AS (SELECT tool, run, min(\"offset\") AS start, max(\"offset\") AS \"end\" FROM (SELECT *, sum(new) OVER (PARTITION BY tool ORDER BY \"offset\") AS run FROM (SELECT *, CASE WHEN \"offset\" - lag(\"offset\") OVER (PARTITION BY tool ORDER BY \"offset\") > 8 THEN 1 ELSE 0 END AS new FROM tool_offsets)) GROUP BY tool, run)"


@query("w6_ranges", "tool_offsets", RANGES + " SELECT tool, start, \"end\" FROM r")
def _(t: Bound) -> DataFrame:
    return sets.ranges(t.tool_offsets, ["tool"])


#: The points of one tool's ranges that are in none of another's, as half-open intervals.
CUT = RANGES + ", points AS (SELECT tool, unnest(range(start, \"end\" + 1)) AS p FROM r), kept AS (SELECT p FROM points WHERE tool = 'A' EXCEPT SELECT p FROM points WHERE tool = 'N') SELECT 0 AS g, min(p) AS start, max(p) + 1 AS \"end\" FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS grp FROM kept) GROUP BY grp"


@query("o8_interval_subtraction", "tool_offsets", CUT)
def _(t: Bound) -> DataFrame:
    r = sets.ranges(t.tool_offsets, ["tool"]).withColumn("end", F.col("end") + 1).withColumn("g", F.lit(0))
    return sets.subtracted(r.where("tool = 'A'").drop("tool"), r.where("tool = 'N'").drop("tool"), ["g"])


@query("o9_truth_ranges", "tool_offsets", """
WITH most AS (SELECT DISTINCT "offset" FROM tool_offsets WHERE tool IN ('A', 'N')),
good AS (SELECT tool, "offset" FROM tool_offsets WHERE "offset" IN (SELECT "offset" FROM most))
SELECT tool, min("offset") AS start, max("offset") AS "end" FROM (SELECT *, sum(new) OVER (PARTITION BY tool ORDER BY "offset") AS run FROM (SELECT *, CASE WHEN "offset" - lag("offset") OVER (PARTITION BY tool ORDER BY "offset") > 8 THEN 1 ELSE 0 END AS new FROM good)) GROUP BY tool, run""")
def _(t: Bound) -> DataFrame:
    most = t.tool_offsets.where("tool IN ('A', 'N')").select("offset").distinct()
    return sets.ranges(t.tool_offsets.join(most, "offset", "left_semi"), ["tool"])


@query("o10_tool_only", "tool_offsets", "SELECT \"offset\" FROM tool_offsets WHERE tool = 'R' AND \"offset\" NOT IN (SELECT \"offset\" FROM tool_offsets WHERE tool = 'A')")
def _(t: Bound) -> DataFrame:
    return t.tool_offsets.where("tool = 'R'").select("offset").join(t.tool_offsets.where("tool = 'A'").select("offset"), "offset", "left_anti")


@query("w11_dark_zones", "imports", """
WITH iv AS (SELECT oid, (name % 500) AS start, (name % 500) + 10 + library % 20 AS "end" FROM imports),
runs AS (SELECT *, sum(new) OVER (PARTITION BY oid ORDER BY start, "end") AS run FROM (SELECT *, CASE WHEN start > max("end") OVER (PARTITION BY oid ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS new FROM iv)),
m AS (SELECT oid, run, min(start) AS start, max("end") AS "end" FROM runs GROUP BY oid, run)
SELECT oid, start, "end" FROM (SELECT oid, "end" AS start, lead(start) OVER (PARTITION BY oid ORDER BY start) AS "end" FROM m) WHERE "end" > start""")
def _(t: Bound) -> DataFrame:
    iv = t.listed_imports.select("oid", (F.col("name") % 500).alias("start"), (F.col("name") % 500 + 10 + F.col("library") % 20).alias("end"))
    return sets.gaps(iv, ["oid"])


@query("a40_byte_coverage", "imports", """
WITH iv AS (SELECT DISTINCT oid, unnest(range(name % 500, name % 500 + 10 + library % 20)) AS p FROM imports)
SELECT oid, count(*) AS bytes, round(100 * count(*) / 530, 4) AS percent FROM iv GROUP BY oid""")
def _(t: Bound) -> DataFrame:
    iv = t.listed_imports.select("oid", (F.col("name") % 500).alias("start"), (F.col("name") % 500 + 10 + F.col("library") % 20).alias("end"))
    return aggregates.coverage(iv, t.listed_imports.select("oid").distinct().withColumn("size", F.lit(530)), ["oid"])


@query("c20_tags", "tags", "SELECT oid, tag, arg_max(value, version) AS value FROM tags GROUP BY oid, tag")
def _(t: Bound) -> DataFrame:
    """Tags by last write."""
    return t.tags.groupBy("oid", "tag").agg(F.max_by("value", "version").alias("value"))
