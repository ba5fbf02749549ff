"""Queries that join: pairings, calls, containment, truth, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import joins, sets, windows
from cairn.operators.graph import checkpointed
from cairn.plans.bindings import Bound
from cairn.plans.registry import query


@query("j1_expand", "docs collections members", "SELECT DISTINCT oid FROM (SELECT m.oid FROM collections c JOIN members m USING (name) WHERE name < 'src13' UNION ALL SELECT oid FROM docs WHERE doc_id < 50)")
def _(t: Bound) -> DataFrame:
    ids = t.collections.where("name < 'src13'").selectExpr("cid AS oid").unionByName(t.documents.where("doc_id < 50").select("oid")).unionByName(t.spark.createDataFrame([("unknown",)], "oid string"))
    return sets.expanded(ids, t.collections, t.members, t.objects)


@query("j2_membership", "members", "SELECT name, list_sort(list_distinct(list(oid))) AS shared FROM members WHERE name <> 'src0' AND oid IN (SELECT oid FROM members WHERE name = 'src0') GROUP BY name")
def _(t: Bound) -> DataFrame:
    return sets.memberships(t.members.where("name = 'src0'"), t.members, ["src0"])


@query("j3_exact_pairs", "members", "SELECT oid FROM members WHERE name = 'src0' INTERSECT SELECT oid FROM members WHERE name = 'src1'")
def _(t: Bound) -> DataFrame:
    return t.members.where("name = 'src0'").join(t.members.where("name = 'src1'"), "oid", "left_semi").select("oid")


@query("j4_name_pairs")
def _(t: Bound) -> DataFrame:
    """Files of two collections that share a name; names are the parts of the documents' languages and size classes."""
    named = lambda s: t.documents.where(f"source = '{s}'").select("oid", F.concat_ws("_", "lang", (F.col("n_chars") / 400).cast("int")).alias("name"))
    return joins.pair_by_name(named("src0"), named("src1"))


@query("j5_similarity_pairs", "matches", """
WITH RECURSIVE ranked AS (SELECT t, b, similarity, row_number() OVER (ORDER BY similarity DESC, t, b) AS i FROM matches),
step AS (
  SELECT 0::BIGINT AS i, []::BIGINT[] AS ts, []::BIGINT[] AS bs, NULL::BIGINT AS t, NULL::BIGINT AS b, NULL::DOUBLE AS similarity
  UNION ALL
  SELECT r.i, CASE WHEN free THEN list_append(ts, r.t) ELSE ts END, CASE WHEN free THEN list_append(bs, r.b) ELSE bs END, CASE WHEN free THEN r.t END, CASE WHEN free THEN r.b END, r.similarity
  FROM (SELECT s.*, q.i AS qi, q.t AS qt, q.b AS qb, q.similarity AS qs, NOT list_contains(s.ts, q.t) AND NOT list_contains(s.bs, q.b) AS free FROM step s JOIN ranked q ON q.i = s.i + 1) x(i0, ts, bs, t0, b0, s0, i, t, b, similarity, free), LATERAL (SELECT x.i AS i, x.t AS t, x.b AS b, x.similarity AS similarity) r)
SELECT t, b, similarity FROM step WHERE t IS NOT NULL""")
def _(t: Bound) -> DataFrame:
    return joins.one_to_one(t.matches, "t", "b", "similarity")


@query("j5_assigned_pairs")
def _(t: Bound) -> DataFrame:
    """Pairs of the largest sum of similarities, by auction."""
    return joins.assigned(t.matches, "t", "b", "similarity", 1e-4)


@query("j6_pair_report")
def _(t: Bound) -> DataFrame:
    files = checkpointed(t.documents.where("source IN ('src0', 'src1')").select("source", "oid", F.col("doc_id").alias("id"), F.concat_ws("_", "lang", "n_chars").alias("name")))
    own = lambda s, *what: files.where(f"source = '{s}'").select(*what)
    sides = [checkpointed(own(s, "oid").distinct()) for s in ("src1", "src0")]
    both = sides[0].join(sides[1], "oid", "left_semi")
    pairs = joins.pair_by_name(*[own(s, "oid", "name").join(both, "oid", "left_anti") for s in ("src1", "src0")])
    return joins.pair_files(*sides, pairs, t.matches.withColumnRenamed("similarity", "score"), (own("src1", "id", "oid"), own("src0", "id", "oid")))


@query("j7_function_mapping", "matches names", "SELECT t, b, tn.name AS t_name, bn.name AS b_name FROM matches LEFT JOIN names tn ON t = tn.doc_id LEFT JOIN names bn ON b = bn.doc_id")
def _(t: Bound) -> DataFrame:
    return joins.function_mapping(t.matches, t.names.select(F.col("doc_id").alias("faddr"), "name"))


@query("j8_direct_calls", "instructions", "SELECT faddr, \"offset\", operand AS callee FROM instructions WHERE mnemonic = 'purchase' AND operand IN (SELECT faddr FROM instructions)")
def _(t: Bound) -> DataFrame:
    return joins.direct_calls(t.instructions, t.instructions, F.col("mnemonic") == "purchase").select("faddr", "offset", "callee")


@query("j9_call_targets", "call_edges", """
WITH owner AS (SELECT DISTINCT n AS block, n // 4 AS faddr FROM (SELECT src AS n FROM call_edges UNION SELECT dst FROM call_edges)),
hits AS (SELECT s.faddr AS f, list_sort(list_distinct(list(d.faddr))) AS targets FROM call_edges e JOIN owner s ON e.src = s.block JOIN owner d ON e.dst = d.block WHERE s.faddr <> d.faddr GROUP BY 1)
SELECT f, coalesce(targets, []) AS targets FROM (SELECT DISTINCT faddr AS f FROM owner) LEFT JOIN hits USING (f)""")
def _(t: Bound) -> DataFrame:
    nodes = t.call_edges.select(F.col("src").alias("block")).unionByName(t.call_edges.select(F.col("dst").alias("block"))).distinct()
    return joins.call_targets(t.call_edges, nodes.withColumn("faddr", F.expr("block div 4")))


@query("j10_call_map", "call_edges", "SELECT f, list_sort(coalesce(list(DISTINCT g) FILTER (way), [])) AS calls_to, list_sort(coalesce(list(DISTINCT g) FILTER (NOT way), [])) AS calls_from FROM (SELECT src AS f, dst AS g, true AS way FROM call_edges UNION ALL SELECT dst, src, false FROM call_edges) GROUP BY f")
def _(t: Bound) -> DataFrame:
    return joins.call_map(t.call_edges)


#: Two versions of the call graph: edges of even orders' parities; functions map to themselves where both have them.
VERSIONS = """
WITH te AS (SELECT src, dst FROM call_edges WHERE (src + dst) % 3 <> 0), be AS (SELECT src, dst FROM call_edges WHERE (src + dst) % 5 <> 0),
nodes AS (SELECT src AS n FROM call_edges UNION SELECT dst FROM call_edges), m AS (SELECT n AS t, n AS b FROM nodes WHERE n % 7 <> 0),
added AS (
  SELECT m.t, m.b, e.dst AS callee, CASE WHEN x.src IS NOT NULL THEN 'paired' WHEN c.b IS NOT NULL THEN 'added_existing' ELSE 'added_new' END AS kind
  FROM m JOIN te e ON m.t = e.src LEFT JOIN m c ON e.dst = c.t LEFT JOIN be x ON x.src = m.b AND x.dst = c.b),
removed AS (
  SELECT m.t, m.b, e.dst AS callee, CASE WHEN c.t IS NOT NULL THEN 'removed_existing' ELSE 'removed_deleted' END AS kind
  FROM m JOIN be e ON m.b = e.src LEFT JOIN m c ON e.dst = c.b LEFT JOIN te x ON x.src = m.t AND x.dst = c.t WHERE x.src IS NULL),
diff AS (SELECT * FROM added UNION ALL SELECT * FROM removed)
"""


def versions(t: Bound) -> DataFrame:
    e = t.call_edges
    nodes = e.select(F.col("src").alias("n")).unionByName(e.select(F.col("dst").alias("n"))).distinct()
    m = nodes.where("n % 7 <> 0").select(F.col("n").alias("t"), F.col("n").alias("b"))
    return joins.call_diff(e.where("(src + dst) % 3 <> 0"), e.where("(src + dst) % 5 <> 0"), m)


@query("j11_call_diff", "call_edges", VERSIONS + "SELECT t, b, callee, kind FROM diff")
def _(t: Bound) -> DataFrame:
    return versions(t)


@query("j12_call_changes", "call_edges", VERSIONS + "SELECT t, b, count(*) FILTER (kind = 'added_existing') AS fc_add_existing, count(*) FILTER (kind = 'added_new') AS fc_add_new, count(*) FILTER (kind = 'removed_existing') AS fc_removed_existing, count(*) FILTER (kind = 'removed_deleted') AS fc_removed_deleted FROM diff GROUP BY t, b")
def _(t: Bound) -> DataFrame:
    return joins.call_changes(versions(t))


@query("j13_containment", "words sections objects", "SELECT w.oid, w.\"offset\" AS \"offset\", s.name AS name FROM words w JOIN sections s ON w.oid = s.oid AND w.\"offset\" >= s.start AND w.\"offset\" < s.start + s.len")
def _(t: Bound) -> DataFrame:
    return joins.contained(t.words.select("oid", F.col("offset").cast("long").alias("offset")), t.sections).select("oid", "offset", "name")


@query("j14_truth_join", "tool_offsets", """
WITH least AS (SELECT "offset" FROM tool_offsets WHERE tool = 'A' INTERSECT SELECT "offset" FROM tool_offsets WHERE tool = 'N'),
most AS (SELECT DISTINCT "offset" FROM tool_offsets WHERE tool IN ('A', 'N')), tools AS (SELECT DISTINCT tool FROM tool_offsets)
SELECT tool, "offset", CASE WHEN "offset" IN (SELECT "offset" FROM most) THEN 'correct' ELSE 'false_positive' END AS verdict FROM tool_offsets
UNION ALL SELECT tool, "offset", 'false_negative' FROM least, tools WHERE (tool, "offset") NOT IN (SELECT tool, "offset" FROM tool_offsets)""")
def _(t: Bound) -> DataFrame:
    of = lambda tool: t.tool_offsets.where(f"tool = '{tool}'").select("offset")
    return joins.against_truth(t.tool_offsets, of("A").intersect(of("N")), of("A").union(of("N")))


@query("j15_name_lookup", "names collections", "SELECT n.name, n.oid, c.cid FROM names n JOIN collections c ON n.source = c.name WHERE n.name LIKE 'src3%'")
def _(t: Bound) -> DataFrame:
    return t.names.where(F.col("name").startswith("src3")).join(t.collections.select(F.col("name").alias("source"), "cid"), "source").select("name", "oid", "cid")


CLASSES = """
WITH td AS (SELECT doc_id AS t FROM documents WHERE source = 'src1'), bd AS (SELECT doc_id AS b FROM documents WHERE source = 'src0'), kept AS (SELECT * FROM matches),
classes AS (
  SELECT t, b, similarity, CASE WHEN similarity < 1 THEN row_number() OVER (PARTITION BY similarity >= 1 ORDER BY similarity, t, b) END AS rank, CASE WHEN similarity >= 1 THEN 'matched' ELSE 'modified' END AS class FROM kept
  UNION ALL SELECT t, NULL, NULL, NULL, 'unmatched_target' FROM td WHERE t NOT IN (SELECT t FROM kept) UNION ALL SELECT NULL, b, NULL, NULL, 'unmatched_baseline' FROM bd WHERE b NOT IN (SELECT b FROM kept))
"""


def classes(t: Bound) -> DataFrame:
    side = lambda s, k: t.raw("documents").where(f"source = '{s}'").select(F.col("doc_id").alias(k))
    return joins.classified(t.matches, side("src1", "t"), side("src0", "b"))


@query("j16_classes", "matches", CLASSES + 'SELECT t, b, similarity, rank, class FROM classes')
def _(t: Bound) -> DataFrame:
    return classes(t)


@query("w3_similarity_rank", "matches", "SELECT t, b, row_number() OVER (ORDER BY similarity, t, b) AS rank FROM matches WHERE similarity < 1")
def _(t: Bound) -> DataFrame:
    return classes(t).where("class = 'modified'").select("t", "b", "rank")


@query("a18_file_classes", "matches", CLASSES + "SELECT class, count(*) AS n FROM classes GROUP BY class")
def _(t: Bound) -> DataFrame:
    return classes(t).groupBy("class").agg(F.count(F.lit(1)).alias("n"))


@query("a19_class_totals", "matches", CLASSES + "SELECT lang, class, count(*) AS n FROM classes JOIN documents ON doc_id = coalesce(t, b) GROUP BY ROLLUP (class, lang) HAVING class IS NOT NULL")
def _(t: Bound) -> DataFrame:
    """Counts by class and language, and over all languages."""
    lang = t.raw("documents").select(F.col("doc_id"), "lang")
    return classes(t).withColumn("doc_id", F.coalesce("t", "b")).join(lang, "doc_id").rollup("class", "lang").agg(F.count(F.lit(1)).alias("n")).where("class IS NOT NULL").select("lang", "class", "n")


@query("a20_series_table", "members", "SELECT t.name AS target, count(*) FILTER (b.oid IS NOT NULL) AS matched, count(*) FILTER (b.oid IS NULL) AS unmatched FROM members t LEFT JOIN members b ON t.oid = b.oid AND b.name = 'src0' WHERE t.name <> 'src0' GROUP BY t.name")
def _(t: Bound) -> DataFrame:
    """One wide row for each comparison of the series src<n> against src0."""
    base = t.members.where("name = 'src0'").select("oid", F.lit("matched").alias("category"))
    each = t.members.where("name <> 'src0'").join(base, "oid", "left").select(F.col("name").alias("target"), F.coalesce("category", F.lit("unmatched")).alias("category"))
    return each.groupBy("target").agg(*[F.count_if(F.col("category") == k).alias(k) for k in ("matched", "unmatched")])


FUNCTION_GRAMS = "WITH g AS (SELECT DISTINCT oid, faddr, mnemonic || ',' || lead(mnemonic, 1) OVER w || ',' || lead(mnemonic, 2) OVER w AS gram FROM instructions WINDOW w AS (PARTITION BY faddr ORDER BY \"offset\")), s AS (SELECT oid, faddr, list_sort(list(gram)) AS grams FROM g WHERE gram IS NOT NULL GROUP BY ALL)"
CLOSEST = FUNCTION_GRAMS + """, sim AS (SELECT a.faddr AS item, b.faddr AS other, round(len(list_intersect(a.grams, b.grams))::DOUBLE / len(list_distinct(a.grams || b.grams)), 6) AS similarity FROM s a JOIN s b ON a.oid <> b.oid),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY similarity DESC, other) AS rank FROM sim WHERE similarity > 0)"""


def function_sets(t: Bound) -> DataFrame:
    grams = windows.ngrams(t.instructions, ["oid", "faddr"], ["offset"], "mnemonic", 3)
    return grams.groupBy(F.col("oid").alias("object"), F.col("faddr").alias("item")).agg(F.collect_set("gram").alias("grams"))


@query("j17_closest_functions", "instructions", CLOSEST + " SELECT item, other, similarity, rank FROM ranked WHERE rank <= 1")
def _(t: Bound) -> DataFrame:
    return joins.closest(function_sets(t))


@query("w12_top_matches", "instructions", CLOSEST + " SELECT item, other, similarity, rank FROM ranked WHERE rank <= 3")
def _(t: Bound) -> DataFrame:
    return joins.closest(function_sets(t), k=3)


@query("j18_nullable_truth", "", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT user_id AS addr, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS oid FROM events WHERE event_type IN ('error', 'purchase') AND value > 100) g WHERE g.addr = e.user_id AND (g.oid IS NULL OR g.oid = e.event_type))")
def _(t: Bound) -> DataFrame:
    e = t.raw("events")
    truth = e.where("event_type IN ('error', 'purchase') AND value > 100").select(F.col("user_id").alias("addr"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("oid"))
    return joins.in_truth(e.select("event_id", F.col("user_id").alias("addr"), F.col("event_type").alias("oid")), truth).select("event_id")


@query("j19_component_inference", "", "SELECT r_name AS category, n_name AS component, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE s_acctbal > 0 GROUP BY ALL")
def _(t: Bound) -> DataFrame:
    return joins.inferred(found_components(t, 0), places(t))


@query("j19_possible_components", "", "SELECT r_name AS category, n_name AS component FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_regionkey IN (SELECT n_regionkey FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 9900)")
def _(t: Bound) -> DataFrame:
    """All components of the categories of which the richest suppliers show one."""
    return joins.inferred(found_components(t, 9900), places(t), "possible")


def places(t: Bound) -> DataFrame:
    return t.raw("nation").join(t.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("component"), F.col("r_name").alias("category"))


def found_components(t: Bound, above: float) -> DataFrame:
    """The nation of every supplier with so much money."""
    return t.raw("supplier").where(F.col("s_acctbal") > above).join(t.raw("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("component"))


@query("j20_feature_tree", "blocked", "SELECT oid, faddr, count(DISTINCT block) AS blocks, count(*) AS instructions, list_sort(list(DISTINCT mnemonic)) AS features FROM blocked GROUP BY oid, faddr")
def _(t: Bound) -> DataFrame:
    """Bottom up: instructions to blocks, blocks to functions."""
    blocks = t.blocked.groupBy("oid", "faddr", "block").agg(F.count(F.lit(1)).alias("n"), F.collect_set("mnemonic").alias("found"))
    return blocks.groupBy("oid", "faddr").agg(F.count(F.lit(1)).alias("blocks"), F.sum("n").alias("instructions"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))).alias("features"))


@query("j21_string_references", "instructions", "SELECT i.faddr, i.\"offset\", p_name AS value FROM instructions i JOIN part ON i.operand = p_partkey")
def _(t: Bound) -> DataFrame:
    strings = t.raw("part").select(F.col("p_partkey").alias("operand"), F.col("p_name").alias("value"))
    return t.instructions.join(strings, "operand").select("faddr", "offset", "value")


@query("j22_added_callees", "call_edges", "SELECT src, dst FROM call_edges WHERE dst % 7 = 0 AND src % 7 <> 0")
def _(t: Bound) -> DataFrame:
    added = t.call_edges.where("dst % 7 = 0").select("dst").distinct()
    return t.call_edges.where("src % 7 <> 0").join(added, "dst", "left_semi").select("src", "dst")


@query("j23_tool_table", "tool_offsets", "SELECT \"offset\", max(CASE WHEN tool = 'A' THEN 'x' ELSE '' END) AS A, max(CASE WHEN tool = 'N' THEN 'x' ELSE '' END) AS N, max(CASE WHEN tool = 'R' THEN 'x' ELSE '' END) AS R FROM tool_offsets GROUP BY \"offset\"")
def _(t: Bound) -> DataFrame:
    return joins.tool_table(t.tool_offsets, ["A", "N", "R"])


@query("j24_collection_info", "collections names", "SELECT c.name, c.cid, c.num_oids, list_sort(list(n.name)) AS files FROM collections c JOIN names n ON n.source = c.name GROUP BY ALL")
def _(t: Bound) -> DataFrame:
    held = t.names.groupBy("source").agg(F.array_sort(F.collect_list("name")).alias("files"))
    return t.collections.join(held, F.col("name") == F.col("source")).select("name", "cid", "num_oids", "files")


@query("j25_object_listing", "objects names sections", "SELECT o.oid, min(n.name) AS name, o.size, bool_or(l.doc_id IS NOT NULL) AS analysed, (SELECT count(*) FROM sections s WHERE s.oid = o.oid) AS sections FROM objects o JOIN names n USING (oid) LEFT JOIN labels l USING (doc_id) GROUP BY o.oid, o.size")
def _(t: Bound) -> DataFrame:
    named = t.names.join(t.raw("labels").select("doc_id", F.lit(True).alias("l")).distinct(), "doc_id", "left").groupBy("oid").agg(F.min("name").alias("name"), F.max(F.coalesce("l", F.lit(False))).alias("analysed"))
    held = t.sections.groupBy("oid").agg(F.count(F.lit(1)).alias("sections"))
    return t.objects.select("oid", "size").join(named, "oid").join(held, "oid", "left").select("oid", "name", "size", "analysed", F.coalesce("sections", F.lit(0)).alias("sections"))


@query("j26_function_lookup", "", "SELECT p_partkey AS \"offset\", p_name AS name, p_brand AS object FROM part WHERE p_name IN (SELECT p_name FROM part WHERE p_size = 7)")
def _(t: Bound) -> DataFrame:
    wanted = t.raw("part").where("p_size = 7").select("p_name").distinct()
    return t.raw("part").join(wanted, "p_name", "left_semi").select(F.col("p_partkey").alias("offset"), F.col("p_name").alias("name"), F.col("p_brand").alias("object"))


@query("j27_scope", "members", "SELECT oid FROM members WHERE name = 'src0' AND oid < '8'")
def _(t: Bound) -> DataFrame:
    scope = t.members.where("name = 'src0'").select("oid")
    return joins.scope_restricted(scope, scope.where("oid < '8'"))
