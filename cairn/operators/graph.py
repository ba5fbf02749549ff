"""Graphs as edge tables: closures, components, neighbourhoods and complexity."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import small_batches


def checkpointed(df: DataFrame) -> DataFrame:
    """df from a table in the folder that driver and executors share (spark.checkpoint.dir; our own where it is unset)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.conf.set("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="cairn-"))
    path = f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that a task gets, about, where their number is known.
ROWS_IN_TASK = 500_000


def dealt(df: DataFrame, by: list[str], rows: int) -> DataFrame:
    """df, of so many rows, dealt by columns to as many tasks as keep each near ROWS_IN_TASK rows, however many rows there are; Spark chooses where that is no more than a task for each core."""
    tasks = -(-rows // ROWS_IN_TASK)
    return df.repartition(tasks, *by) if tasks > df.sparkSession.sparkContext.defaultParallelism else df.repartition(*by)


def reachable(edges: DataFrame, start: DataFrame, by: list[str] | None = None, rounds: int | None = None) -> DataFrame:
    """(by, node, depth): all nodes that paths from start's nodes reach, with the fewest steps; start has depth 0.

    Each round joins only the newest nodes with the edges, and takes away those seen. It ends
    when a round finds none, so cycles do no harm; rounds is the most steps that count, None sets no bound.
    """
    by = by or []
    seen = front = checkpointed(start.select(*by, "node").distinct().withColumn("depth", F.lit(0)))
    for depth in count(1) if rounds is None else range(1, rounds + 1):
        step = front.select(*by, F.col("node").alias("src")).join(edges, [*by, "src"]).select(*by, F.col("dst").alias("node")).distinct()
        front = checkpointed(step.join(seen.select(*by, "node"), [*by, "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not front.limit(1).count():
            break
        seen = checkpointed(seen.unionByName(front)) if depth % 5 == 0 else seen.unionByName(front)
    return seen


#: So many rows of a round's new nodes, or anchors, are broadcast at most.
MOST_NEW = 500_000
#: A node has a row for so many times 64 anchors.
WORDS = 4


def reachable_from_each(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(anchor, node): all nodes that paths from the nodes of each anchor reach; start is (anchor, node), its nodes are reached.

    Anchors are numbered, and 64 times WORDS of them share a row for a node, a bit for each; so a round joins and writes a row for each node and as many anchors, not one
    for each pair. A round sends on only the bits that the one before has added, and writes once; where it sends few rows, the edges stay where they are.
    Edges are read in every round, so they should be a written table; repeats among them change nothing.
    """
    from cairn.operators.joins import numbered

    numbers = checkpointed(numbered(start.select("anchor").where("anchor IS NOT NULL").distinct(), ["anchor"], "i").select("anchor", (F.col("i") - 1).alias("i")))
    n = numbers.count()
    words = max(1, min(WORDS, -(-n // 64)))
    anchors = numbers.select("anchor", F.expr(f"i div {64 * words}").alias("block"), F.expr(f"CAST(i div 64 % {words} AS int)").alias("word"), F.expr("CAST(i % 64 AS int)").alias("bit"))
    spread = lambda df, rows: F.broadcast(df) if rows <= MOST_NEW else df
    each = lambda text, to: [F.expr(text.format(k)).alias(f"{to}{k}") for k in range(words)]
    first = start.where("node IS NOT NULL").join(spread(anchors, n), "anchor").groupBy("block", "node").agg(*each("bit_or(if(word = {0}, shiftleft(1L, bit), 0L))", "old"))
    seen = checkpointed(first.select("*", *each("old{0}", "new")))
    some_new = " OR ".join(f"new{k} <> 0" for k in range(words))
    while sent := (front := seen.where(some_new)).count():
        step = edges.where("dst IS NOT NULL").join(spread(front.select("block", F.col("node").alias("src"), *each("new{0}", "new")), sent), "src")
        step = step.select("block", F.col("dst").alias("node"), *each("0L", "old"), *each("new{0}", "new"))
        known = seen.select("block", "node", *each("old{0}", "old"), *each("0L", "new"))
        met = known.unionByName(step).groupBy("block", "node").agg(*each("bit_or(old{0})", "old"), *each("bit_or(new{0})", "new"))
        seen = checkpointed(met.select("block", "node", *each("old{0} | new{0}", "old"), *each("new{0} & ~old{0}", "new")))
    lists = anchors.groupBy("block").agg(F.collect_list(F.struct("word", "bit", "anchor")).alias("of"))
    reached = seen.agg(F.sum(F.expr(" + ".join(f"CAST(bit_count(old{k}) AS long)" for k in range(words))))).first()[0]
    met = dealt(seen, ["block", "node"], reached or 0).join(spread(lists, n), "block").select("node", F.array(*[f"old{k}" for k in range(words)]).alias("old"), F.explode("of").alias("a"))
    return met.where("shiftright(old[a.word], a.bit) & 1L = 1").select("a.anchor", "node")


def neighbourhood(edges: DataFrame, start: int, depth: int, most: int) -> DataFrame:
    """(node, depth, truncated): within depth steps either way, at most `most` nodes: the nearest, then the smallest."""
    edges = checkpointed(edges.select("src", "dst"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    found = reachable(both, edges.sparkSession.createDataFrame([(start,)], "node long"), rounds=depth)
    return found.orderBy("depth", "node").limit(most).withColumn("truncated", F.lit(found.count() > most))


#: A graph of more edges is worked on by joins; smaller ones, however many, each within a task.
SMALL_GRAPH = 100_000


def strong_components(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, node, component) for many graphs at once; component is the least node of it. Edges between given nodes count.

    Graphs of at most SMALL_GRAPH edges are a row each and walked where it is, many in a batch; larger ones go by rounds of joins.
    """
    nodes = nodes.select(*by, "node").distinct()
    if not by:
        return _strong_by_rounds(edges, nodes, by)
    sized = checkpointed(edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SMALL_GRAPH).select(*by))
    some_large = bool(sized.limit(1).count())
    small = lambda df: df.join(sized, by, "left_anti") if some_large else df
    kind = edges.schema["src"].dataType.simpleString()
    kinds = ", ".join(f"`{c}` {edges.schema[c].dataType.simpleString()}" for c in by)
    none = F.lit(None).cast(kind)
    rows = small(edges.select(*by, "src", "dst", none.alias("node"))).unionByName(small(nodes.select(*by, none.alias("src"), none.alias("dst"), "node")))
    walk = F.collect_set(F.when(F.col("src").isNotNull() & F.col("dst").isNotNull(), F.struct("src", "dst"))).alias("walk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            walks, given = batch.column(len(by)), batch.column(len(by) + 1)
            at, found, least = [], [], []
            for i in range(len(batch)):
                of, ends = given[i].as_py(), walks[i].values
                part = _strong([*of, *ends.field("src").to_pylist()], [*of, *ends.field("dst").to_pylist()])
                at += [i] * len(of)
                found += of
                least += [part[x] for x in of]
            own = [batch.column(i).take(pa.array(at, pa.int64())) for i in range(len(by))]
            yield pa.RecordBatch.from_arrays([*own, pa.array(found, given.type.value_type), pa.array(least, given.type.value_type)], names=[*by, "node", "component"])

    small_batches(edges.sparkSession, 200)
    graphs = rows.groupBy(*by).agg(walk, F.collect_set("node").alias("given"))
    out = graphs.mapInArrow(run, f"{kinds}, node {kind}, component {kind}")
    if not some_large:
        return out
    large = lambda df: df.join(sized, by, "left_semi")
    return out.unionByName(_strong_by_rounds(large(edges), large(nodes), by))


def _strong(src: list, dst: list) -> dict:
    """Node -> least node of its strong component, by two depth-first walks: the second against the edges, from the last finished on."""
    ahead: dict = {}
    back: dict = {}
    for s, d in zip(src, dst, strict=True):
        ahead.setdefault(s, []).append(d)
        ahead.setdefault(d, [])
        back.setdefault(d, []).append(s)
    finished, seen = [], set()
    for root in ahead:
        walk = [] if root in seen else [(root, iter(ahead[root]))]
        seen.add(root)
        while walk:
            node, rest = walk[-1]
            for other in rest:
                if other not in seen:
                    seen.add(other)
                    walk.append((other, iter(ahead[other])))
                    break
            else:
                finished.append(node)
                walk.pop()
    out: dict = {}
    for root in reversed(finished):
        if root not in out:
            out[root], own = root, [root]
            for node in own:
                for other in back.get(node, ()):
                    if other not in out:
                        out[other] = root
                        own.append(other)
            least = min(own)
            out.update(dict.fromkeys(own, least))
    return out


def _strong_by_rounds(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """Forward and backward least labels, until every node has its component.

    In each round the least label of the nodes still free is spread along the edges and against
    them; the nodes that get the same label from both are the component of that label's node.
    """
    free = checkpointed(nodes.select(*by, "node").distinct())
    edges = checkpointed(edges.select(*by, "src", "dst").distinct())
    done = None
    while free.limit(1).count():
        inside = edges.join(free.withColumnRenamed("node", "src"), [*by, "src"], "left_semi").join(free.withColumnRenamed("node", "dst"), [*by, "dst"], "left_semi")
        inside = checkpointed(inside)
        ahead = _least(inside, free, by, "src", "dst")
        back = _least(inside, free, by, "dst", "src")
        both = ahead.withColumnRenamed("label", "a").join(back.withColumnRenamed("label", "b"), [*by, "node"]).where("a = b").select(*by, "node", F.col("a").alias("component"))
        both = checkpointed(both)
        done = both if done is None else done.unionByName(both)
        free = checkpointed(free.join(both.select(*by, "node"), [*by, "node"], "left_anti"))
    return done if done is not None else free.withColumn("component", F.col("node"))


def _least(edges: DataFrame, nodes: DataFrame, by: list[str], tail: str, head: str) -> DataFrame:
    """The least label that reaches each node along edges tail -> head, its own included."""
    labels = checkpointed(nodes.withColumn("label", F.col("node")))
    while True:
        offered = labels.select(*by, F.col("node").alias(tail), "label").join(edges, [*by, tail]).select(*by, F.col(head).alias("node"), "label")
        new = checkpointed(labels.unionByName(offered).groupBy(*by, "node").agg(F.min("label").alias("label")))
        if not new.join(labels, [*by, "node", "label"], "left_anti").limit(1).count():
            return new
        labels = new


def complexity(edges: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, complexity, level): E - N + 2 P with all destinations in E and strong components in P."""
    from cairn.functions.columns import complexity_label

    e = edges.groupBy(*by).agg(F.count(F.lit(1)).alias("e"))
    n = nodes.select(*by, "node").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    p = strong_components(edges, nodes, by).groupBy(*by).agg(F.count_distinct("component").alias("p"))
    out = n.join(p, by).join(e, by, "left").withColumn("complexity", F.coalesce("e", F.lit(0)) - F.col("n") + 2 * F.col("p"))
    return out.select(*by, "complexity", complexity_label(F.col("complexity")).alias("level"))


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Callers and callees of each node, and whether it is an entry point or a leaf."""
    out_ = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("callees"))
    in_ = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("callers"))
    both = nodes.select("node").distinct().join(out_, "node", "left").join(in_, "node", "left").na.fill(0, ["callees", "callers"])
    return both.select("node", "callers", "callees", (F.col("callers") == 0).alias("is_entry_point"), (F.col("callees") == 0).alias("is_leaf"))


def path_counts(edges: DataFrame, by: list[str], start: DataFrame, end: int, depth: int) -> DataFrame:
    """(by, paths): how many paths of at most depth steps lead from start to the end node; repeated edges are one."""
    once = edges.select(*by, "src", "dst").distinct()
    at = start.select(*by, "node").withColumn("paths", F.lit(1).cast("decimal(38,0)"))
    total = None
    for _ in range(depth):
        at = at.select(*by, F.col("node").alias("src"), "paths").join(once, [*by, "src"]).groupBy(*by, F.col("dst").alias("node")).agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))
        hit = at.where(F.col("node") == end).select(*by, "paths")
        total = hit if total is None else total.unionByName(hit)
    if total is None:  # no steps: the paths of length nought don't count
        return at.select(*by, "paths").limit(0).withColumn("paths", F.col("paths").cast("long"))
    return total.groupBy(*by).agg(F.sum("paths").cast("long").alias("paths"))


def sibling_kinds(edges: DataFrame, kinds: DataFrame) -> DataFrame:
    """(x, y, n): how many unordered pairs of callees of one function have the kinds x and y (x no later than y), over all functions. kinds is (node, kind), a kind for each node.

    A function's callees are counted by kind first, so a hub makes a row for each two kinds among its callees, however many callees it has.
    """
    of = kinds.select(F.col("node").alias("dst"), "kind")
    held = checkpointed(edges.select("src", "dst").distinct().join(of, "dst").groupBy("src", "kind").agg(F.count(F.lit(1)).alias("c")))
    other = held.select("src", F.col("kind").alias("y"), F.col("c").alias("d"))
    both = held.withColumnRenamed("kind", "x").join(other, "src").where("x <= y")
    pairs = F.when(F.col("x") == F.col("y"), F.col("c") * (F.col("c") - 1) / 2).otherwise(F.col("c") * F.col("d"))
    return both.groupBy("x", "y").agg(F.sum(pairs.cast("long")).alias("n")).where("n > 0")


def sibling_pairs(edges: DataFrame) -> DataFrame:
    """(src, a, b): the unordered pairs of callees of one function."""
    once = edges.select("src", "dst").distinct()
    return once.select("src", F.col("dst").alias("a")).join(once.select("src", F.col("dst").alias("b")), "src").where("a < b")


def edge_counts(edges: DataFrame, by: str) -> DataFrame:
    """(by, edges, nodes) of many graphs; repeated edges are one."""
    end = lambda column, n: F.struct(F.col(column).alias("node"), F.lit(n).alias("edge"))
    each = edges.select(by, "src", "dst").distinct().select(by, F.explode(F.array(end("src", 1), end("dst", 0))).alias("x"))
    nodes = each.groupBy(by, F.col("x.node").alias("node")).agg(F.sum("x.edge").alias("edges"))
    return nodes.groupBy(by).agg(F.sum("edges").alias("edges"), F.count("node").alias("nodes"))


#: A graph of so many nodes at most is taken as a matrix.
MATRIX_NODES = 512


def betweenness(edges: DataFrame, by: str) -> DataFrame:
    """(by, nodes, edges, mean_betweenness) of many small graphs, each within one task, by Brandes' accumulation: as a matrix, from all nodes at once, where there are few."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        n = len(nodes)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        total = _between_matrix(np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"]), n) if n <= MATRIX_NODES else _between_walks(pdf, nodes.tolist())
        return pd.DataFrame({by: [pdf[by].iloc[0]], "nodes": [n], "edges": [len(pdf)], "mean_betweenness": [total * scale / n]})

    kind = edges.schema[by].dataType.simpleString()
    return edges.select(by, "src", "dst").distinct().groupBy(by).applyInPandas(run, f"{by} {kind}, nodes long, edges long, mean_betweenness double")


def _between_matrix(src: np.ndarray, dst: np.ndarray, n: int) -> float:
    """The sum of all nodes' betweenness; rows are starts, and a level has the numbers of shortest paths to the nodes that are so far away."""
    ahead = np.zeros((n, n))
    ahead[src, dst] = 1
    front = np.eye(n)
    seen, levels = front > 0, [front]
    while True:
        front = front @ ahead
        front[seen] = 0
        if not front.any():
            break
        seen |= front > 0
        levels.append(front)
    credit = np.zeros((n, n))
    for far in range(len(levels) - 1, 0, -1):
        share = np.divide(1 + credit, levels[far], out=np.zeros((n, n)), where=levels[far] > 0)
        credit += (share @ ahead.T) * levels[far - 1]
    return float(credit.sum() - np.trace(credit))


def _between_walks(pdf: pd.DataFrame, nodes: list) -> float:
    """The same by a walk from each node."""
    after: dict = {n: sorted(set(g)) for n, g in pdf.groupby("src")["dst"]}
    out = 0.0
    for s in nodes:
        order, before, paths, far = [], {n: [] for n in nodes}, dict.fromkeys(nodes, 0), {s: 0}
        paths[s], queue = 1, [s]
        for v in queue:
            order.append(v)
            for w in after.get(v, ()):
                if w not in far:
                    far[w] = far[v] + 1
                    queue.append(w)
                if far[w] == far[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        credit = dict.fromkeys(nodes, 0.0)
        for w in reversed(order):
            for v in before[w]:
                credit[v] += paths[v] / paths[w] * (1 + credit[w])
            if w != s:
                out += credit[w]
    return out
