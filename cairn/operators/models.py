"""Statistical models over feature tables."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.graph import _least, checkpointed
from cairn.operators.joins import numbered
from cairn.operators.sets import running


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=columns, outputCol="features").transform(df.na.drop(subset=columns))


def survival(df: DataFrame, time: str, event: str, columns: list[str]) -> DataFrame:
    """(term, coefficient) of an accelerated failure time model; event 1 is observed, 0 censored. Not a Cox model: coefficients act on log time."""
    from pyspark.ml.regression import AFTSurvivalRegression

    model = AFTSurvivalRegression(labelCol=time, censorCol=event, maxIter=20).fit(_vectors(df, columns))
    rows = [(c, float(v)) for c, v in zip(columns, model.coefficients, strict=True)] + [("intercept", float(model.intercept)), ("scale", float(model.scale))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def cox(df: DataFrame, time: str, event: str, columns: list[str], most_steps: int = 30) -> DataFrame:
    """(term, coefficient, error) of Cox's proportional hazards model: hazards multiply by exp(coefficient) for each unit of a column; event 1 is observed, others are censored.

    Newton steps on the partial likelihood, ties by Efron's method. A step sums each time's rows, so ties cost no pairs; running totals from the longest time
    down give the sums over those still at risk. Of these only the gradient and the matrix of second derivatives, columns times columns, come to the driver. A step that
    lowers the likelihood is halved. Rows with a null are left out; no events, or a column without variation, are an error.
    """
    k = range(len(columns))
    known = df.select(F.col(time).cast("double").alias("t"), (F.col(event) == 1).alias("e"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)]).na.drop()
    known = checkpointed(known)
    means = known.agg(*[F.avg(f"x{i}") for i in k], F.count_if("e")).first()
    if not means[-1]:
        raise ValueError("no events")
    rows = known.select("t", "e", *[(F.col(f"x{i}") - means[i]).alias(f"x{i}") for i in k])
    products = [(i, j) for i in k for j in k if i <= j]
    names = ["w", *[f"w{i}" for i in k], *[f"w{i}_{j}" for i, j in products]]

    def derivatives(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        score = sum((F.col(f"x{i}") * float(beta[i]) for i in k), F.lit(0.0))
        weighed = rows.withColumn("s", score).withColumn("w", F.exp("s"))
        sums = {"w": F.col("w")} | {f"w{i}": F.col("w") * F.col(f"x{i}") for i in k} | {f"w{i}_{j}": F.col("w") * F.col(f"x{i}") * F.col(f"x{j}") for i, j in products}
        died = lambda x: F.sum(F.when(F.col("e"), x).otherwise(0.0))
        at = weighed.groupBy((-F.col("t")).alias("o")).agg(*[F.sum(x).alias(n) for n, x in sums.items()], *[died(x).alias(f"d{n}") for n, x in sums.items()], F.count_if("e").alias("d"), died(F.col("s")).alias("ds"), *[died(F.col(f"x{i}")).alias(f"dx{i}") for i in k])
        risk = running(at, [], "o", {f"r{n}": n for n in names}).where("d > 0")
        # Efron: of d tied deaths, the l-th sees the shares l / d of those who die taken from the risk.
        each = risk.withColumn("l", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d") - 1))).withColumn("c", F.col("l") / F.col("d"))
        left = {n: F.col(f"r{n}") - F.col("c") * F.col(f"d{n}") for n in names}
        first = lambda x: F.sum(F.when(F.col("l") == 0, x).otherwise(0.0))
        mean = [left[f"w{i}"] / left["w"] for i in k]
        got = each.agg(first(F.col("ds")).alias("a"), F.sum(F.log(left["w"])).alias("b"), *[first(F.col(f"dx{i}")) for i in k], *[F.sum(m) for m in mean], *[F.sum(left[f"w{i}_{j}"] / left["w"] - mean[i] * mean[j]) for i, j in products]).first()
        n = len(columns)
        slope = np.array(got[2 : 2 + n]) - np.array(got[2 + n : 2 + 2 * n])
        curve = np.zeros((n, n))
        for (i, j), v in zip(products, got[2 + 2 * n :], strict=True):
            curve[i, j] = curve[j, i] = v
        return got[0] - got[1], slope, curve

    beta = np.zeros(len(columns))
    value, slope, curve = derivatives(beta)
    for _ in range(most_steps):
        step = np.linalg.solve(curve, slope)
        while True:
            new = derivatives(beta + step)
            if new[0] >= value - 1e-9 * abs(value) or np.abs(step).max() < 1e-12:
                break
            step = step / 2
        beta, (value, slope, curve) = beta + step, new
        if np.abs(step).max() < 1e-9 * max(1.0, np.abs(beta).max()):
            break
    errors = np.sqrt(np.diag(np.linalg.inv(curve)))
    return df.sparkSession.createDataFrame([(c, float(b), float(s)) for c, b, s in zip(columns, beta, errors, strict=True)], "term string, coefficient double, error double")


def hazard(df: DataFrame, fit: DataFrame, name: str = "hazard") -> DataFrame:
    """df with the log hazard that a cox() fit gives each row; its terms are columns of df."""
    terms = {r.term: r.coefficient for r in fit.collect()}  # a row for each column
    return df.withColumn(name, sum((F.col(c) * v for c, v in terms.items()), F.lit(0.0)))


def concordance(df: DataFrame, time: str, event: str, predicted: str) -> DataFrame:
    """Share of comparable pairs in the right order, ties half: where an observed time is shorter, the prediction should be, too.

    No pair is made. The places of two times in their order share their upper bits down to one where the shorter time has 0
    and the longer 1; so each row goes into one group for every bit, and running totals along the predictions of a group
    count the pairs that part there. A null time is in no pair; a null prediction is in pairs, but never in the right order.
    """
    counts = df.where(F.col(time).isNotNull()).groupBy(F.col(time).alias("t"), (F.col(event) == 1).alias("e"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)
    places = numbered(counts.select("t").distinct(), ["t"], "place")
    bits = int(places.agg(F.max("place")).first()[0] or 1).bit_length()
    rows = counts.join(places, "t").select("e", "p", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("bit"))
    upper = rows.withColumn("longer", F.expr("shiftright(place, bit) & 1") == 1).withColumn("upper", F.expr("shiftright(place, bit + 1)"))
    short, long = F.when(~F.col("longer") & F.col("e"), F.col("n")).otherwise(0), F.when(F.col("longer"), F.col("n")).otherwise(0)
    sides = checkpointed(upper.groupBy("bit", "upper", "p").agg(F.sum(short).alias("short"), F.sum(long).alias("long")))
    pairs = sides.groupBy("bit", "upper").agg((F.sum("short").cast("double") * F.sum("long")).alias("pairs")).agg(F.sum("pairs").alias("pairs"))
    along = running(sides.where("p IS NOT NULL"), ["bit", "upper"], "p", {"so_far": "short"})
    right = along.agg(F.sum(F.col("long") * (F.col("so_far") - F.col("short") / 2)).alias("right"))
    both = pairs.unionByName(right, allowMissingColumns=True).agg(F.max("pairs").alias("pairs"), F.coalesce(F.max("right"), F.lit(0.0)).alias("right"))
    some = F.when(F.col("pairs") > 0, F.col("pairs"))
    return both.select(F.round(F.col("right") / some, 6).alias("concordance"), some.cast("long").alias("pairs"))


def density_clusters(points: DataFrame, columns: list[str], eps: float, least: int, key: str = "id") -> DataFrame:
    """(key, cluster): clusters of points within eps of a core point, which has `least` of them with itself; null for noise, and for points with a null.

    Cells of width eps / sqrt(dimensions) hold only points within eps of each other, so all points of a cell with `least` of them are core points, and all core points of a cell are in one
    cluster: no pairs are made within a cell. Only points of other cells, fewer than `least` a cell, meet the points around them. Whether core points of two neighbouring cells are
    within eps is found by halving both cells as long as some point of either half might be near (see _touching). A cluster's number is its smallest core point's key; a border point goes to the smallest cluster near. Keys are unique.
    """
    d = len(columns)
    width = eps / d**0.5 * (1 - 1e-9)
    reach = int(eps / width) + 1
    near = [o for o in product(range(-reach, reach + 1), repeat=d) if sum(max(abs(x) - 1, 0) ** 2 for x in o) * width**2 <= eps**2]
    g, x = [f"g{i}" for i in range(d)], [f"x{i}" for i in range(d)]
    whole = points.na.drop(subset=[key, *columns])
    base = checkpointed(whole.select(F.col(key).alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(columns, x, strict=True)], *[F.floor(F.col(c) / width).cast("long").alias(n) for c, n in zip(columns, g, strict=True)]))
    crowded = base.groupBy(*g).agg((F.count(F.lit(1)) >= least).alias("full"))
    base = checkpointed(base.join(crowded, g))

    def around(some: DataFrame, others: DataFrame) -> DataFrame:
        """(id, other columns) of points of some with those of others, in cells near by, that are within eps."""
        offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in near])
        moved = some.select("id", *[F.col(n).alias(f"a_{n}") for n in x], *g, F.explode(offsets).alias("o"))
        moved = moved.select("id", *[f"a_{n}" for n in x], *[(F.col(n) + F.col("o")[i]).alias(n) for i, n in enumerate(g)])
        distance = sum((F.col(f"a_{n}") - F.col(n)) ** 2 for n in x)
        return moved.join(others, g).where(distance <= eps * eps)

    lone = base.where("NOT full")
    found = around(lone, base.drop("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    core = checkpointed(base.where("full").unionByName(lone.join(found, "id", "left_semi")).drop("full"))
    cells = checkpointed(core.groupBy(*g).agg(F.min("id").alias("node")))
    half = F.array(*[F.array(*[F.lit(v) for v in o]) for o in near if o > (0,) * d])
    moved = cells.select(F.col("node").alias("a"), *[F.col(n).alias(f"a_{n}") for n in g], F.explode(half).alias("o")).withColumns({n: F.col(f"a_{n}") + F.col("o")[i] for i, n in enumerate(g)})
    pairs = moved.join(cells.withColumnRenamed("node", "b"), g).select("a", "b", *[f"a_{n}" for n in g], *[F.col(n).alias(f"b_{n}") for n in g])
    edges = _touching(checkpointed(pairs), core, width, eps, d)
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = _least(both, cells.select("node"), [], "a", "b")
    named = cells.join(labels, "node").select(*g, "label")
    inner = core.join(named, g).select("id", F.col("label").alias("cluster"))
    border = around(lone.join(core.select("id"), "id", "left_anti"), core.join(named, g).select(*x, *g, "label")).groupBy("id").agg(F.min("label").alias("cluster"))
    return points.select(key).join(inner.unionByName(border).withColumnRenamed("id", key), key, "left").select(key, "cluster")


def _touching(pairs: DataFrame, core: DataFrame, width: float, eps: float, d: int, most_levels: int = 40) -> DataFrame:
    """(a, b) of the pairs of cells of which some core points are within eps.

    pairs is (a, b, a_g0.., b_g0..). A part of a cell is known by one of its points: if those of two parts are within eps, the cells touch; parts that are further apart than eps are dropped; the
    others are halved along each side, and only halves with points go on. Parts with one place each are decided. After most_levels halvings a part is a point for all purposes.
    """
    g, x = [f"g{i}" for i in range(d)], [f"x{i}" for i in range(d)]
    out = None
    for level in range(most_levels + 1):
        size = width / 2**level
        place = [F.floor(F.col(n) / size).cast("long").alias(m) for n, m in zip(x, g, strict=True)]
        parts = core.select(*place, F.struct(*x).alias("p")).groupBy(*g).agg(F.min("p").alias("p"), (F.min("p") == F.max("p")).alias("one"))
        side = lambda s, parts=parts: parts.select(*[F.col(n).alias(f"{s}_{n}") for n in g], F.col("p").alias(f"{s}_p"), F.col("one").alias(f"{s}_one"))
        if level:  # halves of the parts that are left
            up = lambda s: [F.shiftright(F.col(f"{s}_{n}"), 1).alias(f"{s}_up{n}") for n in g]
            for s in "ab":
                pairs = pairs.join(side(s).select("*", *up(s)), [f"{s}_up{n}" for n in g])
        else:
            for s in "ab":
                pairs = pairs.join(side(s), [f"{s}_{n}" for n in g])
        apart = sum((F.greatest(F.abs(F.col(f"a_{n}") - F.col(f"b_{n}")) - 1, F.lit(0)).cast("double") * size) ** 2 for n in g)
        distance = sum((F.col(f"a_p.{n}") - F.col(f"b_p.{n}")) ** 2 for n in x)
        seen = checkpointed(pairs.where(apart <= eps * eps * (1 + 1e-9)).withColumn("near", distance <= eps * eps))
        found = seen.where("near").select("a", "b").distinct()
        out = found if out is None else out.unionByName(found)
        left = seen.where("NOT near AND NOT (a_one AND b_one)").join(found, ["a", "b"], "left_anti")
        pairs = checkpointed(left.select("a", "b", *[F.col(f"{s}_{n}").alias(f"{s}_up{n}") for s in "ab" for n in g]))
        if not pairs.limit(1).count():
            break
    return out


def principal_components(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(component, variance) shares of the k principal components."""
    from pyspark.ml.feature import PCA

    model = PCA(k=k, inputCol="features", outputCol="pca").fit(_vectors(df, columns))
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(model.explainedVariance)], "component int, variance double")


def line(df: DataFrame, y: str, x: str) -> DataFrame:
    """Slope and intercept of least squares in one variable."""
    return df.agg(F.round(F.regr_slope(y, x), 6).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"))


def linear(df: DataFrame, y: str, columns: list[str]) -> DataFrame:
    from pyspark.ml.regression import LinearRegression

    model = LinearRegression(labelCol=y, solver="normal").fit(_vectors(df, columns))
    rows = [(c, round(float(v), 6)) for c, v in zip(columns, model.coefficients, strict=True)] + [("intercept", round(float(model.intercept), 6))]
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double")


def rolled_up(edges: DataFrame, predictions: DataFrame) -> DataFrame:
    """(node, own, callees_time): a function's predicted time and the sum over its direct callees."""
    of = predictions.select(F.col("node").alias("dst"), F.col("time").alias("t"))
    below = edges.select("src", "dst").distinct().join(of, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("t").alias("callees_time"))
    return predictions.join(below, "node", "left").select("node", F.round("time", 6).alias("own"), F.round(F.coalesce("callees_time", F.lit(0.0)), 6).alias("callees_time"))


def ranked_in(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))
