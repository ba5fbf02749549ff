import random

import numpy as np

from cairn.llm import importance as im
from cairn.llm.common import written


def corpus(rnd, n=400):
    good = ["the cat sat on a mat and looked at birds".split(), "rain fell over hills while people walked home".split()]
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = [rnd.choice(rnd.choice(good)) + ("$$$" if bad else "") for _ in range(rnd.randrange(20, 80))]
        rows.append((i, " ".join(words), "x"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(random.Random(1))
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    out = im.resample(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    kept = {r.doc_id: r.kept for r in out.collect()}
    held = [i for i in kept if i % 2]
    assert len(kept) == 400 and sum(kept[i] == (i % 5 != 0) for i in held) >= 0.97 * len(held)


def test_without_labels_all_stay(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, "")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in im.resample(df, none).collect()] == [True] * 4
    assert im.resample(df.limit(0), none).count() == 0
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id long, quality int")
    assert im.resample(df, odd).count() == 4


def test_raw_rows_that_are_gone_still_teach(spark):
    """A filter has taken out nearly all bad rows; models and cut come from the rows before it, so the bad ones that it left go."""
    rows, labels = corpus(random.Random(6))
    schema = "doc_id long, text string"
    raw = spark.createDataFrame([r[:2] for r in rows], schema)
    bad = set(range(5, 105, 10))
    left = [r[:2] for r in rows if r[0] % 5 or r[0] in bad]
    out = im.resample(spark.createDataFrame(left, schema), spark.createDataFrame(labels, "doc_id long, quality int"), raw=raw).collect()
    kept = {r.doc_id for r in out if r.kept}
    assert len(out) == len(left) and len(kept & bad) <= 2 and len(kept - bad) >= 0.95 * (len(left) - len(bad))


def test_kth_key_is_exact(spark):
    rnd = random.Random(3)
    values = [rnd.gauss(0, 1) for _ in range(3000)] + [1e9, -1e9, 5.0, 5.0, 5.0]
    table = written(spark.createDataFrame([(v,) for v in values], "gumbel_key double"), "t")
    ordered = sorted(values, reverse=True)
    for k in (1, 2, 4, 1500, len(values)):
        assert im.kth_key(table, k) == ordered[k - 1]
    assert im.kth_key(table, 0) is None


def test_gumbel_noise_samples_in_proportion(spark):
    """With equal weights the k largest keys are a plain random sample: its share in any part of the rows is k over n."""
    table = written(spark.range(20_000).selectExpr("id AS doc_id", "10L AS n_grams", "0.0D AS log_weight", "0.0D AS per_gram"), "t")
    import pyspark.sql.functions as F

    noise = -F.log(-F.log((F.pmod(F.xxhash64("doc_id", F.lit(im.SEED)), F.lit(1 << 52)) + 0.5) / float(1 << 52)))
    keyed = written(table.withColumn("gumbel_key", noise), "t")
    least = im.kth_key(keyed, 5000)
    shares = [r[1] for r in keyed.where(F.col("gumbel_key") >= least).groupBy((F.col("doc_id") / 2000).cast("int")).count().collect()]
    assert sum(shares) == 5000 and max(abs(np.array(shares) - 500)) < 100


def brute_models(rows, good):
    """Buckets counted one n-gram after the other."""
    import xxhash

    counts = np.zeros((2, im.BUCKETS))
    each = {}
    for i, (doc, text) in enumerate(rows):
        own = [xxhash.xxh64_intdigest(w) for w in (text or "").encode().split()]
        found = list(own)
        for a, b in zip(own, own[1:], strict=False):
            p = (a * 0x9E3779B97F4A7C15 + b) % (1 << 64)
            found.append(p ^ (p >> 29))
        each[i] = [x % im.BUCKETS for x in found]
        for x in each[i]:
            counts[1][x] += 1
            counts[0][x] += doc in good
    return counts, each


def test_models_weights_and_choice_against_brute_force(spark):
    import math

    rows, labels = corpus(random.Random(5), 300)
    rows = [(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "long " * 30_000), (3, rows[3][1])]
    good = {i for i, q in labels if q}
    (target, raw), each = brute_models(rows, good)
    df, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = im.models(df, known)
    assert (got[0] == target).all() and (got[1] == raw).all()
    smooth = lambda b: math.log((target[b] + (raw[b] + 1) / (raw.sum() + im.BUCKETS) * im.BUCKETS) / (target.sum() + im.BUCKETS) / ((raw[b] + 1) / (raw.sum() + im.BUCKETS)))
    out = im.resample(df, known, k=100, passage=4).collect()
    assert len(out) == len(rows)
    weight = {doc: (len(each[i]), sum(map(smooth, each[i]))) for i, (doc, _) in enumerate(rows)}
    for r in out:
        assert r.n_grams == weight[r.doc_id][0] and abs(r.log_weight - weight[r.doc_id][1]) < 1e-6 * max(1, abs(r.log_weight))
        assert r.per_gram == r.log_weight / max(1, r.n_grams)
    keys = sorted((r.gumbel_key for r in out), reverse=True)
    assert all(r.kept == (r.gumbel_key >= keys[99]) for r in out)
    noise = {r.doc_id: r.gumbel_key - 4 * r.per_gram for r in out}
    assert abs(np.mean(list(noise.values())) - 0.5772) < 0.2 and len(set(noise.values())) == len(noise)
    by_weight = sorted((r.per_gram for r in out), reverse=True)[99]
    assert sum(r.kept != (r.per_gram >= by_weight) for r in out) > 10  # noise decides where weights are close


def test_words_that_no_target_text_has_are_no_sign_against_a_text():
    target, raw = np.zeros(im.BUCKETS), np.zeros(im.BUCKETS)
    target[0], raw[:2] = 50_000, 100_000
    raw[2] = 1
    ratio = im.shrunk_ratio(target, raw)
    assert ratio[0] > 0 > ratio[1] and ratio[1] < -9
    assert abs(ratio[2]) < 0.5 and abs(ratio[3]) < 0.3
