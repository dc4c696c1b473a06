import random
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from dayfold.operators import calibration as C


def slow_isotonic(points):
    """points: {p: (n, s)} -> {p: value}, the largest over starts of the smallest over ends of the means between."""
    ps = sorted(points)
    n, s = ([0, *accumulate(points[p][k] for p in ps)] for k in (0, 1))
    least = []  # of each start: the smallest mean to an end at or after i
    for a in range(len(ps)):
        means = [(s[b + 1] - s[a]) / (n[b + 1] - n[a]) for b in range(a, len(ps))]
        least.append(list(accumulate(reversed(means), min))[::-1])
    return {p: max(least[a][i - a] for a in range(i + 1)) for i, p in enumerate(ps)}


def slow_predict(fit, p):
    ps = sorted(fit)
    if p <= ps[0] or p >= ps[-1]:
        return fit[ps[0] if p <= ps[0] else ps[-1]]
    hi = next(x for x in ps if x >= p)
    lo = max(x for x in ps if x <= p)
    return fit[lo] if lo == hi else fit[lo] + (p - lo) / (hi - lo) * (fit[hi] - fit[lo])


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(1)
    rows = []
    for target in ("a", "b"):
        for i in range(400):
            p = round(rng.random() if i % 3 else rng.choice([0.2, 0.5, 0.50001]), 4)
            rows.append((target, i, i % 5, int(rng.random() < 0.2 + 0.6 * p), min(max(p, 1e-6), 1 - 1e-6)))
    rows += [("few", i, i % 5, i % 2, 0.1 * i + 0.05) for i in range(8)] + [("one", i, i % 5, 1, 0.01 * i + 0.05) for i in range(40)]
    rows += [("a", 900, 0, None, 0.4), ("a", 901, 1, 1, None)]
    return rows, spark.createDataFrame(rows, "target string, id int, fold_id int, y int, p double").repartition(5)


def test_isotonic_out_of_fold(scores):
    rows, df = scores
    got = {(r.target, r.id): r.p for r in C.isotonic_out_of_fold(df, list(range(5))).collect()}
    assert len(got) == len(rows)
    for target in ("a", "b", "few", "one"):
        for held in range(5):
            points = {}
            for t, _, f, y, p in rows:
                if t == target and f != held and y is not None and p is not None:
                    n, s = points.get(p, (0, 0))
                    points[p] = (n + 1, s + y)
            fit = slow_isotonic(points) if target in ("a", "b") else None
            for t, i, f, _, p in rows:
                if t == target and f == held and p is not None:
                    want = p if fit is None else min(max(slow_predict(fit, p), 1e-6), 1 - 1e-6)
                    assert got[t, i] == pytest.approx(want, abs=1e-9), (t, i)


def test_blocks_do_not_depend_on_ranges(spark, scores):
    _, df = scores
    counts = C.score_counts(df, ["target"])
    few = {tuple(r) for r in C.isotonic_blocks(counts, ["target"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        many = {tuple(r) for r in C.isotonic_blocks(counts, ["target"]).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert few == many and {r[0] for r in few} == {"a", "b"}


def test_platt_reaches_the_minimum(scores):
    """At the fitted values the gradient of the penalised loss is zero."""
    _, df = scores
    counts = C.score_counts(df, ["target"])
    fits = C.platt_fits(counts, ["target"])
    assert {r.target for r in fits.collect()} == {"a", "b", "few"}
    z = counts.withColumn("z", F.ln(F.col("p") / (1 - F.col("p")))).join(fits, "target")
    e = F.col("n") / (1 + F.exp(-F.col("slope") * F.col("z") - F.col("offset"))) - F.col("s")
    for r in z.groupBy("target", "slope").agg(F.sum(e).alias("g0"), F.sum(e * F.col("z")).alias("g1")).collect():
        assert abs(r.g0) < 1e-9 and abs(r.g1 + r.slope) < 1e-9
    one = C.platt_out_of_fold(df, list(range(5))).where("target = 'one'").join(df.select("target", "id", F.col("p").alias("q")), ["target", "id"])
    assert one.where("abs(p - q) > 1e-12").count() == 0


def test_no_rows(scores):
    _, df = scores
    assert C.isotonic_out_of_fold(df.limit(0), [0, 1]).count() == 0 and C.platt_out_of_fold(df.limit(0), [0, 1]).count() == 0
