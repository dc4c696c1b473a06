"""Runs, transitions, differences, quantiles and ranks against brute force, with tiny slices."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayfold.operators.quantiles import COARSE, FINE, exact_quantiles, value_bucket
from dayfold.operators.ranking import key_digest, rank_in_group
from dayfold.operators.runs import run_statistics, slice_summaries, successive_differences, transition_count


def brute_runs(flags):
    episodes = longest = current = 0
    for f in flags:
        current = current + 1 if f else 0
        episodes += current == 1
        longest = max(longest, current)
    return episodes, longest


@pytest.mark.parametrize("share", [0.0, 0.2, 0.9, 1.0])
def test_runs_over_slices(spark, share):
    rng = random.Random(int(share * 10))
    data = {g: [int(rng.random() < share) for _ in range(n)] for g, n in (("hot", 400), ("one", 1), ("few", 7))}
    rows = [(g, i, f) for g, fs in data.items() for i, f in enumerate(fs)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, f int")
    piece = F.floor(F.col("i") / 5)
    slices = slice_summaries(df, ["g"], F.col("f"), [F.col("i")], piece)
    runs = run_statistics(slices, ["g"], "e", "l")
    got = {r["g"]: (r["e"], r["l"]) for r in runs.collect()}
    assert got == {g: brute_runs(fs) for g, fs in data.items()}
    moves = transition_count(slices, ["g"], "t")
    assert {r["g"]: r["t"] for r in moves.collect()} == {
        g: sum(a != b for a, b in zip(fs, fs[1:])) for g, fs in data.items()}


def test_differences_over_slices(spark):
    rng = random.Random(5)
    values = [rng.uniform(40, 120) for _ in range(200)]
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate(values)], "g string, i int, v double")
    row = successive_differences(df, ["g"], F.col("v"), [F.col("i")], F.floor(F.col("i") / 7), 10.0).first()
    d = np.diff(values)
    assert row["diff_cnt"] == len(d) and row["diff_jumps"] == int((abs(d) >= 10).sum())
    assert row["diff_sq"] == pytest.approx(float((d * d).sum()))


def test_quantiles(spark):
    rng = random.Random(1)
    groups = {
        "wide": [rng.gauss(0, 50) for _ in range(501)], "ties": [float(rng.randint(-2, 2)) for _ in range(300)],
        "one": [3.5], "two": [-1.0, 2.0], "big": [rng.lognormvariate(3, 2) for _ in range(1000)], "zero": [0.0, -0.0, 0.0],
        "share": [rng.random() for _ in range(2000)], "tiny": [rng.random() * 1e-300 for _ in range(50)], "huge": [-1e300, 1e300, 5e-324],
        "close": [1.0 + i * 2.0 ** -50 for i in range(40)], "powers": [2.0 ** k for k in range(-60, 60)],
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("two", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    names = {"q0": 0.0, "q10": 0.1, "q50": 0.5, "q90": 0.9, "q100": 1.0}
    got = exact_quantiles(df, ["g"], F.col("v"), names).collect()
    assert {r["g"] for r in got} == set(groups)
    for r in got:
        for name, q in names.items():
            assert r[name] == pytest.approx(float(np.quantile(groups[r["g"]], q)), rel=1e-12, abs=0), (r["g"], name)


@pytest.mark.parametrize("steps", [COARSE, FINE])
def test_buckets_keep_the_order(spark, steps):
    rng = random.Random(2)
    values = [s * b * 2.0 ** k for k in range(-1070, 1000, 7) for b in (1.0, 1 - 2.0 ** -53, 1 + 2.0 ** -52, rng.random() + 0.5) for s in (-1, 1)] + [0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket(F.col("v"), steps).alias("b"))
    found = [r["b"] for r in sorted(df.collect(), key=lambda r: r["v"])]
    assert found == sorted(found)


def test_one_group_of_shares_spreads(spark):
    """All values in [0, 1] in one group: no bucket that is ordered in one task holds more than a sliver."""
    rows = spark.range(100_000).select(F.rand(1).alias("v"))
    for steps, most in ((COARSE, 400), (FINE, 10)):
        assert rows.groupBy(value_bucket(F.col("v"), steps)).count().agg(F.max("count")).first()[0] < most


def test_rank_in_group_is_global_order(spark):
    df = spark.range(3000).select(F.lit("hot").alias("g"), F.col("id"))
    df = df.withColumn("digest", key_digest("id", seed=3))
    rows = rank_in_group(df, ["g"], "digest", "r", digits=1).orderBy("digest").collect()
    assert [r["r"] for r in rows] == list(range(3000))
