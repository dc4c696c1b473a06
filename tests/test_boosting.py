"""Early-stopped fits and ordered statistics on small frames."""

import random
from datetime import date, timedelta

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from dayfold.operators import boosting as B
from dayfold.operators import ordered as O
from dayfold.schema import KEYS

D0 = date(2024, 1, 1)
LABELS = "subject_id string, sleep_date date, lifelog_date date, target string, y int, fold_id int"


def key(s, i):
    return f"s{s}", D0 + timedelta(days=i + 1), D0 + timedelta(days=i)


@pytest.fixture(scope="module")
def fitted(spark):
    """Two targets of 240 training and 40 test rows: A follows x (missing means 1), B is noise."""
    rng = random.Random(2)
    rows, folds = [], []
    for s in range(7):
        for i in range(40):
            x = None if rng.random() < 0.3 else rng.random()
            a, b = int(x is None or x > 0.6), rng.randint(0, 1)
            split = "test" if s == 6 else "train"
            rows.append((*key(s, i), split, a if split == "train" else None, b if split == "train" and i else None, x, rng.random()))
            folds += [(*key(s, i), t, 1, rng.randrange(3)) for t in "AB" if split == "train"]
    schema = "subject_id string, sleep_date date, lifelog_date date, split string, A int, B int, x double, z double"
    frame = spark.createDataFrame(rows, schema)
    manifest = spark.createDataFrame(folds, "subject_id string, sleep_date date, lifelog_date date, target string, seed int, fold_id int")
    settings = {t: {"maxDepth": 2, "stepSize": 0.3, "validationTol": 0.02, "minInstancesPerNode": 5} for t in "AB"}
    predictions, fits, gains = B.early_stopped_trees(frame, manifest, {"A": ["x"], "B": ["x", "z"]}, [1], settings)
    return predictions.cache(), fits.cache(), gains


def test_each_row_is_predicted_by_its_own_folds(fitted):
    predictions, fits, _ = fitted
    assert fits.count() == 6 and fits.where(f"trees >= {B.MOST_ROUNDS}").count() == 0
    counts = predictions.groupBy("target", "split", *KEYS).count()
    assert {(r.target, r.split, r["count"], r.n) for r in counts.groupBy("target", "split", "count").agg(F.count("*").alias("n")).collect()} == {
        ("A", "train", 1, 240), ("B", "train", 1, 234), ("A", "test", 3, 40), ("B", "test", 3, 40)}


def test_missing_is_not_zero_and_noise_stops_early(fitted):
    predictions, fits, gains = fitted
    loss = predictions.where("split = 'train'").groupBy("target").agg(F.avg(-F.col("y") * F.ln("p") - (1 - F.col("y")) * F.ln(1 - F.col("p"))).alias("loss"))
    loss = {r.target: r.loss for r in loss.collect()}
    assert loss["A"] < 0.2 and loss["B"] < 0.8
    trees = {r.target: r.trees for r in fits.groupBy("target").agg(F.avg("trees").alias("trees")).collect()}
    assert trees["B"] < trees["A"]
    assert {r.feature for r in gains.where("target = 'A'").select("feature").distinct().collect()} == {"x"}


def slow_ordered(rows, folds, m, permutations):
    from hashlib import md5

    out = {}
    for held in range(folds):
        train = [r for r in rows if r[5] != held]
        mean = sum(r[4] for r in train) / len(train)
        for r in rows:
            values = []
            for p in range(permutations):
                digest = lambda x: md5(f"{p}|{x[3]}|{x[0]}|{x[1]}|{x[2]}".encode()).hexdigest()
                seen = [x for x in train if x[0] == r[0] and (r[5] == held or digest(x) < digest(r))]
                values.append((sum(x[4] for x in seen) + m * mean) / (len(seen) + m))
            out[r[:3] + (held,)] = sum(values) / permutations
    return out


def test_ordered_statistics_by_definition(spark):
    rng = random.Random(3)
    rows = [(*key(s, i), "Q1", rng.randint(0, 1), rng.randrange(3)) for s, n in ((0, 60), (1, 3), (2, 1)) for i in range(n)]
    got = O.ordered_statistics(spark.createDataFrame(rows, LABELS), 3, m=2.0)
    want = slow_ordered(rows, 3, 2.0, O.PERMUTATIONS)
    assert got.count() == len(rows)
    for r in got.collect():
        for h in range(3):
            assert r[f"held_{h}"] == pytest.approx(want[r.subject_id, r.sleep_date, r.lifelog_date, h])
    only = O.category_statistics(spark.createDataFrame(rows, LABELS), 3, m=2.0).where("subject_id = 's2'").first()
    mine = next(r for r in rows if r[0] == "s2")
    assert only[f"held_{mine[5]}"] == pytest.approx(want[mine[:3] + (mine[5],)])
    assert O.ordered_statistics(spark.createDataFrame([], LABELS), 2).count() == 0


def test_fits_keep_the_cores_busy(spark, monkeypatch):
    """A fit of as many tasks as there are cores, or more, is not alone; fits of one task are as many as cores."""
    sizes, pool = [], B.ThreadPool
    monkeypatch.setattr(B, "ThreadPool", lambda n: sizes.append(n) or pool(n))
    monkeypatch.setattr(B, "TASK_ROWS", 1)
    rows = [(*key(0, i), "train", i % 2, float(i)) for i in range(20)]
    frame = spark.createDataFrame(rows, "subject_id string, sleep_date date, lifelog_date date, split string, A int, x double")
    none = spark.createDataFrame([], "subject_id string, sleep_date date, lifelog_date date, target string, seed int, fold_id int")
    with pytest.raises(AnalysisException):  # nothing is fitted, so there are no predictions to read
        B.early_stopped_trees(frame, none, {"A": ["x"]}, [1], {})[0].collect()
    assert sizes == [2]
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    assert [B.fits_at_a_time(*x) for x in ((6, 0), (6, 50), (6, 51), (6, 600), (600, 6000))] == [6, 6, 3, 2, 5]
