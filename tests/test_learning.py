"""Fold properties, priors, neighbours, selection, guards, sinks."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dayfold.operators import blend as B
from dayfold.operators import folds as V
from dayfold.operators import guards as G
from dayfold.operators import models as M
from dayfold.operators import neighbours as NB
from dayfold.operators import priors as R
from dayfold.operators import scoring as SC
from dayfold.operators import selection as SE
from dayfold.schema import KEYS, TARGETS
from dayfold.session import scratch_path
from dayfold.sources import readers as RD
from dayfold.sources import sinks as K

D0 = date(2024, 1, 1)
LABELS = "subject_id string, sleep_date date, lifelog_date date, target string, y int"


def day(i):
    return D0 + timedelta(days=i)


def keys_frame(spark, sizes):
    rows = [(s, day(i + 1), day(i)) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "subject_id string, sleep_date date, lifelog_date date")


def labels_frame(spark, rows, target="Q1"):
    return spark.createDataFrame([(s, day(i + 1), day(i), target, y) for s, i, y in rows], LABELS)


def test_every_row_is_validated_once(spark):
    train = keys_frame(spark, {f"s{i}": 3 + i for i in range(12)})
    for folds in (V.group_folds(train, 4), V.within_subject_folds(train, 4)):
        assert folds.count() == train.count() == folds.select(*KEYS).distinct().count()
    groups = V.group_folds(train, 4)
    assert groups.groupBy("subject_id").agg(F.count_distinct("fold_id").alias("n")).where("n > 1").count() == 0
    sizes = [r["n"] for r in groups.groupBy("fold_id").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 14
    inside = V.within_subject_folds(train, 4).groupBy("subject_id", "fold_id").count()
    assert {r["count"] for r in inside.where("subject_id = 's11'").collect()} == {3, 4}


def test_forward_folds_never_look_ahead(spark):
    folds = V.forward_folds(keys_frame(spark, {"a": 3, "b": 10, "c": 4}), 3, 0.2).cache()
    assert folds.where("subject_id = 'a' AND role = 'valid'").count() == 0
    assert folds.where("subject_id = 'a'").count() == 9
    edges = folds.groupBy("subject_id", "fold_id").agg(
        F.max(F.when(F.col("role") == "train", F.col("lifelog_date"))).alias("t"),
        F.min(F.when(F.col("role") == "valid", F.col("lifelog_date"))).alias("v"))
    assert edges.where("t >= v").count() == 0
    assert folds.where("subject_id = 'c' AND role = 'valid'").groupBy("fold_id").count().count() == 3


def test_strata_are_balanced(spark):
    rows = [("s", i, int(i % 10 == 0)) for i in range(200)]
    folds = V.stratified_folds(labels_frame(spark, rows), 5, (1, 2))
    joined = folds.join(labels_frame(spark, rows), [*KEYS, "target"])
    counts = joined.groupBy("seed", "fold_id", "y").count().collect()
    assert {r["count"] for r in counts if r["y"] == 1} == {4} and {r["count"] for r in counts if r["y"] == 0} == {36}


def test_key_collision_prefers_unlabelled_row(spark):
    ddl = "subject_id string, sleep_date date, lifelog_date date, " + ", ".join(f"{t} int" for t in TARGETS) + ", split string"
    train = spark.createDataFrame([("s", day(1), day(0), *[1] * 7, "train"), ("s", day(2), day(1), *[0] * 7, "train")], ddl)
    test = spark.createDataFrame([("s", day(1), day(0), *[None] * 7, "test")], ddl)
    got = {r["lifelog_date"]: r["split"] for r in RD.key_frame(train, test).collect()}
    assert got == {day(0): "test", day(1): "train"}


def test_unseen_subject_gets_the_global_mean(spark):
    train = labels_frame(spark, [("a", 0, 1), ("a", 1, 0), ("a", 2, 1)])
    ask = labels_frame(spark, [("new", 0, None)])
    row = R.lookup_prior(ask, R.subject_priors(train), SC.global_means(train)).first()
    assert row["p"] == pytest.approx(2 / 3)


def test_half_life_prefers_recent_rows(spark):
    train = labels_frame(spark, [("a", 0, 0), ("a", 1, 0), ("a", 2, 1), ("b", 0, 0)])
    get = lambda h: {r["subject_id"]: r["prior"] for r in R.half_life_priors(train, 1.0, h).collect()}
    assert get(None)["a"] == pytest.approx((1 + 0.25) / 4)
    assert get(1.0)["a"] == pytest.approx((1 + 0.25) / (1 + 0.5 + 0.25 + 1))


def test_temporal_prior_day_zero_and_horizon(spark):
    labels = labels_frame(spark, [("a", 0, 1), ("a", 2, 0), ("a", 30, 1), ("b", 0, 0)])
    kernels = {NB.ALL: ("power", 2, 1.0)}
    own = {(r["subject_id"], r["lifelog_date"]): r["p"] for r in NB.temporal_prior(labels, labels, kernels, True).collect()}
    subject, mean = 2 / 3, 0.5
    mix = lambda local: 0.9 * local + 0.05 * subject + 0.05 * mean
    assert own[("a", day(0))] == pytest.approx(mix(0.0))          # only day 2 is near
    assert own[("a", day(30))] == pytest.approx(mix(subject))     # nothing near: subject mean
    ask = labels_frame(spark, [("a", 1, None), ("new", 0, None)])
    got = {r["subject_id"]: r["p"] for r in NB.temporal_prior(ask, labels, kernels, False).collect()}
    assert got["a"] == pytest.approx(mix(0.5)) and got["new"] == pytest.approx(mean)


def test_power_prior_falls_back_to_all_history(spark):
    labels = labels_frame(spark, [("a", 0, 1), ("a", 50, 0), ("b", 0, 1)])
    got = {(r["subject_id"], r["lifelog_date"]): r["p"] for r in NB.power_prior(labels, labels, 3, 1.0, 0.0).collect()}
    assert got[("a", day(0))] == pytest.approx(0.95 * 0.0 + 0.05 * 2 / 3)
    assert got[("b", day(0))] == pytest.approx(2 / 3)  # no other label at all


def test_history_ties_take_the_earlier_day(spark):
    labels = labels_frame(spark, [("a", 0, 1), ("a", 4, 0)])
    ask = labels_frame(spark, [("a", 2, None), ("new", 2, None)])
    rows = {r["subject_id"]: r for r in NB.target_history(ask, labels).collect()}
    a = rows["a"]
    assert (a["nearest_value"], a["nearest_days"], a["nearest_is_future"]) == (1.0, 2.0, 0.0)
    assert (a["prev1_value"], a["next1_days"], a["prev2_value"], a["prev_next_same"]) == (1.0, 2.0, None, 0.0)
    assert (a["past3_count"], a["future3_mean"]) == (1.0, 0.0)
    assert rows["new"]["prior_count"] is None and rows["new"]["nearest_days"] is None


def test_correlation_of_constants_is_zero(spark):
    df = spark.createDataFrame([("c", 1.0, 0), ("c", 1.0, 1), ("c", 1.0, 1), ("s", 1.0, 1), ("s", 2.0, 0)],
                               "feature string, x double, y int")
    assert {r["feature"]: r["score"] for r in SE.absolute_correlations(df).collect()} == {"c": 0.0, "s": 0.0}


def pairs_frame(spark, rows):
    return spark.createDataFrame([("s", day(i + 1), day(i), t, y, a, b) for i, (t, y, a, b) in enumerate(rows)],
                                 LABELS + ", a double, b double")


def test_guard_accepts_and_names_each_broken_rule(spark):
    effects = "target string, current_score double, candidate_score double, drift double, delta double"
    good = [("Q1", 0.6, 0.59, 0.001, -0.01), ("Q2", 0.6, 0.59, 0.001, -0.01), ("S4", 0.6, 0.6, 0.0, 0.0)]
    def verdict(rows, **kw):
        return G.guard_candidate(spark.createDataFrame(rows, effects), kw.pop("name", "fine"), **kw).first()
    assert verdict(good)["approved"] == 1
    assert verdict(good, name="try_QSHEAD_2")["failures"] == "forbidden name"
    assert verdict(good, name="qshead", allow_name=True)["approved"] == 1
    assert verdict(good, weights=[0.0])["failures"] == "all weights zero"
    assert verdict([good[0], good[2]])["failures"] == "too few improved targets"
    assert verdict([*good, ("S1", 0.6, 0.61, 0.0, 0.01)])["failures"] == "target loss too large"
    assert verdict([*good, ("S1", 0.6, 0.6, 0.01, 0.0)])["failures"] == "test drift too large"
    still = [(t, c, n, 0.0, d) for t, c, n, _, d in good]
    assert verdict(still)["failures"] == "no test effect"


def test_selection_keeps_the_baseline_when_nothing_is_feasible(spark):
    cands = spark.createDataFrame([("Q1", "x", 0.61, 1), ("Q2", "x", 0.6005, 1), ("Q2", "y", 0.6004, 0)],
                                  "target string, candidate string, score double, drift_ok int")
    base = spark.createDataFrame([("Q1", 0.6), ("Q2", 0.6)], "target string, score double")
    got = {r["target"]: r["candidate"] for r in G.select_per_target(cands, base, ["Q1"], 0.001).collect()}
    assert got == {"Q1": "baseline", "Q2": "y"}
    safe = {r["target"]: r["candidate"] for r in G.select_per_target(cands, base, [], 0.0, min_gain=0.0).collect()}
    assert safe == {"Q1": "baseline", "Q2": "baseline"}


def test_searches_never_lose_to_the_base(spark):
    rows = [("Q1", 1, 0.9, 0.5), ("Q1", 0, 0.1, 0.5), ("S1", 1, 0.2, 0.9), ("S1", 0, 0.8, 0.1)]
    got = {r["target"]: r for r in B.two_run_search(pairs_frame(spark, rows), 11).collect()}
    assert got["Q1"]["weight"] == 1.0 and got["S1"]["weight"] == 0.0
    alpha = {r["target"]: r["alpha"] for r in B.prior_alpha(pairs_frame(spark, rows), 0.3).collect()}
    assert alpha == {"Q1": 1.0, "S1": 0.0}


def test_refined_weights_improve_on_the_grid(spark):
    rows = [("Q1", 1, 0.9, 0.4), ("Q1", 0, 0.3, 0.1), ("Q1", 1, 0.6, 0.8), ("Q1", 0, 0.2, 0.6)]
    wide = pairs_frame(spark, rows)
    first = B.weight_search(wide, ["a", "b"], B.simplex_grid(2, 4))
    again = B.refined_weight_search(wide, ["a", "b"], first, 0.05).first()
    assert again["score"] <= first.first()["score"] and again["w0"] + again["w1"] == pytest.approx(1.0)


def test_weight_vectors_sum_to_one():
    for w in [*B.simplex_grid(2), *B.simplex_grid(3), *B.random_simplex(4, 5, 1), *B.neighbours_on_simplex((0.5, 0.5), 0.1)]:
        assert sum(w) == pytest.approx(1.0) and min(w) >= -1e-12
    assert len(B.simplex_grid(3)) == 231 and len(B.calibration_grid()) == 1066


def test_idempotent_write_and_upsert(spark):
    rows = [("s", day(1), day(0), *[0.5] * 7)]
    wide = spark.createDataFrame(rows, "subject_id string, sleep_date date, lifelog_date date, "
                                 + ", ".join(f"{t} double" for t in TARGETS))
    path = scratch_path(spark, "t")
    assert K.write_csv_idempotent(wide, path) and not K.write_csv_idempotent(wide, path)
    with pytest.raises(ValueError):
        K.write_csv_idempotent(wide.withColumn("S4", F.lit(0.6)), path)
    log = scratch_path(spark, "log")
    one = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "experiment_name string, score double")
    two = spark.createDataFrame([("b", 3.0), ("c", 4.0)], "experiment_name string, score double")
    K.upsert_log(spark, log, one)
    K.upsert_log(spark, log, two)
    assert {r["experiment_name"]: r["score"] for r in K.read_log(spark, log).collect()} == {"a": 1.0, "b": 3.0, "c": 4.0}


def test_fixed_output_rejects_missing_values(spark):
    rows = [("s", day(1), day(0), *[0.123456789012] * 6, None)]
    wide = spark.createDataFrame(rows, "subject_id string, sleep_date date, lifelog_date date, "
                                 + ", ".join(f"{t} double" for t in TARGETS))
    assert K.fixed_decimal_output(wide.fillna(0.5)).first()["Q1"] == "0.1234567890"
    with pytest.raises(Exception, match="no finite prediction for S4"):
        K.fixed_decimal_output(wide).collect()


def test_platt_with_one_class_is_the_identity(spark):
    df = spark.createDataFrame([(0.2, 1), (0.7, 1)], "p double, y int")
    assert M.fit_platt(df) is None
    assert [r["p"] for r in M.apply_platt(None, df).collect()] == [0.2, 0.7]
