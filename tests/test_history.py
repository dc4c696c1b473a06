"""Past-only rules, calendar gaps and null rules of the windows."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from dayfold.operators import advanced as AD
from dayfold.operators import calendar as C
from dayfold.operators import encode as E
from dayfold.operators import history as H

D0 = date(2024, 1, 1)


def frame(spark, values, subject="s"):
    rows = [(subject, D0 + timedelta(days=i), v, 1.0) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "subject_id string, lifelog_date date, x double, d_m_row_cnt double")


def by_day(df, columns):
    return {r["lifelog_date"]: [r[c] for c in columns] for r in df.collect()}


def test_changing_a_day_leaves_earlier_and_same_day_windows_alone(spark):
    values = [float((i * 7) % 11) for i in range(25)]
    values[4] = None
    changed = [*values]
    changed[15] = 1000.0
    past_only = ["x__lag1", "x__expanding_mean", "x__roll_mean_3", "x__roll_mean_14", "x__roll_std_7", "x__slope_7",
                 "x__slope_14", "x__roll_skew_14", "x__roll_kurt_14", "x__weekly_autocorr", "x__trend_sign_7"]
    build = lambda v: AD.with_second_order(H.with_history(frame(spark, v), ["x"], []), ["x"])
    before, after = by_day(build(values), past_only), by_day(build(changed), past_only)
    for day in before:
        same = before[day] == after[day]
        assert same if day <= D0 + timedelta(days=15) else True
    assert before[D0 + timedelta(days=16)] != after[D0 + timedelta(days=16)]


def test_gaps_are_filled_once(spark):
    rows = [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 4), 2.0), ("b", date(2024, 2, 28), 3.0)]
    df = spark.createDataFrame(rows, "subject_id string, lifelog_date date, v double")
    got = C.fill_calendar(df).orderBy("subject_id", "lifelog_date").collect()
    assert [(r["subject_id"], r["lifelog_date"].day, r["v"]) for r in got] == [
        ("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 2.0), ("b", 28, 3.0)]


@pytest.mark.parametrize("n", [1, 2, 3, 20])
def test_short_and_constant_subjects(spark, n):
    df = H.with_history(frame(spark, [5.0] * n), ["x"], [])
    last = AD.with_second_order(df, ["x"]).orderBy(F.desc("lifelog_date")).first()
    if n == 1:
        assert last["x__lag1"] is None and last["x__roll_mean_7"] is None and last["x__slope_7"] is None
    if n == 2:
        assert last["x__roll_mean_7"] == 5.0 and last["x__roll_std_7"] is None
    if n >= 3:
        assert last["x__roll_std_7"] == 0.0 and last["x__slope_7"] == 0.0
    if n == 20:
        assert last["x__roll_skew_14"] == 0.0 and last["x__roll_kurt_14"] == 0.0
        assert last["x__weekly_autocorr"] is None and last["x__trend_sign_7"] == 0.0


def test_slope_closes_gaps(spark):
    df = H.with_history(frame(spark, [1.0, None, None, 2.0, 3.0, None]), ["x"], [])
    last = df.orderBy(F.desc("lifelog_date")).first()
    assert last["x__slope_7"] == pytest.approx(1.0)  # 1, 2, 3 in a row once nulls are dropped


def test_seen_share_counts_a_phantom_first_row(spark):
    rows = [("s", D0 + timedelta(days=i), v) for i, v in enumerate([1.0, 0.0, 2.0])]
    df = spark.createDataFrame(rows, "subject_id string, lifelog_date date, d_m_row_cnt double")
    got = H.with_history(df, [], ["m"]).orderBy("lifelog_date").collect()
    assert [r["d_m_row_cnt__obs_share_7"] for r in got] == [0.0, 0.5, pytest.approx(1 / 3)]
    assert [r["miss_days_since_last_m"] for r in got] == [0.0, 1.0, 0.0]


def test_zscore_without_spread_and_unseen_subject(spark):
    rows = [("a", D0, "train", 1.0), ("a", D0 + timedelta(days=1), "train", 1.0), ("b", D0, "test", 4.0)]
    df = spark.createDataFrame(rows, "subject_id string, lifelog_date date, split string, x double")
    assert all(r["x__subj_z"] is None for r in E.with_subject_zscores(df, ["x"]).collect())


def test_views_keep_order_and_rules():
    columns = ["d_a", "d_behavior_x", "tb_morning_a", "s_hr", "x_q", "d_mscreen_on_min__lag1", "d_mscreen_on_min__slope_7",
               "d_mscreen_on_min__roll_std_7", "d_mscreen_on_min__subj_z", "d_a__subj_z", "Q1_te_3", "dow"]
    assert E.view_columns(columns, "public_full") == columns
    assert E.view_columns(columns, "public_core") == [c for c in columns if "__" not in c or c.endswith("__subj_z")]
    assert E.view_columns(columns, "public_hist365") == [
        "d_a", "tb_morning_a", "s_hr", "d_mscreen_on_min__lag1", "d_mscreen_on_min__subj_z", "Q1_te_3", "dow"]
    assert "d_mscreen_on_min__roll_std_7" in E.view_columns(columns, "public_hist411")
    assert E.view_columns(columns, "public_notebook") == [
        "d_a", "tb_morning_a", "s_hr", "d_mscreen_on_min__subj_z", "d_a__subj_z", "Q1_te_3", "dow"]
    with pytest.raises(ValueError):
        E.view_columns(columns, "nope")
    with pytest.raises(ValueError):
        E.target_views(overrides={"Q1": "nope"})


def test_sequence_windows_are_padded_left(spark):
    df = frame(spark, [1.0, None, 3.0])
    got = AD.sequence_windows(df, ["x"], 2).orderBy("lifelog_date").collect()
    assert [r["window"] for r in got] == [[[0.0], [1.0]], [[1.0], [0.0]], [[0.0], [3.0]]]
