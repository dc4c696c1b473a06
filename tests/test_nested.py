"""Edge cases of nested payloads."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from dayfold.functions import arrays as A
from dayfold.functions import scalar as X
from dayfold.operators import daily as D
from dayfold.sources.readers import clean_numbers

NAN = float("nan")
T0 = datetime(2024, 3, 1, 1, 0, 0)


def test_heart_rate_arrays(spark):
    df = spark.createDataFrame(
        [(1, None), (2, []), (3, [NAN]), (4, [60.0, NAN, 80.0, None])], "i int, heart_rate array<double>")
    x = A.numbers(A.or_empty(F.col("heart_rate"), "array<double>"))
    rows = {r["i"]: r for r in df.select("i", *[c.alias(n) for n, c in A.heart_rate_stats(x).items()]).collect()}
    for i in (1, 2, 3):
        assert rows[i]["hr_count"] == 0.0 and rows[i]["hr_mean"] is None and rows[i]["hr_std"] is None
    assert (rows[4]["hr_mean"], rows[4]["hr_min"], rows[4]["hr_max"], rows[4]["hr_std"]) == (70.0, 60.0, 80.0, 10.0)


def test_scan_cleaning_reaches_arrays(spark):
    df = spark.createDataFrame([(float("inf"), [NAN, 1.0])], "a double, b array<double>")
    row = clean_numbers(df).first()
    assert row["a"] is None and row["b"] == [None, 1.0]


def test_dominant_app(spark):
    ddl = "i int, m_usage_stats array<struct<app_name:string,total_time:double>>"
    df = spark.createDataFrame([
        (1, [("first", 5.0), ("second", 5.0)]),       # a tie keeps the first
        (2, [("neg", -3.0)]),                          # below -1 never wins
        (3, [(" chat app ", 1.0)]),          # non-breaking spaces
        (4, []), (5, None), (6, [("x", NAN), ("y", 0.0)]),
    ], ddl)
    got = {r["i"]: r["top_app"] for r in D.usage_snapshots(df).collect()}
    assert got == {1: "first", 2: "", 3: "chat app", 4: "", 5: "", 6: "y"}


def test_ambience_pairs(spark):
    df = spark.createDataFrame([
        (1, [["only label"], ["Speech", "n/a"], ["Music", "0.5"]]), (2, []), (3, None), (4, [["a", "0"], ["b", "0"]]),
    ], "i int, m_ambience array<array<string>>")
    got = {r["i"]: r for r in D.ambience_tops(df).collect()}
    assert got[1]["top1_label"] == "Speech" and got[1]["top1_score"] == 0.5  # score of a later item
    assert got[2]["top1_label"] == "" and got[2]["entropy"] is None and got[3]["top1_score"] is None
    assert got[4]["entropy"] == 0.0


def test_empty_bucket_sum_is_null_and_null_devices(spark):
    pedo = spark.createDataFrame(
        [("s", T0, 7, 0.0, 0.0, 0.0)],
        "subject_id string, timestamp timestamp, step int, distance double, speed double, burned_calories double")
    row = D.day_summary("wpedo", pedo).first()
    assert row["tb_overnight_wpedo_step_sum"] == 7 and row["tb_morning_wpedo_step_sum"] is None
    wifi = spark.createDataFrame(
        [("s", T0, [(None, -1.0), (" a ", None), ("", -3.0)]), ("t", T0, None)],
        "subject_id string, timestamp timestamp, m_wifi array<struct<bssid:string,rssi:double>>")
    plain = {r["subject_id"]: r for r in D.merge_parts(D.wifi_parts(wifi)).collect()}
    parity = {r["subject_id"]: r for r in D.merge_parts(D.wifi_parts(wifi, null_is_text=True)).collect()}
    assert plain["s"]["d_mwifi_unique_bssid_cnt"] == 1 and parity["s"]["d_mwifi_unique_bssid_cnt"] == 2
    assert plain["t"]["d_mwifi_unique_bssid_cnt"] == 0 and plain["t"]["d_mwifi_ap_cnt_mean"] == 0


@pytest.mark.parametrize("value,expected", [(None, None), (-0.2, 1e-6), (0.4, 0.4), (2.0, 1 - 1e-6)])
def test_clip_keeps_null(spark, value, expected):
    df = spark.createDataFrame([(value,)], "p double")
    assert df.select(X.probability("p")).first()[0] == expected


def test_safe_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), (None,)], "t string")
    assert [r[0] for r in df.select(X.to_number("t")).collect()] == [1.5, None, None, None]
    one = spark.range(1)
    assert one.select(X.ratio(F.lit(1.0), F.lit(0.0))).first()[0] is None
    assert one.select(X.log_loss_term(F.lit(0.5), F.lit(0.5))).first()[0] == pytest.approx(0.693147, abs=1e-6)
