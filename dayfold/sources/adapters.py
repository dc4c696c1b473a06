"""Logical inputs made from the generic test tables.

The event stream plays the phone and watch logs: the user is the subject, event types and the
number inside ``props`` decide which sensor a row feeds and what its payload is. Everything is a
row-level expression, so the inputs grow with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.schema import KEYS, TARGETS
from dayfold.session import cut_lineage


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    df = table(spark, folder, "events")
    return df.select(
        F.concat(F.lit("id"), F.col("user_id").cast("string")).alias("subject_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id"),
        F.col("event_type").alias("kind"),
        F.col("value").alias("v"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _null_if(condition: Column, value: Column) -> Column:
    return F.when(~condition, value)


def _structs(*items: dict[str, Column]) -> Column:
    return F.array(*[F.struct(*[c.alias(n) for n, c in item.items()]) for item in items])


def stored_log(spark: SparkSession, folder: str) -> DataFrame:
    """The event log with the number of ``props`` read once, for jobs that scan it for every sensor."""
    return cut_lineage(event_log(spark, folder))


def sensor_logs(spark: SparkSession, folder: str, log_rows: DataFrame | None = None) -> dict[str, DataFrame]:
    """The twelve sensor logs with the payload types the reference reads, from the folder's event log or a stored one."""
    ev = event_log(spark, folder) if log_rows is None else log_rows
    v, k, kind = F.col("v"), F.col("k"), F.col("kind")
    of = lambda *kinds: ev.where(kind.isin(*kinds))
    log = lambda df, **cols: df.select(
        "subject_id", "timestamp", *[c.alias(n) for n, c in cols.items()]
    )
    text = lambda c: c.cast("string")
    nan = F.lit(float("nan"))
    no_double = F.lit(None).cast("double")
    no_text = F.lit(None).cast("string")

    heart = F.array(50.0 + v / 7.0, F.when(k % 5 == 0, nan).otherwise(60.0 + k / 3.0), 55.0 + v / 11.0)
    points = _structs(
        {"speed": v / 130.0, "latitude": 37.0 + k / 300.0, "longitude": 127.0 + v / 900.0},
        {"speed": _null_if(k % 3 == 0, k / 70.0), "latitude": 37.0 + v / 700.0,
         "longitude": _null_if(k % 4 == 0, 127.0 + k / 900.0)},
    )
    access = _structs(
        {"bssid": F.concat(F.lit(" ap"), text(k % 7), F.lit(" ")), "rssi": -40.0 - v / 9.0},
        {"bssid": F.when(k % 6 == 0, no_text).when(k % 6 == 1, F.lit("  ")).otherwise(
            F.concat(F.lit("ap"), text(k % 4))), "rssi": _null_if(k % 5 == 0, -50.0 - k / 7.0)},
    )
    devices = _structs(
        {"address": F.concat(F.lit("ad"), text(k % 9)), "device_class": F.concat(F.lit("c"), text(k % 2)),
         "rssi": -60.0 - v / 17.0},
        {"address": F.concat(F.lit("ad"), text(k % 5)), "device_class": F.when(k % 3 == 0, F.lit(""))
         .otherwise(F.lit("c0")), "rssi": no_double},
    )
    apps = _structs(
        {"app_name": F.concat(F.lit("app "), text(k % 5)), "total_time": v},
        {"app_name": F.concat(F.lit(" app "), text(k % 3)),
         "total_time": F.when(k % 4 == 0, v).when(k % 9 == 0, no_double).otherwise(k * 1.5)},
    )
    sounds = F.array(
        F.lit("Speech"), F.lit("Music"), F.lit("Card shuffling"), F.lit("Silence"),
        F.lit("Inside, small room"), F.lit("Outside, urban"), F.lit("Truck"), F.lit("Conversation"),
    )
    clip = F.array(
        F.when(k % 10 == 0, F.array(F.lit("Wind"))).otherwise(
            F.array(F.try_element_at(sounds, k % 8 + 1),
                    F.when(k % 7 == 0, F.lit("n/a")).otherwise(text((k % 6) / 7.0)))
        ),
        F.array(F.lit("Music"), text((k % 9) / 13.0)),
    )
    return {
        "mac": log(of("click", "view", "error"), m_charging=_null_if(k == 0, (v > 40).cast("int"))),
        "mscreen": log(of("click", "purchase", "signup"), m_screen_use=_null_if(k % 13 == 0, (v > 20).cast("int"))),
        "mact": log(ev, m_activity=_null_if(k % 10 == 9, k % 10)),
        "mlight": log(of("view", "error"), m_light=_null_if(k % 17 == 0, v - 10.0)),
        "wlight": log(of("signup"), w_light=v),
        "wpedo": log(
            of("purchase", "click"),
            step=F.when(k % 9 == 0, F.lit(None)).when(k % 3 == 0, F.lit(0)).otherwise(F.floor(v)).cast("int"),
            step_frequency=v / 60.0,
            running_step=(k % 2).cast("int"),
            walking_step=(k % 3).cast("int"),
            distance=F.when(k % 4 == 0, F.lit(0.0)).otherwise(v * 0.75),
            speed=_null_if(k % 5 == 0, F.when(k % 6 == 0, F.lit(0.0)).otherwise(v / 13.0)),
            burned_calories=v * 0.25,
        ),
        "whr": log(of("signup", "view"), heart_rate=F.when(k % 19 == 0, F.lit(None)).when(
            k % 7 == 0, F.array().cast("array<double>")).otherwise(heart)),
        "mgps": log(of("error", "purchase", "click"), m_gps=_null_if(k % 11 == 0, points)),
        "mwifi": log(of("view", "click"), m_wifi=_null_if(k % 10 == 3, access)),
        "mble": log(of("view", "signup"), m_ble=_null_if(k % 6 == 2, devices)),
        "muse": log(of("view", "purchase"), m_usage_stats=_null_if(k % 15 == 4, apps)),
        "mamb": log(of("error", "signup"), m_ambience=_null_if(k % 12 == 5, clip)),
    }


def day_labels(spark: SparkSession, folder: str, log_rows: DataFrame | None = None) -> DataFrame:
    """One labelled row per user-day: keys and seven binary targets."""
    ev = (event_log(spark, folder) if log_rows is None else log_rows).withColumn("lifelog_date", F.to_date("timestamp"))
    has = lambda c: F.max(c.cast("int"))
    kind = F.col("kind")
    targets = {
        "Q1": (F.sum("v") > 100).cast("int"),
        "Q2": has(kind == "purchase"),
        "Q3": (F.count(F.when(kind == "click", 1)) > F.count(F.when(kind == "view", 1))).cast("int"),
        "S1": has(F.hour("timestamp") < 6),
        "S2": has(F.col("v") > 80),
        "S3": (F.count("*") >= 3).cast("int"),
        "S4": has(kind == "error"),
    }
    days = ev.groupBy("subject_id", "lifelog_date").agg(*[c.alias(n) for n, c in targets.items()])
    return days.select("subject_id", F.date_add("lifelog_date", 1).alias("sleep_date"), "lifelog_date", *TARGETS)


def is_test_day(day: str = "lifelog_date") -> Column:
    """Days 11 to 15 and from 26 of a month are to be predicted."""
    dom = F.dayofmonth(day)
    return dom.between(11, 15) | (dom >= 26)


def labelled_keys(spark: SparkSession, folder: str, log_rows: DataFrame | None = None) -> DataFrame:
    """All keys with their split; targets of the rows to predict are null."""
    df = day_labels(spark, folder, log_rows).withColumn("split", F.when(is_test_day(), "test").otherwise("train"))
    return df.select(*KEYS, *[F.when(F.col("split") == "train", F.col(t)).alias(t) for t in TARGETS], "split")


def long_labels(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """One row per key and target: the shape of everything after feature building."""
    ids = [c for c in df.columns if c not in TARGETS]
    return df.unpivot(ids, targets, "target", "y")


def document_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of documents in long form, with the source as subject."""
    docs = table(spark, folder, "documents").select("doc_id", "source", "lang", "n_chars")
    joined = table(spark, folder, "labels").join(docs, "doc_id")
    return joined.unpivot(["doc_id", "source", "lang", "n_chars"], ["quality", "toxic"], "target", "y")
