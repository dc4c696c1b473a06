"""Profiles and checks. Thresholds and expected sizes are arguments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayfold.functions.scalar import compact_text, iso_date
from dayfold.schema import DAY_KEYS, KEYS, TARGETS


def label_profile(labels: DataFrame) -> DataFrame:
    """One row: sizes and the positive rate of each target."""
    return labels.agg(
        F.count("*").alias("row_cnt"),
        F.count_distinct("subject_id").alias("subjects"),
        F.count_distinct("sleep_date").alias("sleep_dates"),
        F.count_distinct("lifelog_date").alias("lifelog_dates"),
        *[F.avg(t).alias(f"rate_{t}") for t in TARGETS],
    )


def day_delta_histogram(labels: DataFrame) -> DataFrame:
    delta = F.datediff("sleep_date", "lifelog_date").alias("delta_days")
    return labels.groupBy(delta).agg(F.count("*").alias("row_cnt"))


def modality_profile(df: DataFrame, name: str) -> DataFrame:
    """One row per log: size, subjects, date range, mean observations per subject-day."""
    days = (
        df.select("subject_id", F.to_date("timestamp").alias("day"))
        .groupBy("subject_id", "day").agg(F.count("*").alias("n"))
    )
    return days.agg(
        F.lit(name).alias("modality"), F.sum("n").alias("row_cnt"), F.count_distinct("subject_id").alias("subjects"),
        iso_date(F.min("day")).alias("day_min"), iso_date(F.max("day")).alias("day_max"),
        F.avg("n").alias("daily_mean"),
    )


def sample_rows(df: DataFrame, n: int = 2, limit: int = 220) -> DataFrame:
    """A few rows as compact text; a sample is the point here."""
    text = [compact_text(F.to_json(F.struct(c)), limit).alias(c) for c in df.columns]
    return df.limit(n).select(*text)


def split_counts(keys: DataFrame) -> DataFrame:
    return keys.groupBy("split").agg(F.count("*").alias("row_cnt"))


def date_rule_violations(keys: DataFrame) -> DataFrame:
    """Keys whose lifelog date is not the day before the sleep date."""
    return keys.where(F.datediff("sleep_date", "lifelog_date") != 1)


def contract(keys: DataFrame, sensors: dict[str, DataFrame]) -> DataFrame:
    """Profiles of all logs, one row each, next to the key counts."""
    in_split = lambda name: F.count(F.when(F.col("split") == name, 1))
    sizes = {"key_rows": F.count("*"), "train_rows": in_split("train"), "test_rows": in_split("test")}
    counted = keys.agg(F.struct(*[c.alias(n) for n, c in sizes.items()]).alias("sizes")).scalar()
    rows = reduce(DataFrame.unionByName, [modality_profile(df, name) for name, df in sensors.items()])
    return rows.withColumn("sizes", counted).select("*", *[F.col("sizes")[n].alias(n) for n in sizes]).drop("sizes")


def input_check(df: DataFrame, expected_rows: int, required: list[str] = TARGETS) -> DataFrame:
    """One row: row count against the expectation and the missing columns."""
    missing = ",".join(c for c in required if c not in df.columns)
    return df.agg(F.count("*").alias("row_cnt")).select(
        "row_cnt", F.lit(missing).alias("missing_columns"),
        ((F.col("row_cnt") == expected_rows) & F.lit(missing == "")).cast("int").alias("ok"),
    )


def range_check(predictions: DataFrame, low: float, high: float, by: list[str] = ["target"]) -> DataFrame:
    """Rows, non-finite values and range per target with a pass flag."""
    p = F.col("p").cast("double")
    bad = p.isNull() | F.isnan(p) | (F.abs(p) == float("inf"))
    stats = predictions.groupBy(*by).agg(
        F.count("*").alias("row_cnt"), F.count(F.when(bad, 1)).alias("bad_cnt"),
        F.min(F.when(~bad, p)).alias("low"), F.max(F.when(~bad, p)).alias("high"),
    )
    ok = (F.col("bad_cnt") == 0) & (F.col("low") >= low - 1e-12) & (F.col("high") <= high + 1e-12)
    return stats.withColumn("ok", ok.cast("int"))


def misaligned_rows(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of keys and labels that only one of two runs has; empty means aligned."""
    left, right = a.select(*columns), b.select(*columns)
    only_a = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_a.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def compare_outputs(old: DataFrame, new: DataFrame, tolerance: float) -> DataFrame:
    """Stored against recomputed predictions: unmatched keys and largest difference."""
    on = [*KEYS, "target"]
    a = old.select(*on, F.col("p").alias("a"), F.lit(1).alias("in_a"))
    b = new.select(*on, F.col("p").alias("b"), F.lit(1).alias("in_b"))
    joined = a.join(b, on, "full")
    stats = joined.agg(
        F.count(F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), 1)).alias("unmatched"),
        F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("max_abs_diff"),
        F.count(F.when(F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
                       & (F.col("a").isNull() != F.col("b").isNull()), 1)).alias("null_mismatch"),
    )
    ok = (F.col("unmatched") == 0) & (F.col("max_abs_diff") <= tolerance) & (F.col("null_mismatch") == 0)
    return stats.withColumn("ok", ok.cast("int"))


def validation_scheme(folds: DataFrame) -> DataFrame:
    """Distinct scheme names joined by '+', or 'unknown'."""
    distinct = folds.select("split_scheme").where(F.col("split_scheme").isNotNull()).distinct()
    joined = F.array_join(F.array_sort(F.collect_set("split_scheme")), "+")  # a handful of names
    return distinct.agg(F.coalesce(F.nullif(joined, F.lit("")), F.lit("unknown")).alias("validation_scheme"))


def table_report(df: DataFrame) -> DataFrame:
    """Rows, columns and numeric columns of a feature table with its split sizes."""
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in df.schema)
    tagged = lambda s: F.count(F.when(F.col("split") == s, 1))
    return df.agg(
        F.count("*").alias("row_cnt"), F.lit(len(df.columns)).cast("bigint").alias("column_cnt"),
        F.lit(numeric).cast("bigint").alias("numeric_cnt"),
        tagged("train").alias("train_rows"), tagged("test").alias("test_rows"),
    )


def duplicate_days(keys: DataFrame) -> DataFrame:
    """Subject-days with more than one key; windows and neighbours assume there are none."""
    return keys.groupBy(*DAY_KEYS).agg(F.count("*").alias("n")).where("n > 1")
