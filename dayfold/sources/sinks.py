"""Sinks: tables, prediction files, run summaries and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayfold.functions.scalar import finite, iso_date, probability
from dayfold.operators.audit import compare_outputs
from dayfold.schema import KEYS, PROB_EPS, PROB_HIGH, PROB_LOW, TARGETS

SCORES = T.MapType(T.StringType(), T.DoubleType())
RUN_SUMMARY_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("model_family", T.StringType()),
    T.StructField("feature_view", T.StringType()),
    T.StructField("split_scheme", T.StringType()),
    T.StructField("mean_log_loss", T.DoubleType()),
    T.StructField("std_log_loss", T.DoubleType()),
    T.StructField("target_scores", SCORES),
    T.StructField("calibration", T.StringType()),
    T.StructField("improvement_over_dummy", T.DoubleType()),
    T.StructField("accepted", T.BooleanType()),
    T.StructField("paper_relevance", T.StringType()),
    T.StructField("score_breakdown", T.MapType(T.StringType(), SCORES)),
    T.StructField("notes", T.ArrayType(T.StringType())),
])


def write_table(df: DataFrame, path: str, partition_by: list[str] = [], mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def wide_predictions(long: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """One row per key with one probability column per target; the target list is fixed."""
    return long.groupBy(*KEYS).pivot("target", targets).agg(F.max("p"))


def prediction_bundle(long: DataFrame, scheme: str, family: str, stage: str, targets: list[str] = TARGETS) -> DataFrame:
    """Keys, integer labels, scheme, family and ``<target>_<stage>`` columns of one run."""
    by_target = lambda t, c: F.max(F.when(F.col("target") == t, F.col(c)))
    return long.groupBy(*KEYS).agg(
        *[by_target(t, "y").cast("int").alias(t) for t in targets],
        F.lit(scheme).alias("split_scheme"), F.lit(family).alias("model_family"),
        *[by_target(t, "p").alias(f"{t}_{stage}") for t in targets],
    )


def clipped_output(wide: DataFrame, low: float = PROB_LOW, high: float = PROB_HIGH) -> DataFrame:
    return wide.select(*KEYS, *[probability(t, low, high).alias(t) for t in TARGETS])


def fixed_decimal_output(wide: DataFrame) -> DataFrame:
    """Keys as text, probabilities with ten decimals; a missing or infinite one fails the job."""
    checked = [
        F.when(finite(t).isNull(), F.raise_error(F.lit(f"no finite prediction for {t}")).cast("double"))
        .otherwise(probability(t, PROB_EPS, 1.0 - PROB_EPS))
        for t in TARGETS
    ]
    return wide.select(
        "subject_id", iso_date("sleep_date").alias("sleep_date"), iso_date("lifelog_date").alias("lifelog_date"),
        *[F.format_string("%.10f", c).alias(t) for c, t in zip(checked, TARGETS)],
    )


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists in its own file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def write_csv(df: DataFrame, path: str) -> None:
    """Header CSV; an existing output is never overwritten."""
    df.write.mode("errorifexists").option("header", True).csv(path)


def write_csv_idempotent(df: DataFrame, path: str, tolerance: float = 1e-12) -> bool:
    """Write once; accept an existing output only when it holds the same values.

    Returns whether something was written.
    """
    spark = df.sparkSession
    if not path_exists(spark, path):
        write_csv(df, path)
        return True
    header = spark.read.option("header", True).csv(path)
    if header.columns != df.columns:
        raise ValueError(f"existing output has other columns: {path}")
    old = spark.read.schema(df.schema).option("header", True).csv(path)
    long = lambda d: d.unpivot(KEYS, TARGETS, "target", "p")
    verdict = compare_outputs(long(old), long(df), tolerance).first()
    if verdict["ok"] != 1:
        raise ValueError(f"existing output differs: {path}")
    return False


def run_summary(spark: SparkSession, record: dict) -> DataFrame:
    """One nested row with scores per stage and target, settings and notes."""
    return spark.createDataFrame([record], RUN_SUMMARY_SCHEMA)


def write_run_summary(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append rows to the run registry; the schema is written with every file."""
    rows.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in the new ones, plus the new ones."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_log(spark: SparkSession, path: str, new: DataFrame, key: str = "experiment_name") -> None:
    """Upsert as a new snapshot folder, so a failed write never harms the last good one."""
    if not path_exists(spark, path):
        new.withColumn("snapshot", F.lit(1)).write.partitionBy("snapshot").parquet(path)
        return
    snapshots = spark.read.parquet(path)
    last = snapshots.agg(F.max("snapshot")).first()[0]
    merged = upserted(snapshots.where(F.col("snapshot") == last).drop("snapshot"), new, key)
    merged.write.mode("errorifexists").parquet(f"{path}/snapshot={last + 1}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The newest snapshot; the filter prunes the older folders."""
    snapshots = spark.read.parquet(path)
    last = snapshots.agg(F.max("snapshot")).first()[0]
    return snapshots.where(F.col("snapshot") == last).drop("snapshot")


def matching_runs(registry: DataFrame, request: DataFrame, settings: list[str]) -> DataFrame:
    """Stored runs whose settings equal the requested ones; null equals null."""
    wanted = request.select(*[F.col(c).alias(f"__{c}") for c in settings])
    same = None
    for c in settings:
        equal = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = equal if same is None else same & equal
    return registry.join(F.broadcast(wanted), same, "left_semi")  # one requested row
