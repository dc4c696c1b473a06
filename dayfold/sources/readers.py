"""Scans: label and template CSV, sensor parquet, key frame, stored runs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayfold.functions.scalar import finite
from dayfold.schema import KEYS, LABEL_SCHEMA, RUN_COLUMN_SUFFIXES, TARGETS


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV of keys and targets, tagged as the training split."""
    df = spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)
    return df.withColumn("split", F.lit("train"))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Keys of the rows to predict; whatever the file holds as targets becomes null."""
    df = spark.read.schema(LABEL_SCHEMA).option("header", True).csv(path)
    return df.select(*KEYS, *[F.lit(None).cast("int").alias(t) for t in TARGETS], F.lit("test").alias("split"))


def read_sensor(spark: SparkSession, path: str) -> DataFrame:
    """One sensor log. NaN and infinities become null, also inside numeric arrays."""
    return clean_numbers(spark.read.parquet(path))


def clean_numbers(df: DataFrame) -> DataFrame:
    def cleaned(field: T.StructField) -> Column:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            return finite(column).alias(field.name)
        if isinstance(field.dataType, T.ArrayType) and isinstance(
            field.dataType.elementType, (T.DoubleType, T.FloatType)
        ):
            return F.transform(column, finite).alias(field.name)
        return column

    return df.select(*[cleaned(f) for f in df.schema])


def read_modalities(spark: SparkSession, folder: str) -> DataFrame:
    """All sensor files of a folder with their file name; only parquet files are listed."""
    return (
        spark.read.option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(folder)
        .withColumn("file", F.col("_metadata.file_name"))
    )


def key_frame(train: DataFrame, template: DataFrame) -> DataFrame:
    """Union of both splits, one row per key. 'test' sorts before 'train', so it wins a collision."""
    both = train.unionByName(template)
    first = Window.partitionBy(*KEYS).orderBy("split")
    return both.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def prediction_columns(
    df: DataFrame, targets: Iterable[str] = TARGETS, allow_plain: bool = False
) -> DataFrame:
    """Pick the first stored prediction column of each target and name it after the target."""
    picked = []
    for t in targets:
        names = [f"{t}{s}" for s in RUN_COLUMN_SUFFIXES] + ([t] if allow_plain else [])
        found = next((n for n in names if n in df.columns), None)
        if found is None:
            raise ValueError(f"no prediction column for {t}")
        picked.append(F.col(found).cast("double").alias(t))
    return df.select(*[k for k in KEYS if k in df.columns], *picked)


def load_run(store: DataFrame, run: str, split: str) -> DataFrame:
    """Predictions of one run; a store partitioned by run and split is pruned to one folder."""
    return store.where((F.col("run") == run) & (F.col("split") == split))
