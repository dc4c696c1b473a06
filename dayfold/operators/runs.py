"""Order-dependent day statistics: runs, transitions and successive differences.

A day of one subject is cut into short time slices. Rows are ordered inside a slice only, each
slice is reduced to one summary row, and the few summaries of a day (at most
``1440 / slice_minutes``) are stitched together in time order. A subject that holds a large
part of all rows therefore never lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_MINUTES = 10


def time_slice(ts: Column) -> Column:
    """Ten-minute slice of the day; a slice never crosses an hour."""
    return F.floor((F.hour(ts) * 60 + F.minute(ts)) / SLICE_MINUTES).cast("int")


def slice_hour(slice_: Column | str = "slice") -> Column:
    return F.floor((F.col(slice_) if isinstance(slice_, str) else slice_) * SLICE_MINUTES / 60).cast("int")


def _slice_islands(df: DataFrame, keys: list[str], value: Column, order: list[Column]) -> DataFrame:
    """Runs of equal values inside each slice: value, length and island number."""
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    marked = df.withColumn("__value", value).withColumn("__prev", F.lag("__value").over(within))
    starts = F.when(F.col("__prev").isNull() | (F.col("__prev") != F.col("__value")), 1).otherwise(0)
    numbered = marked.withColumn(
        "__island", F.sum(starts).over(within.rowsBetween(Window.unboundedPreceding, 0))
    )
    return numbered.groupBy(*keys, "__slice", "__island").agg(
        F.first("__value").alias("__value"), F.count("*").alias("__len")
    )


def slice_summaries(
    df: DataFrame, keys: list[str], value: Column, order: list[Column], piece: Column,
    sums: dict[str, Column] | None = None, tasks: int | None = None,
) -> DataFrame:
    """One row per group and slice: edges of its runs, row count and further sums.

    ``piece`` numbers the slices (``slice`` in the result) and must rise with ``order``. ``sums``
    are expressions over a run's value and length (``run_value``, ``run_length``), so plain
    day totals come from the same pass over the rows as the runs. ``tasks`` sets the number of
    shuffle partitions (`session.tasks_for`).
    """
    sliced = df.withColumn("__slice", piece)
    islands = _slice_islands(sliced.repartition(tasks, *keys, "__slice") if tasks else sliced, keys, value, order)
    islands = islands.withColumnsRenamed({"__value": "run_value", "__len": "run_length", "__slice": "slice"})
    on_len = F.when(F.col("run_value") == 1, F.col("run_length"))
    return islands.groupBy(*keys, "slice").agg(
        F.count("*").alias("islands"),
        F.count(on_len).alias("episodes"),
        F.max(on_len).alias("best"),
        F.min_by("run_value", "__island").alias("head"),
        F.max_by("run_value", "__island").alias("tail"),
        F.min_by("run_length", "__island").alias("head_len"),
        F.max_by("run_length", "__island").alias("tail_len"),
        F.sum("run_length").alias("rows"),
        *[F.sum(c).alias(n) for n, c in (sums or {}).items()],
    )


def run_statistics(
    summaries: DataFrame, keys: list[str], episodes: str, longest: str,
    sums: dict[str, Column] | None = None, bits: dict[str, Column] | None = None, tasks: int | None = None,
) -> DataFrame:
    """Number of on-episodes and longest on-run in rows per group, from slices of a 0/1 value.

    ``sums`` and ``bits`` (bit sets) over the slice rows ride along in the same aggregations. ``tasks``
    sets the number of shuffle partitions.
    """
    sums, bits = sums or {}, bits or {}
    summaries = summaries.repartition(tasks, *keys) if tasks else summaries
    in_time = Window.partitionBy(*keys).orderBy("slice")
    joined = (F.col("head") == 1) & (F.lag("tail").over(in_time) == 1)
    edges = summaries.withColumn("__bridge", F.coalesce(joined.cast("int"), F.lit(0)))
    # A run over several slices is a chain: tail of the first, whole slices, head of the last.
    edges = edges.withColumn("__whole", (F.col("islands") == 1) & (F.col("head") == 1))
    breaks = F.when((F.col("__bridge") == 1) & F.lag("__whole").over(in_time), 0).otherwise(1)
    edges = edges.withColumn("__break", breaks).withColumn(
        "__chain", F.sum("__break").over(in_time.rowsBetween(Window.unboundedPreceding, 0))
    )
    carried = F.when(F.col("__break") == 1, F.lag("tail_len").over(in_time) * F.col("__bridge"))
    piece = F.when(F.col("head") == 1, F.col("head_len")).otherwise(0)
    edges = edges.withColumn("__piece", piece + F.coalesce(carried, F.lit(0)))
    chains = edges.groupBy(*keys, "__chain").agg(
        F.sum("__piece").alias("__len"), F.max("best").alias("__best"),
        (F.sum("episodes") - F.sum("__bridge")).alias("__episodes"),
        *[F.sum(c).alias(n) for n, c in sums.items()], *[F.bit_or(c).alias(n) for n, c in bits.items()],
    )
    return chains.groupBy(*keys).agg(
        F.sum("__episodes").cast("double").alias(episodes),
        F.greatest(F.max("__len"), F.coalesce(F.max("__best"), F.lit(0))).cast("double").alias(longest),
        *[F.sum(n).alias(n) for n in sums], *[F.bit_or(n).alias(n) for n in bits],
    )


def transition_count(
    summaries: DataFrame, keys: list[str], name: str,
    sums: dict[str, Column] | None = None, bits: dict[str, Column] | None = None,
) -> DataFrame:
    """How often a non-null value differs from the one before it, per group."""
    in_time = Window.partitionBy(*keys).orderBy("slice")
    crossing = F.coalesce((F.lag("tail").over(in_time) != F.col("head")).cast("int"), F.lit(0))
    counted = summaries.withColumn("__changes", F.col("islands") - 1 + crossing)
    return counted.groupBy(*keys).agg(
        F.sum("__changes").cast("double").alias(name),
        *[F.sum(c).alias(n) for n, c in (sums or {}).items()],
        *[F.bit_or(c).alias(n) for n, c in (bits or {}).items()],
    )


def successive_differences(
    df: DataFrame, keys: list[str], value: Column, order: list[Column], piece: Column, jump: float
) -> DataFrame:
    """Per group: number of successive differences, sum of squares, count of |diff| >= jump."""
    within = Window.partitionBy(*keys, "__slice").orderBy(*order)
    sliced = df.withColumn("__slice", piece).withColumn("__value", value)
    sliced = sliced.withColumn("__seq", F.row_number().over(within)).withColumn(
        "__diff", F.col("__value") - F.lag("__value").over(within)
    )
    edges = sliced.groupBy(*keys, "__slice").agg(
        F.count("__diff").alias("__n"),
        F.sum(F.col("__diff") * F.col("__diff")).alias("__sq"),
        F.count(F.when(F.abs("__diff") >= jump, 1)).alias("__jumps"),
        F.min_by("__value", "__seq").alias("head"),
        F.max_by("__value", "__seq").alias("tail"),
    )
    in_time = Window.partitionBy(*keys).orderBy("__slice")
    edges = edges.withColumn("__edge", F.col("head") - F.lag("tail").over(in_time))
    return edges.groupBy(*keys).agg(
        (F.sum("__n") + F.count("__edge")).alias("diff_cnt"),
        (F.coalesce(F.sum("__sq"), F.lit(0.0)) + F.coalesce(F.sum(F.col("__edge") * F.col("__edge")), F.lit(0.0)))
        .alias("diff_sq"),
        (F.sum("__jumps") + F.count(F.when(F.abs("__edge") >= jump, 1))).alias("diff_jumps"),
    )
