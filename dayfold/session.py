"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = 8, app: str = "dayfold") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: what ``spark.checkpoint.dir`` names, else one in the shared warehouse."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a table that one shuffle partition takes, about, where `tasks_for` sets their number.
TASK_ROWS = 200_000


def tasks_for(table: DataFrame) -> int:
    """Shuffle partitions for a table's rows: their number grows with the table, so what one task holds does not.

    A plain table is counted from its footers. Without this the adaptive plan merges partitions up to its
    advised size of compressed bytes, which is far more as rows in a sort or an aggregate.
    """
    return max(table.sparkSession.sparkContext.defaultParallelism, -(-table.count() // TASK_ROWS))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Used before loops that rescan the frame (model fits), so that a lost executor
    only costs a file read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "stage")
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Frames that are written at a time: one part alone has too few tasks for a cluster between its stages.
SIDE_BY_SIDE = 6


def cut_side_by_side(frames: list[DataFrame]) -> list[DataFrame]:
    """`cut_lineage` of every frame, some at a time.

    A plan over many of them then reads files. In one plan with all that made them, the adaptive planner goes
    over the whole again after each of some hundred stages.
    """
    if not frames:
        return []
    pool = ThreadPool(min(SIDE_BY_SIDE, len(frames)))
    try:
        return pool.map(inheritable_thread_target(frames[0].sparkSession)(cut_lineage), frames, chunksize=1)
    finally:
        pool.close()
