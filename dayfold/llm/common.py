"""Helpers shared by the operators: whole texts out of Arrow batches, tables written to the shared folder."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayfold.session import scratch_path

#: Rows of one Arrow batch at most.
BATCH_ROWS = 2500


def importable(spark: SparkSession) -> None:
    """Prepares the session for Python tasks over whole texts.

    Workers find this package where the driver does; a cluster has it installed or gets it by --py-files.
    Arrow batches of at most BATCH_ROWS texts keep a worker's memory small; a lower setting stays.
    """
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


def released(run: Callable) -> Callable:
    """The task function, giving freed memory back to the system at its end: workers serve many tasks."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(df: DataFrame, name: str = "llm") -> DataFrame:
    """The frame as a zstd Parquet table in the folder of spark.checkpoint.dir, read back.

    This cuts the lineage: whatever an executor loses later is read again from the shared folder.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, id (long) and text (null becomes empty); every other column is left unread."""
    importable(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` summed size each (a larger single row stands alone)."""
    begin = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls; offset i to i + 1 is text i."""
    array = column.cast(pa.large_binary())
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    data = array.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and len(offsets) else np.zeros(0, np.uint8)
    return flat, offsets - (offsets[0] if len(offsets) else 0)


def crc32_fold(column: Column, folds: int = 5) -> Column:
    """crc32 of the value's text, modulo `folds`."""
    return F.crc32(column.cast("string")) % folds


def labelled_sample(labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(_id, target) of at most `limit` labelled ids, the first in hash order, from the folds but number 0."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull() & (crc32_fold(F.col("doc_id")) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(target).cast("int").alias(target))
    return hash_sample(rows, "_id", limit)


def hash_sample(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """The `limit` rows whose key comes first in hash order.

    Rows that cannot be among them are filtered by their hash first, so that tasks send the driver about
    `limit` rows together, not each.
    """
    n = rows.count()
    digest = F.xxhash64(key)
    if n > limit:
        share = min(1.0, (limit + 6 * limit ** 0.5 + 30) / n)
        rows = rows.where(digest <= int(-(2 ** 63) + share * (2 ** 64 - 2 ** 11)))
    return rows.orderBy(digest, key).limit(limit)


def sampled_texts(docs: DataFrame, labels: DataFrame, target: str, limit: int) -> DataFrame:
    """(target, text) of the sampled rows; the broadcast side has `limit` rows of 12 bytes at most."""
    sample = F.broadcast(labelled_sample(labels, target, limit))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.join(sample, "_id").select(target, "text")


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores added while the frame has such a column."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def schema_with(df: DataFrame, name: str, kind: str) -> StructType:
    """The frame's schema with one more column."""
    return StructType([*df.schema.fields, *StructType.fromDDL(f"`{name}` {kind}").fields])
