"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window is one word, lower-cased, between line ends and three times over, so that short words show as well.
Both dictionaries hold the words most ordinary documents use; the toxic one also holds the words that mark
toxic documents. How short each of them makes a window is a pair of lengths, and how often such a pair occurs
in toxic and in ordinary documents gives it a weight; a document's sum of the weights of its pairs is turned
into a score by a logistic curve. Dictionaries, weights and curve come from a bounded hash sample of labelled
rows whose crc32 fold is not 0.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import crc32_fold, documents, free_name, importable, released, sampled_texts, schema_with, written

#: Labelled rows to learn from at most.
FIT_ROWS = 20_000
#: Words of ordinary text, and at most of toxic text, in the dictionaries.
ORDINARY_WORDS = 6_000
TOXIC_WORDS = 2_000
#: A toxic word is in this share of toxic documents at least, and so many times as often as in others.
TOXIC_SHARE = 0.015
TOXIC_LIFT = 30
LEVEL = 12
#: Bytes of one window; a longer word makes several.
WINDOW = 64
REMEMBERED = 150_000
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Model(NamedTuple):
    toxic: bytes
    ordinary: bytes
    weights: dict[tuple[int, int], float]
    slope: float
    offset: float


def windows(text: str | None) -> set[bytes]:
    """The distinct windows of a text."""
    words = set(WORD.findall((text or "").lower().encode()))
    long = [w for w in words if len(w) > WINDOW]
    words.difference_update(long)
    return words.union(w[i:i + WINDOW] for w in long for i in range(0, len(w), WINDOW))


@lru_cache(maxsize=4)
def _compressors(toxic: bytes, ordinary: bytes) -> tuple:
    def make(content: bytes) -> zstandard.ZstdCompressor:
        words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        words.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False)

    return make(toxic), make(ordinary), {}


def lengths(words: set[bytes], toxic: bytes, ordinary: bytes) -> set[tuple[int, int]]:
    """The distinct pairs (bytes with the toxic, bytes with the ordinary dictionary) of a text's windows."""
    by_toxic, by_ordinary, known = _compressors(toxic, ordinary)
    if len(known) > REMEMBERED:
        known.clear()
    for w in words.difference(known):
        window = b"\n" + (w + b"\n") * 3
        known[w] = len(by_toxic.compress(window)), len(by_ordinary.compress(window))
    return {known[w] for w in words}


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(), Counter()
        for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()):
            counts[toxic == 1].update(windows(text))
        words = list(counts[0] | counts[1])
        columns = [pa.array(words, pa.binary()), *(pa.array([c[w] for w in words], pa.int64()) for c in counts)]
        yield pa.RecordBatch.from_arrays(columns, ["word", "ordinary", "toxic"])


def _pair_counts(toxic: bytes, ordinary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter((y == 1, *pair) for y, t in zip(batch.column("toxic").to_pylist(), batch.column("text").to_pylist()) for pair in lengths(windows(t), toxic, ordinary))
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([int(k[i]) for k in keys], pa.int32()) for i in range(3)] + [pa.array(list(counts.values()), pa.int64())], ["y", "a", "b", "n"])

    return run


def evidence(text: str | None, model: Model) -> float:
    return sum(model.weights.get(pair, 0.0) for pair in lengths(windows(text), model.toxic, model.ordinary))


def _evidence(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [round(4 * min(evidence(t, model), 60.0)) / 4 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(values, pa.float64())], ["toxic", "x"])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset by damped Newton steps, lightly held to small slopes."""
    design, beta = np.column_stack([x, np.ones_like(x)]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = design.T @ (n * (y - p)) - np.array([0.1, 0.0]) * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + np.diag([0.1, 1e-6])
        beta += np.clip(np.linalg.solve(hessian, gradient), -2, 2)
    return float(beta[0]), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows. Without rows of both labels nothing is toxic: every score is near 0."""
    importable(docs.sparkSession)
    rows = written(sampled_texts(docs, labels, "toxic", FIT_ROWS), "labelled")
    of = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_toxic, n_ordinary = of.get(1, 0), of.get(0, 0)
    if not n_toxic or not n_ordinary:
        return Model(b"", b"", {}, 0.0, -10.0)
    counts = rows.mapInArrow(_word_counts, "word binary, ordinary long, toxic long").groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    counts = written(counts, "words")
    common = counts.where("ordinary > 1").orderBy(F.desc("ordinary"), "word").limit(ORDINARY_WORDS).collect()
    often = max(3.0, TOXIC_SHARE * n_toxic)
    marked = counts.where((F.col("toxic") >= often) & (F.length("word") > 2) & (F.col("toxic") / n_toxic > TOXIC_LIFT * (F.col("ordinary") + 0.5) / n_ordinary))
    marked = marked.orderBy(F.desc("toxic"), "word").limit(TOXIC_WORDS).collect()
    # what matters most stands last, where references to it are shortest
    ordinary = b"\n".join([b"", *(bytes(r["word"]) for r in reversed(common)), b""])
    toxic = ordinary + b"\n".join([*(bytes(r["word"]) for r in reversed(marked)), b""])
    pairs = rows.mapInArrow(_pair_counts(toxic, ordinary), "y int, a int, b int, n long").groupBy("a", "b").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("ordinary")
    ).collect()  # at most one row for each pair of lengths of a window
    weights = {}
    for r in pairs:
        lift = np.log((r["toxic"] + 0.5) / (n_toxic + 1)) - np.log((r["ordinary"] + 0.5) / (n_ordinary + 1))
        if r["a"] < r["b"] and lift > 0.5 and r["toxic"] > 1:
            weights[r["a"], r["b"]] = round(float(lift), 4)
    model = Model(toxic, ordinary, weights, 0.0, 0.0)
    sums = rows.mapInArrow(_evidence(model), "toxic int, x double").groupBy("toxic", "x").count().collect()  # x has 241 values
    slope, offset = _logistic(*(np.array([r[c] for r in sums], float) for c in ("x", "toxic", "count")))
    return model._replace(slope=slope, offset=offset)


def _scores(model: Model, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([evidence(t, model) for t in batch.column(text_col).to_pylist()])
            values = 1 / (1 + np.exp(-(model.slope * np.minimum(x, 60.0) + model.offset)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], [*batch.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text") -> DataFrame:
    """The rows with a column `name`: how likely label 1 is, from 0 to 1.

    A null or empty text has no window and gets the lowest score. Only the text counts, so equal texts,
    repeated rows and null ids score alike; an empty table stays empty.
    """
    importable(docs.sparkSession)
    return docs.mapInArrow(released(_scores(model, text_col, name)), schema_with(docs, name, "double"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, whole rows, whose score is under one half."""
    name = free_name(docs, "score")
    return scored(docs, model, name).where(F.col(name) < 0.5).drop(name)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = scored(docs.select("doc_id", "text"), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held_out = F.coalesce(crc32_fold(F.col("doc_id")) == 0, F.lit(True))
    return rows.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
