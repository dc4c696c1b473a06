"""Document scores by masked pseudo-likelihood.

A small network reads the two words on each side of a masked word and predicts it; a document's score is the
sum of the log probabilities of all its words. Words are hashed to `WORDS` buckets, which fall into classes,
so a prediction is a softmax over the classes and one within the word's class.

Training is data parallel: from a start fitted to a small hash sample, every task runs over its own documents
with Adagrad, and the tasks' parameters, weighted by their words, are averaged in Spark, parameter by
parameter. Every word of every document is a target of training, and of scoring.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import documents, hash_sample, keyed_text, slices, text_buffers
from dayfold.llm.phrases import word_units

CLASSES = 32
WORDS = CLASSES * 32
SIDE = 2
WIDTH, HIDDEN = 16, 32
BATCH = 2048
RATE = 0.2
#: Documents of the sample that gives the start, and passes over it.
START_ROWS, START_PASSES = 256, 3
#: Bytes of text that a worker holds as words at a time, and words of one step of scoring.
STEP_BYTES, STEP_WORDS = 1_000_000, 16_384


class Network(NamedTuple):
    words: np.ndarray    # vectors of the words, and one for the text's edges
    hidden: np.ndarray
    hidden_bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    within: np.ndarray   # for each class the weights of its words
    within_bias: np.ndarray


def fresh(seed: int = 3) -> Network:
    rng = np.random.default_rng(seed)
    n = 2 * SIDE * WIDTH
    parts = (
        rng.normal(0, 0.3, (WORDS + 1, WIDTH)), rng.normal(0, n ** -0.5, (n, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 0.1, (HIDDEN, CLASSES)), np.zeros(CLASSES), rng.normal(0, 0.1, (CLASSES, HIDDEN, WORDS // CLASSES)), np.zeros((CLASSES, WORDS // CLASSES)),
    )
    return Network(*(p.astype(np.float32) for p in parts))


def flatten(net: Network) -> np.ndarray:
    return np.concatenate([p.ravel() for p in net])


def unflatten(values: np.ndarray) -> Network:
    parts, at = [], 0
    for p in fresh():
        parts.append(values[at:at + p.size].reshape(p.shape).astype(np.float32))
        at += p.size
    return Network(*parts)


def examples(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words with edges around each text, places of the true words, words of each text)."""
    units = word_units(flat, offsets)
    ids = (units.codes % np.uint64(WORDS)).astype(np.int32)
    text = np.repeat(np.arange(len(units.sizes)), units.sizes)
    places = np.arange(len(ids)) + 2 * SIDE * text + SIDE
    padded = np.full(len(ids) + 2 * SIDE * max(len(units.sizes), 1), WORDS, np.int32)
    padded[places] = ids
    return padded, places, units.sizes


def _around(padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    steps = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    return padded[places[:, None] + np.array(steps)]


def _log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _forward(net: Network, around: np.ndarray, target: np.ndarray) -> tuple:
    """Examples must come ordered by the target's class."""
    x = net.words[around].reshape(len(around), -1)
    h = np.tanh(x @ net.hidden + net.hidden_bias)
    by_class = _log_softmax(h @ net.classes + net.class_bias)
    cuts = np.searchsorted(target // (WORDS // CLASSES), np.arange(CLASSES + 1))
    inner = np.empty((len(h), WORDS // CLASSES), np.float32)
    for c in range(CLASSES):
        a, b = cuts[c], cuts[c + 1]
        if a < b:
            inner[a:b] = h[a:b] @ net.within[c] + net.within_bias[c]
    return x, h, by_class, _log_softmax(inner), cuts


def log_probabilities(net: Network, padded: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Log probability of each word given the words on both its sides."""
    out = np.empty(len(places))
    for at in range(0, len(places), STEP_WORDS):
        mine = places[at:at + STEP_WORDS]
        target = padded[mine]
        order = np.argsort(target, kind="stable")
        mine, target = mine[order], target[order]
        _, _, by_class, inner, _ = _forward(net, _around(padded, mine), target)
        rows = np.arange(len(mine))
        out[at + order] = by_class[rows, target // (WORDS // CLASSES)] + inner[rows, target % (WORDS // CLASSES)]
    return out


class Trainer:
    """Adagrad on the mean negative log probability of batches."""

    def __init__(self, net: Network) -> None:
        self.net = Network(*(p.copy() for p in net))
        self.squares = [np.full(p.shape, 1e-3, np.float32) for p in net]
        self.seen = 0

    def step(self, padded: np.ndarray, places: np.ndarray) -> None:
        net, n = self.net, len(places)
        target = padded[places]
        order = np.argsort(target, kind="stable")
        places, target = places[order], target[order]
        around = _around(padded, places)
        x, h, by_class, inner, cuts = _forward(net, around, target)
        rows = np.arange(n)
        d_class, d_inner = np.exp(by_class), np.exp(inner)
        d_class[rows, target // (WORDS // CLASSES)] -= 1
        d_inner[rows, target % (WORDS // CLASSES)] -= 1
        d_class /= n
        d_inner /= n
        d_h = d_class @ net.classes.T
        d_within, d_within_bias = np.zeros_like(net.within), np.zeros_like(net.within_bias)
        for c in range(CLASSES):
            a, b = cuts[c], cuts[c + 1]
            if a < b:
                d_within[c] = h[a:b].T @ d_inner[a:b]
                d_within_bias[c] = d_inner[a:b].sum(axis=0)
                d_h[a:b] += d_inner[a:b] @ net.within[c].T
        d_a = d_h * (1 - h * h)
        d_x = (d_a @ net.hidden.T).reshape(-1, WIDTH)
        which = around.ravel()
        order = np.argsort(which, kind="stable")
        heads = np.flatnonzero(np.diff(which[order], prepend=-1))
        d_words = np.zeros_like(net.words)
        d_words[which[order][heads]] = np.add.reduceat(d_x[order], heads, axis=0)
        for p, s, g in zip(net, self.squares, (d_words, x.T @ d_a, d_a.sum(axis=0), h.T @ d_class, d_class.sum(axis=0), d_within, d_within_bias)):
            s += g * g
            p -= RATE * g / np.sqrt(s)
        self.seen += n

    def texts(self, flat: np.ndarray, offsets: np.ndarray) -> None:
        padded, places, _ = examples(flat, offsets)
        places = np.random.default_rng(len(places)).permutation(places)
        for at in range(0, len(places), BATCH):
            self.step(padded, places[at:at + BATCH])


def _pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    flat, offsets = text_buffers(column)
    for a, b in slices(np.diff(offsets), STEP_BYTES):
        yield a, b, flat[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]


def _train(start: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer = Trainer(unflatten(start))
        for batch in batches:
            for _, _, flat, offsets in _pieces(batch.column("text")):
                trainer.texts(flat, offsets)
        if trainer.seen:
            values = flatten(trainer.net).astype(np.float64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * trainer.seen), pa.array(np.full(len(values), float(trainer.seen)))], ["place", "value", "weight"]
            )

    return run


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """The network fitted to all documents; without any word it stays as it was made."""
    texts = keyed_text(docs, id_col, text_col)
    sample = hash_sample(texts, "doc_id", START_ROWS).select("text").toPandas()["text"].tolist()
    trainer = Trainer(fresh())
    for _ in range(START_PASSES):
        for _, _, flat, offsets in _pieces(pa.array(sample, pa.string())):
            trainer.texts(flat, offsets)
    start = flatten(trainer.net)
    found = texts.mapInArrow(_train(start), "place int, value double, weight double").groupBy("place").agg((F.sum("value") / F.sum("weight")).alias("value"))
    rows = found.toPandas()  # one row for each of the network's parameters
    if rows.empty:
        return trainer.net
    values = np.empty(len(start))
    values[rows["place"].to_numpy()] = rows["value"].to_numpy()
    return unflatten(values)


def _score(values: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = unflatten(values)
        for batch in batches:
            for a, b, flat, offsets in _pieces(batch.column("text")):
                padded, places, sizes = examples(flat, offsets)
                found = log_probabilities(net, padded, places)
                sums = np.bincount(np.repeat(np.arange(b - a), sizes), found, minlength=b - a)
                mean = pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(sizes), pa.array(sums), mean], ["doc_id", "n_words", "log_likelihood", "mean_log_likelihood"])

    return run


def scored(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, log_likelihood (sum over words), mean_log_likelihood.

    A null or empty text has no words, the sum 0 and a null mean. Equal texts score alike; repeated rows repeat.
    """
    schema = "doc_id long, n_words long, log_likelihood double, mean_log_likelihood double"
    return keyed_text(docs, id_col, text_col).mapInArrow(_score(flatten(net)), schema)


def op8_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return scored(docs, train(docs))
