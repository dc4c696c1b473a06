"""Quality rules with an isolation forest over rule statistics.

Fixed rules reject the plainly broken texts. The forest judges the rest: trees of random splits over the
rule statistics isolate a text that is unlike the others in few splits, so a short mean path means an
anomaly. Trees grow on a bounded hash sample of labelled rows, mostly of good ones, and the path length
below which a text is rejected is calibrated on all labelled rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import documents, free_name, importable, released, sampled_texts, schema_with

SYMBOLS = "#*$%&|<>"
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = re.compile(r"[^\W_]+")
PLAIN = ".,;:)\"'"
#: Labelled rows that the trees may grow on, trees, and rows of one tree.
FIT_ROWS = 20_000
TREES = 128
SAMPLE = 256
#: Poor rows among the rows of one tree, as anomalies should be few.
POOR_SHARE = 0.03
#: Good labelled rows that the calibrated threshold may reject, as a share.
GOOD_LOSS = 0.001
BINS = 400

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Shares of symbols, of anything but letters and digits, of words with an odd last mark, mean length of a word,
#: share of capital words, distinct words against what a text of this length has.
FEATURES = ["symbols", "others", "odd_ends", "mean_word", "capitals", "distinct"]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the rules, and the shares that the forest looks at."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen: set[str] = set()
    dup = lines = 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                dup += 1
            seen.add(line)
    repeat = 0
    if n > 5:
        windows = list(zip(words, words[1:], words[2:], words[3:], words[4:]))
        counts = Counter(windows)
        if len(counts) < len(windows):
            covered = 0  # words up to here are counted
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    repeat += i + 5 - max(covered, i)
                    covered = i + 5
    small = max(n, 1)
    size = max(chars, 1)
    letters = sum(map(len, LETTERS.findall(text)))
    odd = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in PLAIN)
    return [n, chars, symbols, dup, repeat], [
        symbols / size, (chars - letters) / size, odd / small, min(chars / small, 40.0),
        sum(map(str.isupper, words)) / small, len(set(words)) / small ** 0.85,
    ]


def grow(rows: np.ndarray, rng: np.random.Generator, depth: int) -> tuple:
    """A node (feature, value, left, right), or the expected further depth of a leaf."""
    if depth == 0 or len(rows) <= 1:
        return (_expected(len(rows)),)
    low, high = rows.min(axis=0), rows.max(axis=0)
    open_features = np.flatnonzero(high > low)
    if not len(open_features):
        return (_expected(len(rows)),)
    f = int(rng.choice(open_features))
    value = float(rng.uniform(low[f], high[f]))
    left = rows[:, f] < value
    return f, value, grow(rows[left], rng, depth - 1), grow(rows[~left], rng, depth - 1)


def _expected(n: int) -> float:
    """Mean depth of a random search tree of n rows."""
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def path_lengths(forest: list, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(len(rows))

    def walk(node: tuple, at: np.ndarray, depth: int) -> None:
        if not len(at):
            return
        if len(node) == 1:
            total[at] += depth + node[0]
            return
        f, value, left, right = node
        low = rows[at, f] < value
        walk(left, at[low], depth + 1)
        walk(right, at[~low], depth + 1)

    for tree in forest:
        walk(tree, np.arange(len(rows)), 0)
    return total / max(len(forest), 1)


def fit_forest(good: np.ndarray, poor: np.ndarray, seed: int = 7) -> list:
    rng = np.random.default_rng(seed)
    depth = int(np.ceil(np.log2(SAMPLE))) + 4
    few = min(len(poor), round(POOR_SHARE * SAMPLE))
    forest = []
    for _ in range(TREES if len(good) else 0):
        rows = good[rng.choice(len(good), min(SAMPLE - few, len(good)), replace=False)]
        if few:
            rows = np.vstack([rows, poor[rng.choice(len(poor), few, replace=False)]])
        forest.append(grow(rows, rng, depth))
    return forest


def base_failed(counts: list[int]) -> bool:
    return counts[0] < 10 or 100 * counts[4] > 20 * counts[0]


def _labelled_statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [(q, *statistics(t)) for q, t in zip(batch.column("quality").to_pylist(), batch.column("text").to_pylist())]
        rows = [(q, f) for q, c, f in out if not base_failed(c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["quality", "features"])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list, float]:
    """(forest, threshold on the mean path). Without labelled good rows the forest is empty and rejects nothing."""
    importable(docs.sparkSession)
    rows = sampled_texts(docs, labels, "quality", FIT_ROWS)
    found = rows.mapInArrow(_labelled_statistics, "quality int, features array<double>").toPandas()
    good = np.array(found.features[found.quality == 1].tolist()).reshape(-1, len(FEATURES))
    poor = np.array(found.features[found.quality == 0].tolist()).reshape(-1, len(FEATURES))
    order = lambda x: x[np.lexsort(x.T)]  # noqa: E731  the same forest whatever order the rows come in
    good, poor = order(good), order(poor)
    forest = fit_forest(good, poor)
    if not forest:
        return [], -1.0
    a, b = path_lengths(forest, good), path_lengths(forest, poor)
    # no higher than the poor rows need, and never so high that more than GOOD_LOSS of the good ones go
    return forest, float(min(np.quantile(a, GOOD_LOSS), np.quantile(b, 0.99) + 1e-9)) if len(b) else -1.0


VERDICT = [*BASE, "path_length", "base_failed", "kept"]


def _judge(forest: list, threshold: float, text_col: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t) for t in batch.column(text_col).to_pylist()]
            counts = [f[0] for f in found]
            paths = path_lengths(forest, np.array([f[1] for f in found]).reshape(-1, len(FEATURES)))
            failed = [base_failed(c) for c in counts]
            kept = [not x and not (p < threshold) for x, p in zip(failed, paths.tolist())]
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(len(BASE))]
            columns += [pa.array(paths, pa.float64()), pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_())]
            verdict = pa.StructArray.from_arrays(columns, VERDICT)
            yield pa.RecordBatch.from_arrays([*batch.columns, verdict], [*batch.schema.names, name])

    return run


def judged(docs: DataFrame, model: tuple[list, float], name: str = "verdict", text_col: str = "text") -> DataFrame:
    """The rows with a struct column `name` of the counts, the mean path, base_failed and kept.

    A null or empty text has no words and fails the base rules. Every row is judged for itself, so repeated
    rows, ties and null ids change nothing; an empty table stays empty.
    """
    importable(docs.sparkSession)
    counts = ", ".join(f"{c}: bigint" for c in BASE)
    kind = f"struct<{counts}, path_length: double, base_failed: boolean, kept: boolean>"
    return docs.mapInArrow(released(_judge(*model, text_col, name)), schema_with(docs, name, kind))


def keep_good(docs: DataFrame, model: tuple[list, float]) -> DataFrame:
    """The documents, whole rows, that pass the base rules and the forest."""
    name = free_name(docs, "verdict")
    return judged(docs, model, name).where(F.col(name)["kept"]).drop(name)


def op10_quality_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = judged(docs.select("doc_id", "text"), fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return rows.select("doc_id", *[F.col(f"verdict.{c}") for c in VERDICT])
