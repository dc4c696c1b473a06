"""Removal of repeated byte strings by prefix-free parsing and suffix order.

Rolling-hash triggers cut the documents into phrases (`phrases.py`). The distinct phrases that meet in a task
are the dictionary, the places where they occur are the parse. A phrase carries every byte that the windows
starting in it cover, so the order of the corpus at `WINDOW` bytes follows from the dictionary's suffixes:
they are sorted by their first `WINDOW` bytes, and neighbours that agree on all of them are one string, whose
smallest document is then known for every place of the parse.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from dayfold.llm.common import documents
from dayfold.llm.phrases import Kind, Records, byte_units, entangled, numbered, owner_spans, ranges, runs_of, without_repeats

WINDOW = 50
GRAM = 12


def suffix_order(flat: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at `places` by their first `window` bytes, whether each equals its predecessor)."""
    padded = np.concatenate((flat, np.zeros(8, np.uint8))).astype(np.uint64)
    words = padded[:-7] << np.uint64(56)
    for i in range(1, 8):
        words |= padded[i:len(padded) - 7 + i] << np.uint64(56 - 8 * i)
    steps = [*range(0, window - 8, 8), window - 8]
    keys = [words[places + s] for s in steps]
    order = np.lexsort(keys[::-1])
    same = np.zeros(len(order), bool)
    if len(order):
        same[1:] = np.logical_and.reduce([k[order][1:] == k[order][:-1] for k in keys])
    return order, same


def earlier_in_smaller_doc(records: Records, kind: Kind) -> list[np.ndarray]:
    """Spans (doc, version, begin, end) of the windows that also start in a smaller document."""
    if not len(records.doc):
        return [records.doc, records.version, records.start, records.start]
    number, flat, offsets = numbered(records.data, records.size)
    size = np.diff(offsets)
    windows = size - kind.window + 1
    first, spans, owners = owner_spans(records, number, windows, kind)
    least = records.doc[first]
    some = np.flatnonzero(entangled(byte_units(flat, offsets), records.shift[first], kind))
    if not len(some):
        return spans
    begin = np.concatenate(([0], np.cumsum(size[some])))
    mine = flat[ranges(offsets[some], size[some])]
    places = ranges(begin[:-1], windows[some])
    text = np.repeat(np.arange(len(some)), windows[some])
    order, same = suffix_order(mine, places, kind.window)
    heads = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    smallest = np.empty(len(order), np.int64)
    smallest[order] = np.minimum.reduceat(least[some][text[order]], heads)[group]
    a, b = runs_of(smallest < least[some][text], text)
    # the runs of a phrase hold for all its places in its smallest document
    cuts = np.searchsorted(text[a], np.arange(len(some) + 1))
    where = np.full(len(size), -1)
    where[some] = np.arange(len(some))
    rows = np.flatnonzero(owners & (where[number] >= 0))
    at = where[number[rows]]
    times = cuts[at + 1] - cuts[at]
    run, row = ranges(cuts[at], times), np.repeat(rows, times)
    shift = np.concatenate(([0], np.cumsum(windows[some])))[np.repeat(at, times)]
    found = [records.doc[row], records.version[row], records.start[row] + a[run] - shift, records.start[row] + b[run] - shift + kind.window - 1]
    return [np.concatenate(x) for x in zip(spans, found)]


KIND = Kind(WINDOW, GRAM, False, earlier_in_smaller_doc)
SPANS = "array<struct<begin: bigint, end: bigint>>"


def _kept(data: bytes, spans: tuple | None) -> bytes:
    if spans is None:
        return data
    edges = [0, *np.column_stack(spans).ravel().tolist(), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def _results(id_col: str, text_col: str):
    def finish(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        texts = [(t or "").encode() for t in batch.column(text_col).to_pylist()]
        kept = [_kept(t, s) for t, s in zip(texts, found)]
        spans = [[] if s is None else [{"begin": a, "end": b} for a, b in zip(s[0].tolist(), s[1].tolist())] for s in found]
        columns = [
            pc.cast(batch.column(id_col), pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
            pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    return finish


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans removed (byte places), kept_sha256.

    A byte goes if a `WINDOW`-byte string over it also starts in a document with a smaller id. Rows of one id
    do not remove each other; null ids rank behind all others; a null or empty text loses nothing.
    """
    schema = f"doc_id long, n_bytes long, n_removed long, spans {SPANS}, kept_sha256 string"
    return without_repeats(docs.select(id_col, text_col), KIND, _results(id_col, text_col), schema, id_col, text_col)


def _rewritten(names: list[str], text_col: str, chars_col: str):
    def finish(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        texts = [t if s is None or t is None else _kept(t.encode(), s).decode(errors="ignore") for t, s in zip(batch.column(text_col).to_pylist(), found)]
        columns = {n: batch.column(n) for n in names}
        columns[text_col] = pa.array(texts, pa.string())
        if chars_col in columns:
            sizes = [old if s is None or t is None else len(t) for t, s, old in zip(texts, found, columns[chars_col].to_pylist())]
            columns[chars_col] = pa.array(sizes, columns[chars_col].type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names)

    return finish


def without_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents, all columns, with the repeated bytes cut out of the text and its length set anew.

    Where a cut leaves part of a character's bytes, these go too. Untouched rows come back as they are.
    """
    return without_repeats(docs, KIND, _rewritten(docs.columns, text_col, chars_col), docs.schema, id_col, text_col)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_bytes(documents(spark, sf_dir))
    return rows.selectExpr("doc_id", "n_bytes", "n_removed", "cast(size(spans) as long) AS n_spans", "kept_sha256")


OP3_ORACLE = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
places AS (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM docs WHERE n >= 50),
strings AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM places),
firsts AS (SELECT s, min(doc_id) AS d FROM strings GROUP BY s),
hits AS (SELECT doc_id, i, i + 50 AS e FROM strings JOIN firsts USING (s) WHERE d < doc_id),
marked AS (SELECT doc_id, i, e, max(e) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM hits),
numbered AS (SELECT doc_id, i, e, sum(CASE WHEN reach IS NULL OR i > reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM marked),
spans AS (SELECT doc_id, g, min(i) AS a, max(e) AS b FROM numbered GROUP BY doc_id, g),
gaps AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS k, max(b) AS last, sum(b - a) AS cut, count(*) AS spans FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(cut, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN last IS NULL THEN h ELSE k || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""
