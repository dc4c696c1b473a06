"""Packing by concatenating and cutting.

All documents, each closed by the end id, form one long row of ids that is cut every `SEQUENCE` ids. The
first pass tokenizes once and writes each document's ids with their place inside the task; prefix sums over
the task totals (one row per task) turn this into a global place; the second pass cuts at the multiples of
the sequence length. Only the very last sequence can be short.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from dayfold.llm.common import documents, keyed_text, released, written

SEQUENCE = 2048
END = 1
#: Documents that a Python worker holds as ids at a time.
ROWS = 128
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, `offset` long, ids binary"


def _byte_letters() -> dict[str, int]:
    """The bytes that the letters of a byte-level vocabulary stand for: printable ones for themselves, the others in order from 256."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _with_added(ordinary: Callable[[str], list[int]], added: dict[str, int]) -> Callable[[str], list[int]]:
    """Ids of a text in which the longest added token at each place stands for itself."""
    cut = re.compile("(" + "|".join(re.escape(w) for w in sorted(added, key=len, reverse=True)) + ")")

    def encoded(text: str) -> list[int]:
        parts = cut.split(text)
        if len(parts) == 1:
            return ordinary(text)
        return [i for k, part in enumerate(parts) if part for i in ([added[part]] if k % 2 else ordinary(part))]

    return encoded


@lru_cache(maxsize=4)
def _encoder(path: str, added: bool) -> Callable[[list[str]], list[list[int]]]:
    """Ids of a tokenizer file; none are put around a text.

    The file's added tokens, where a text spells one out, keep their own ids if `added`, and are plain text if not.

    A plain byte-level BPE whose ids are in merge order is run as rank merges, some ten times as fast and with
    the same ids; any other file is left to its own library.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, splits = spec["model"], spec.get("pre_tokenizer") or {}
    if model["type"] == "BPE" and not spec.get("normalizer") and splits.get("type") == "ByteLevel" and splits.get("use_regex") and not splits.get("add_prefix_space"):
        vocab, byte = model["vocab"], _byte_letters()
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        tokens = spec.get("added_tokens", [])
        special = {t["content"] for t in tokens}
        plain = not any(t.get(k) for t in tokens for k in ("single_word", "lstrip", "rstrip")) and all(t.get("special") for t in tokens)
        if joined == sorted(joined) and plain:
            ranks = {bytes(map(byte.__getitem__, w)): i for w, i in vocab.items() if w not in special}
            encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            one = _with_added(encoding.encode_ordinary, {t["content"]: t["id"] for t in tokens}) if added and tokens else encoding.encode_ordinary
            return lambda texts: [one(t) for t in texts]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not added
    return lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def encode(texts: list[str], path: str, added: bool = False) -> list[list[int]]:
    return _encoder(path, added)(texts)


def token_table(docs: DataFrame, tokenizer: str, end: int = END, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """Written table of (doc_id, task, place, n, ids): a document's ids and its place within its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = [np.array([*x, end], "<u4").tobytes() for x in encode(part.column("text").to_pylist(), tokenizer, added)]
                n = [len(x) // 4 for x in ids]
                places = list(accumulate(n, initial=place))
                place = places.pop()
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([task] * len(n), pa.int32()), pa.array(places, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "task", "place", "n", "ids"],
                )

    return written(keyed_text(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, task int, place long, n long, ids binary"), "tokens")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            out: list[list] = [[] for _ in range(7)]
            for doc, begin, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "begin", "n", "ids"))):
                start = 0
                while start < n:
                    sequence, offset = divmod(begin + start, length)
                    size = min(length - offset, n - start)
                    for column, value in zip(out, (doc, start, size, n, sequence, offset, ids[4 * start:4 * (start + size)])):
                        column.append(value)
                    start += size
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            types = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = SEQUENCE, end: int = END, id_col: str = "doc_id", text_col: str = "text", added: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, unsigned 32 bit).

    A null or empty text is the end id alone; for `added` see `_encoder`. Every row is packed, repeated rows and
    null ids too; an empty
    table gives no piece.
    """
    tokens = token_table(docs, tokenizer or public_tokenizers.path("byte_bpe_50k.json"), end, id_col, text_col, added)
    totals = tokens.groupBy("task").agg(F.sum("n").alias("n")).orderBy("task").collect()  # one row per task of the first pass
    before = list(zip((r.task for r in totals), accumulate((r.n for r in totals), initial=0)))
    bases = docs.sparkSession.createDataFrame(before, "task int, base long")
    placed = tokens.join(F.broadcast(bases), "task").select("doc_id", (F.col("base") + F.col("place")).alias("begin"), "n", "ids")
    return placed.mapInArrow(released(_cut(length)), PIECE)


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums = pa.array([zlib.crc32(x.as_buffer()) for x in batch.column("ids")], pa.int64())
        i = batch.schema.get_field_index("ids")
        yield batch.set_column(i, "ids_crc32", sums)


def pieces_with_checksum(pieces: DataFrame) -> DataFrame:
    return pieces.mapInArrow(_checksums, PIECE.replace("ids binary", "ids_crc32 long"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the pieces of each sequence joined in order; a group holds one sequence's ids at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(joined.alias("ids"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces_with_checksum(pack(documents(spark, sf_dir), added=True))
