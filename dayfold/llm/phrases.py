"""Repeated windows of documents: parsing into phrases, routing by trigger, and putting the results together.

A unit is a byte or a word, a window some consecutive units of one text. A trigger is the gram (a few units)
whose rolling hash is smallest within a window, the leftmost one of equals. Which gram that is depends on the
window's content alone, so equal windows have equal triggers, and no window is without one. A phrase is a
maximal run of windows with one trigger, written out with all the units its windows cover, so that it needs
no neighbour. Phrases of one trigger meet in one task (a bucket of triggers); each task first reduces what it
has parsed to distinct phrases, so a passage that very many documents share is sent once per parse.

Rows travel as compressed blocks of many records: `bucket` rows hold phrases and their places, `part` rows
hold documents or spans to remove, and a part's rows end up together in the last step.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayfold.llm.common import free_name, give_back, importable, released, slices, text_buffers
from dayfold.llm.syncmers import gram_hashes, mixed, sliding_min

#: Units of one parse; their places fit into the low bits of a packed hash.
PLACE_BITS = 21
PARSE = 2_000_000
PLACES = np.uint64((1 << PLACE_BITS) - 1)
#: Bytes of text for each bucket and part, and how many there are at least.
SHARE = 16_000_000
LEAST = 64
#: A bucket is resolved in so many pieces, one after the other.
PIECES = 16
LAST = np.iinfo(np.int64).max
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64))
SPACE = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


class Kind(NamedTuple):
    """What a window is: `window` units with triggers of `gram` units; units are words or bytes."""

    window: int
    gram: int
    words: bool
    resolve: Callable


class Units(NamedTuple):
    codes: np.ndarray  # hash of each unit
    sizes: np.ndarray  # units of each text
    begin: np.ndarray  # first byte of each unit in `flat`
    flat: np.ndarray   # the bytes; words are followed by one space each


class Phrases(NamedTuple):
    text: np.ndarray     # number of the text
    start: np.ndarray    # unit of the text at which the first window starts
    windows: np.ndarray  # number of windows
    shift: np.ndarray    # units from there to the trigger
    trigger: np.ndarray  # hash of the trigger
    first: np.ndarray    # the start among all units


class Records(NamedTuple):
    """Phrases on their way: the strings and where each occurs."""

    doc: np.ndarray
    version: np.ndarray
    start: np.ndarray
    shift: np.ndarray
    size: np.ndarray  # bytes of the string
    data: np.ndarray


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin, begin + 1, ... of every range, one range after the other."""
    ends = np.cumsum(size)
    if not len(ends):
        return np.zeros(0, np.int64)
    kind = np.int32 if max(int(ends[-1]), int((begin + size).max())) < 1 << 31 else np.int64
    out = np.arange(ends[-1], dtype=kind)
    out -= np.repeat((ends - size - begin).astype(kind), size)
    return out


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0xD1342543DE82EF95
    both = []
    for b in (base, pow(base, -1, 1 << 64)):
        steps = np.full(n, b, np.uint64)
        steps[0] = 1
        both.append(np.cumprod(steps))
    return both[0], both[1]


def range_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each range of units: prefix sums of a polynomial, moved back by powers of the base's inverse."""
    size = 1 << max(21, int(len(codes) + 1).bit_length())
    powers, back = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers[:len(codes)], dtype=np.uint64)))
    return mixed((sums[end] - sums[begin]) * back[begin])


def byte_units(flat: np.ndarray, offsets: np.ndarray) -> Units:
    return Units(BYTE_CODES[flat], np.diff(offsets), np.arange(len(flat) + 1), flat)


def word_units(flat: np.ndarray, offsets: np.ndarray) -> Units:
    """Words of the texts, rewritten with one space after each."""
    inside = ~SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1] if len(flat) else inside
    after = np.concatenate((inside[1:], [False])) & ~edge[1:] if len(flat) else inside
    begin, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    sizes = np.diff(np.searchsorted(begin, offsets))
    codes = range_hashes(BYTE_CODES[flat], begin, end)
    length = end - begin + 1
    moved = np.concatenate(([0], np.cumsum(length)))
    out = np.full(moved[-1], 0x20, np.uint8)
    out[ranges(moved[:-1], length - 1)] = flat[ranges(begin, length - 1)]
    return Units(codes, sizes, moved, out)


def parse(codes: np.ndarray, sizes: np.ndarray, window: int, gram: int) -> Phrases:
    """The phrases of texts that stand one after the other in `codes`, `sizes` units each."""
    ends = np.cumsum(sizes)
    if len(codes) < window:
        empty = np.zeros(0, np.int64)
        return Phrases(empty, empty, empty, empty, empty.astype(np.uint64), empty)
    grams = mixed(gram_hashes(codes, gram))
    packed = (grams & ~PLACES) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(packed, window - gram + 1) & PLACES
    until = np.repeat(ends, sizes)[:len(least)]
    places = np.flatnonzero(np.arange(len(least)) + window <= until)
    trigger = least[places].astype(np.int64)
    cut = np.flatnonzero(np.diff(trigger, prepend=-1))
    first = places[cut]
    windows = np.diff(cut, append=len(places))
    at = trigger[cut]
    text = np.searchsorted(ends, first, side="right")
    return Phrases(text, first - (ends - sizes)[text], windows, at - first, grams[at], first)


def segments(sizes: np.ndarray, window: int) -> Iterator[list[tuple[int, int, int]]]:
    """Lists of (text, first unit, units) of PARSE units at most; a longer text comes in overlapping pieces."""
    group, total = [], 0
    for text, n in enumerate(sizes.tolist()):
        base = 0
        while n - base >= window:
            size = min(PARSE, n - base)
            if total + size > PARSE:
                yield group
                group, total = [], 0
            group.append((text, base, size))
            total += size
            base += size - window + 1
    if group:
        yield group


def _planes(values: np.ndarray, kind: str) -> bytes:
    """The values byte by byte: all lowest bytes, then all second ones, and so on."""
    return values.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()


def _unplanes(data: bytes, at: int, n: int, kind: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize * n
    block = np.frombuffer(data, np.uint8, size, at).reshape(-1, n)
    return np.ascontiguousarray(block.T).reshape(-1).view(kind).astype(np.int64), at + size


def pack(columns: list[np.ndarray], data: np.ndarray | None = None, counts: np.ndarray | None = None) -> bytes:
    """Columns of whole numbers (the first two as differences), the counts of pieces, then raw bytes."""
    head = np.zeros(PIECES, np.int64) if counts is None else counts
    body = [np.array([len(columns[0]), len(columns), *head], "<i8").tobytes()]
    for i, c in enumerate(columns):
        body.append(_planes(np.diff(c, prepend=0) if i < 2 else c, "<i8" if i < 2 else "<u4"))
    return zstandard.ZstdCompressor(level=9).compress(b"".join(body) + (b"" if data is None else data.tobytes()))


def unpack(block: bytes) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(block)
    n, width, *counts = np.frombuffer(data, "<i8", 2 + PIECES).tolist()
    at, columns = 8 * (2 + PIECES), []
    for i in range(width):
        column, at = _unplanes(data, at, n, "<i8" if i < 2 else "<u4")
        columns.append(np.cumsum(column) if i < 2 else column)
    return columns, np.array(counts), np.frombuffer(data, np.uint8, len(data) - at, at)


def strings(data: np.ndarray, size: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def numbered(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of each string, bytes and offsets of the distinct strings); equal strings have one number."""
    found = strings(data, size).dictionary_encode()
    flat, offsets = text_buffers(found.dictionary)
    return found.indices.to_numpy().astype(np.int64), flat, offsets


def part_of(doc: np.ndarray, version: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(doc.astype(np.uint64) ^ mixed(version.astype(np.uint64))) % np.uint64(parts)).astype(np.int64)


def joined(doc: np.ndarray, version: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """The spans of each document with overlapping and touching ones made one."""
    if not len(doc):
        return [doc, version, begin, end]
    order = np.lexsort((begin, version, doc))
    doc, version, begin, end = doc[order], version[order], begin[order], end[order]
    fresh = np.concatenate(([True], (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))
    number = np.cumsum(fresh) - 1
    lift = number * (int(end.max()) + 1)  # one running maximum for all documents
    reach = np.maximum.accumulate(end + lift)
    start = fresh | np.concatenate(([True], begin[1:] + lift[1:] > reach[:-1]))
    first = np.flatnonzero(start)
    last = np.append(first[1:], len(doc)) - 1
    return [doc[first], version[first], begin[first], reach[last] - lift[last]]


def span_rows(spans: list[np.ndarray], parts: int, shift: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """Rows (part, 1, block) of the spans."""
    spans = joined(*spans)
    part = part_of(spans[0], spans[1], parts)
    for p in np.unique(part).tolist():
        mine = part == p
        yield p + shift, 1, pack([s[mine] for s in spans])


def row_batch(rows: list[tuple[int, int, bytes]], key: str) -> pa.RecordBatch:
    keys, kinds, blocks = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blocks, pa.binary())], [key, "kind", "block"])


def _phrase_rows(units: Units, group: list[tuple[int, int, int]], doc: np.ndarray, version: np.ndarray, kind: Kind, buckets: int, parts: int) -> list[tuple[int, int, bytes]]:
    text, base, size = (np.array(x) for x in zip(*group))
    taken = ranges(np.concatenate(([0], np.cumsum(units.sizes)))[text] + base, size)
    p = parse(units.codes[taken], size, kind.window, kind.gram)
    if not len(p.text):
        return []
    origin = taken[p.first]
    begin = units.begin[origin]
    length = units.begin[origin + p.windows + kind.window - 1] - begin - kind.words
    data = units.flat[ranges(begin, length)]
    number, _, _ = numbered(data, length)
    docs, versions, start = doc[text[p.text]], version[text[p.text]], p.start + base[p.text]
    order = np.lexsort((start, versions, docs, number))
    head = np.concatenate(([True], number[order][1:] != number[order][:-1]))
    owner = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    repeated = np.empty(len(order), bool)
    places = (docs, versions, start) if kind.words else (docs,)
    repeated[order] = np.logical_or.reduce([x[order] != x[order][owner] for x in places])
    spans = [x[repeated] for x in (docs, versions, start, start + p.windows + kind.window - 1)]
    rows = list(span_rows(spans, parts, buckets))
    piece = ((p.trigger >> np.uint64(PLACE_BITS)) % np.uint64(buckets * PIECES)).astype(np.int64)
    sent = np.flatnonzero(~repeated)
    sent = sent[np.lexsort((start[sent], docs[sent], piece[sent]))]
    offsets = np.concatenate(([0], np.cumsum(length)))
    cuts = np.searchsorted(piece[sent], np.arange(buckets * PIECES + 1))
    for b in range(buckets):
        mine = sent[cuts[b * PIECES]:cuts[(b + 1) * PIECES]]
        if len(mine):
            counts = np.diff(cuts[b * PIECES:(b + 1) * PIECES + 1])
            columns = [docs[mine], versions[mine], start[mine], p.shift[mine], length[mine]]
            rows.append((b, 0, pack(columns, data[ranges(offsets[mine], length[mine])], counts)))
    return rows


def _parse_batches(kind: Kind, buckets: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, versions = (batch.column(i).to_numpy() for i in (0, 1))
            flat, offsets = text_buffers(batch.column(2))
            for a, b in slices(np.diff(offsets), PARSE):
                mine = flat[offsets[a]:offsets[b]]
                units = (word_units if kind.words else byte_units)(mine, offsets[a:b + 1] - offsets[a])
                for group in segments(units.sizes, kind.window):
                    yield row_batch(_phrase_rows(units, group, docs[a:b], versions[a:b], kind, buckets, parts), "bucket")

    return run


def piece_records(blocks: list[tuple], piece: int) -> Records:
    """What the blocks of a bucket hold for one of its pieces."""
    columns: list[list] = [[] for _ in range(5)]
    data = []
    for values, counts, flat, offsets in blocks:
        a = int(counts[:piece].sum())
        b = a + int(counts[piece])
        for column, v in zip(columns, values):
            column.append(v[a:b])
        data.append(flat[offsets[a]:offsets[b]])
    return Records(*(np.concatenate(c) for c in columns), np.concatenate(data))


def _resolve_bucket(kind: Kind, parts: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        blocks, rows = [], []
        for key, k, block in zip(table.column("bucket").to_pylist(), kinds, table.column("block")):
            if k == 1:  # spans found within one parse pass through
                rows.append((key - buckets, 1, block.as_py()))
            else:
                values, counts, flat = unpack(block.as_py())
                blocks.append((values, counts, flat, np.concatenate(([0], np.cumsum(values[4])))))
        for piece in range(PIECES if blocks else 0):
            rows += span_rows(kind.resolve(piece_records(blocks, piece), kind), parts)
        give_back()
        return pa.Table.from_batches([row_batch(rows, "part")])

    return run


def owner_spans(records: Records, number: np.ndarray, windows: np.ndarray, kind: Kind) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(first record of each distinct phrase, spans of records that an earlier one repeats wholly, others).

    Bytes: earlier is a smaller doc. Words: a smaller doc, or the same and an earlier start.
    """
    order = np.lexsort((records.start, records.version, records.doc, number))
    head = np.flatnonzero(np.concatenate(([True], number[order][1:] != number[order][:-1]))) if len(order) else order
    first = order[head]
    places = (records.doc, records.version, records.start) if kind.words else (records.doc,)
    whole = np.logical_or.reduce([x != x[first][number] for x in places])
    end = records.start + windows[number] + kind.window - 1
    return first, [x[whole] for x in (records.doc, records.version, records.start, end)], ~whole


def entangled(units: Units, shift: np.ndarray, kind: Kind) -> np.ndarray:
    """Which distinct phrases may share a window with another one.

    A window has at least half of its other units on one side of its trigger, so two phrases with a common
    window agree on the trigger and that many units before it, or after it.
    """
    half = (kind.window - kind.gram + 1) // 2
    ends = np.cumsum(units.sizes)
    trigger = ends - units.sizes + shift
    shared = np.zeros(len(shift), bool)
    for begin, end, there in ((trigger - half, trigger + kind.gram, shift >= half), (trigger, trigger + kind.gram + half, trigger + kind.gram + half <= ends)):
        which = np.flatnonzero(there)
        keys = range_hashes(units.codes, begin[which], end[which])
        _, back, n = np.unique(keys, return_inverse=True, return_counts=True)
        shared[which[n[back] > 1]] = True
    return shared


def runs_of(flags: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, end) of the maximal runs of set flags that stay within one text."""
    edge = np.diff(text, prepend=-1) != 0
    before = np.concatenate(([False], flags[:-1])) & ~edge if len(flags) else flags
    after = np.concatenate((flags[1:], [False])) & ~np.append(edge[1:], True) if len(flags) else flags
    return np.flatnonzero(flags & ~before), np.flatnonzero(flags & ~after) + 1


def _documents_by_part(parts: int, doc: str, version: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))
        for batch in batches:
            part = part_of(batch.column(doc).to_numpy(), batch.column(version).to_numpy(), parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.unique(part).tolist():
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema, options=options) as out:
                    out.write_batch(batch.take(pa.array(order[cuts[p]:cuts[p + 1]])))
                yield row_batch([(p, 0, sink.getvalue().to_pybytes())], "part")

    return run


def _assemble(finish: Callable, doc: str, version: str):
    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        spans: list[list] = [[np.zeros(0, np.int64)] for _ in range(4)]
        texts = []
        for k, block in zip(table.column("kind").to_pylist(), table.column("block")):
            if k == 0:
                texts.append(block)
            else:
                for column, found in zip(spans, unpack(block.as_py())[0]):
                    column.append(found)
        docs, versions, begin, end = joined(*(np.concatenate(c) for c in spans))
        at = np.flatnonzero(np.concatenate(([True], (docs[1:] != docs[:-1]) | (versions[1:] != versions[:-1])))) if len(docs) else docs
        until = np.append(at[1:], len(docs))
        known = {(d, v): (a, b) for d, v, a, b in zip(docs[at].tolist(), versions[at].tolist(), at.tolist(), until.tolist())}
        for block in texts:
            for batch in pa.ipc.open_stream(pa.py_buffer(block.as_py())):
                keys = zip(batch.column(doc).to_pylist(), batch.column(version).to_pylist())
                found = [(begin[slice(*known[k])], end[slice(*known[k])]) if k in known else None for k in keys]
                yield from finish(batch, found)

    def whole(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(run(table)))
        give_back()
        return out

    return whole


def without_repeats(docs: DataFrame, kind: Kind, finish: Callable, schema: StructType | str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that `finish(batch, spans)` makes of each document and its repeated units.

    `finish` gets batches of the documents, all columns, and per row None or (begin, end) arrays of maximal
    repeated spans, in units. A null id ranks behind all others, a null text is empty. Rows of one id with
    different texts are told apart by a hash of the text, identical rows have identical results.
    """
    spark = docs.sparkSession
    importable(spark)
    doc, version = free_name(docs, "doc_key"), free_name(docs, "text_version")
    text = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = parts = max(LEAST, int(total // SHARE))
    docs = docs.withColumn(doc, F.coalesce(F.col(id_col).cast("long"), F.lit(int(LAST))))
    repeated = docs.groupBy(doc).agg(F.count("*").alias("n")).where("n > 1").select(F.col(doc).alias("key"))
    if repeated.isEmpty():
        docs = docs.withColumn(version, F.lit(0).cast("long"))
    else:
        docs = docs.join(repeated, docs[doc] == repeated["key"], "left")
        docs = docs.withColumn(version, F.when(F.col("key").isNotNull(), F.xxhash64(text)).otherwise(0)).drop(repeated["key"])
    phrases = docs.select(doc, version, text.alias("text")).mapInArrow(released(_parse_batches(kind, buckets, parts)), "bucket int, kind int, block binary")
    spans = phrases.groupBy("bucket").applyInArrow(_resolve_bucket(kind, parts, buckets), "part int, kind int, block binary")
    texts = docs.mapInArrow(released(_documents_by_part(parts, doc, version)), "part int, kind int, block binary")
    return spans.union(texts).groupBy("part").applyInArrow(_assemble(finish, doc, version), schema)
