"""Best-fit packing: few sequences of at most `LENGTH` tokens, with documents whole unless longer than that.

A longer document gives full pieces, each a sequence of its own, and a last piece. Last pieces and short
documents are items. Items are dealt into groups of about `GROUP` by the hash of their place in the token
table, which no source or copy can crowd. A group packs its items by best fit and then searches locally: its
emptiest sequence hands its items to the others by moves, one-for-one and two-for-one exchanges, each of
which makes the sum of squared fills larger, until sequences are empty or no step is left. A group keeps its
fuller sequences; the items of its emptiest ones are dealt into fewer groups again, down to one group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayfold.llm.common import documents, keyed_text, released, written
from dayfold.llm.word_bpe import encoder

LENGTH = 4096
END = 1
#: Items that one group packs, about.
GROUP = 4096
#: A group hands on one in so many of its sequences, the emptiest ones, as long as there are other groups.
HANDED_ON = 8
#: Sequences in a row that a group tries to empty without success before its search ends.
TRIES = 8
#: Documents that a Python worker holds as ids at a time.
ROWS = 128
TOKENS = "doc_id long, task int, row long, full long, n long, ids binary"
ITEMS = "task int, row long, size int, sequence_id long, `offset` long"


def best_fit(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Items (their numbers) of each sequence: largest first, each into the fullest sequence with room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some sequence has room r
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms &= ~(1 << room)
        else:
            b, room = len(bins), length
            bins.append([])
        bins[b].append(i)
        with_room[room - size].append(b)
        rooms |= 1 << (room - size)
    return bins


def _sums(items: list[int], size: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(sum, items) of each item and each two items of a sequence.

    Items of one size are interchangeable, so at most two of a size are used: a sequence of 4,096 tokens has
    at most 90 different sizes.
    """
    seen: dict[int, int] = {}
    few = []
    for i in items:
        seen[size[i]] = seen.get(size[i], 0) + 1
        if seen[size[i]] <= 2:
            few.append(i)
    return [(size[i], (i,)) for i in few] + [(size[i] + size[j], (i, j)) for i, j in combinations(few, 2)]


class _Search:
    """Sequences under search. What a taker may hand back (nothing, an item or two) is held in one array over all sequences."""

    def __init__(self, bins: list[list[int]], sizes: np.ndarray, length: int):
        self.size, self.length = sizes.tolist(), length
        self.bins = [list(b) for b in bins]
        self.room = np.array([length - sum(self.size[i] for i in b) for b in bins], np.int64)
        self.back = [(0, (), b) for b in range(len(bins))]
        for b, items in enumerate(self.bins):
            self.back += [(s, x, b) for s, x in _sums(items, self.size)]
        self.sums = np.array([x[0] for x in self.back], np.int64)
        self.owner = np.array([x[2] for x in self.back], np.int64)
        self.count = np.array([len(x[1]) for x in self.back], np.int64)

    def step(self, giver: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """(taker, items given, items handed back) that moves most tokens; the first of equals; None without a step."""
        open_to = (self.owner != giver) & (self.room[self.owner] > 0) & (self.room[self.owner] <= self.room[giver])
        at = np.flatnonzero(open_to)
        sums, room, count = self.sums[at], self.room[self.owner[at]], self.count[at]
        best, found = 0, None
        for total, given in _sums(self.bins[giver], self.size):
            moved = total - sums
            fits = (moved <= room) & (moved > best)
            if len(given) == 2:
                fits &= count < 2
            if fits.any():
                k = int(np.where(fits, moved, 0).argmax())
                best, found = int(moved[k]), (given, self.back[at[k]])
                if best == self.room.max():
                    break
        return found and (found[1][2], found[0], found[1][1])

    def apply(self, giver: int, taker: int, given: tuple[int, ...], taken: tuple[int, ...]) -> None:
        self.bins[giver] = [i for i in self.bins[giver] if i not in given] + list(taken)
        self.bins[taker] = [i for i in self.bins[taker] if i not in taken] + list(given)
        moved = sum(self.size[i] for i in given) - sum(self.size[i] for i in taken)
        self.room[giver] += moved
        self.room[taker] -= moved
        self.refresh(giver, taker)

    def refresh(self, *changed: int) -> None:
        keep = np.flatnonzero(~np.isin(self.owner, changed))
        new = [(s, x, b) for b in changed if self.bins[b] for s, x in [(0, ()), *_sums(self.bins[b], self.size)]]
        self.back = [self.back[i] for i in keep.tolist()] + new
        self.sums = np.concatenate((self.sums[keep], np.array([x[0] for x in new], np.int64)))
        self.owner = np.concatenate((self.owner[keep], np.array([x[2] for x in new], np.int64)))
        self.count = np.concatenate((self.count[keep], np.array([len(x[1]) for x in new], np.int64)))


def local_search(bins: list[list[int]], sizes: np.ndarray, length: int) -> list[list[int]]:
    """The sequences after steps from emptier to fuller ones, each of which makes the sum of squared fills larger.

    The emptiest sequence gives until it is empty or has no step left; then the next one gives. It ends at the
    bound of the total size, or after `TRIES` givers in a row that could not be emptied.
    """
    least, alive, failed = -(-int(sizes.sum()) // length), len(bins), 0
    if alive <= least:
        return bins
    search = _Search(bins, sizes, length)
    stuck: set[int] = set()
    while alive > least and failed < TRIES:
        givers = [b for b in range(len(bins)) if search.bins[b] and b not in stuck and search.room[b] > 0]
        if not givers:
            break
        giver = max(givers, key=lambda b: (search.room[b], -b))
        while search.bins[giver] and (step := search.step(giver)):
            search.apply(giver, *step)
        if search.bins[giver]:
            stuck.add(giver)
            failed += 1
        else:
            alive, failed = alive - 1, 0
            stuck.clear()
    return [b for b in search.bins if b]


def packed_group(sizes: np.ndarray, length: int) -> list[list[int]]:
    """Sequences of a group, the fullest first."""
    bins = local_search(best_fit(sizes, length), sizes, length)
    return sorted(bins, key=lambda b: -int(sizes[b].sum()))


def _round(length: int, rnd: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("row", "ascending")])  # the order in which rows arrive must not matter
        sizes = table.column("size").to_numpy().astype(np.int64)
        group = table.column("group")[0].as_py()
        bins = packed_group(sizes, length)
        kept = len(bins) if last else len(bins) - max(1, len(bins) // HANDED_ON)
        sequence, offset = np.full(len(sizes), -1, np.int64), np.zeros(len(sizes), np.int64)
        for b, items in enumerate(bins[:kept]):
            sequence[items] = ((rnd * (1 << 31) + group) << 25) + b
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        return pa.table({
            "task": table.column("task"), "row": table.column("row"), "size": table.column("size"),
            "sequence_id": pa.array(sequence, mask=sequence < 0), "offset": pa.array(offset),
        })

    return run


def assigned(items: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """(task, row, size, sequence_id, offset) for every item (task, row, size); task and row together are unique."""
    n, rnd, done = items.count(), 0, None
    while True:
        groups = max(1, n // group)
        key = F.pmod(F.xxhash64("task", "row", F.lit(rnd)), F.lit(groups)).alias("group")
        placed = items.select(key, "task", "row", "size").groupBy("group").applyInArrow(_round(length, rnd, groups == 1), ITEMS)
        placed = written(placed, "placed-items")
        kept = placed.where("sequence_id is not null")
        done = kept if done is None else done.union(kept)
        if groups == 1:
            return done
        items = placed.where("sequence_id is null").select("task", "row", "size")
        n, rnd = items.count(), rnd + 1


def token_table(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Written table of (doc_id, task, row, full, n, ids): a document's ids, its place in the table, and the full pieces of its task before it."""
    closing = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, row, full, encode = TaskContext.get().partitionId(), 0, 0, encoder(tokenizer)
        for part in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            ids = [encode(t.as_py()) + closing for t in part.column("text")]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            pieces = np.cumsum(n // length)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.full(len(n), task, np.int32)), pa.array(np.arange(row, row + len(n))), pa.array(full + pieces - n // length), pa.array(n), pa.array(ids, pa.binary())],
                ["doc_id", "task", "row", "full", "n", "ids"],
            )
            row, full = row + len(n), full + int(pieces[-1])

    return written(keyed_text(docs, id_col, text_col).mapInArrow(released(run), TOKENS), "tokens")


def _pieces(length: int, value: Column | None = None) -> Column:
    """The pieces of a document as an array of structs; without `value` a piece carries the ids themselves."""
    def piece(k: Column) -> Column:
        start, size = k * length, F.least(F.lit(length).cast("long"), F.col("n") - k * length)
        ids = F.substring(F.col("ids"), (4 * start + 1).cast("int"), (4 * size).cast("int"))
        return F.struct(k.cast("int").alias("piece"), start.alias("start"), size.alias("length"), (F.crc32(ids).alias("ids_crc32") if value is not None else ids.alias("ids")))

    return F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / length)), piece)


def pack_best_fit(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, id_col: str = "doc_id", text_col: str = "text", checksum: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids (binary, unsigned 32 bit), sequence_id, offset.

    With `checksum` the ids' crc32 (ids_crc32, long) stands instead of the ids. A null or empty text is the end
    id alone; a text of any length is cut into pieces, of which only the last is an item to be packed. Every row
    is packed, repeated rows and null ids too; ties between sizes are settled by the rows' places in the token
    table. Other columns are ignored, whatever their names; an empty table gives no piece.
    """
    tokens = token_table(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), length, end, id_col, text_col)
    rest = (F.col("n") % length).cast("int")
    placed = assigned(tokens.where(rest > 0).select("task", "row", rest.alias("size")), length)
    pieces = tokens.select("doc_id", "task", "row", "full", _pieces(length, F.lit(1) if checksum else None).alias("pieces"))
    both = pieces.join(placed.select("task", "row", "sequence_id", "offset"), ["task", "row"], "left")
    each = both.select("doc_id", "task", "full", "sequence_id", "offset", F.explode("pieces").alias("p"))
    whole = F.col("p.length") == length
    own = -(F.shiftleft(F.col("task").cast("long"), 36) + F.col("full") + F.col("p.piece") + 1)
    return each.select(
        "doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32" if checksum else "p.ids",
        F.when(whole, own).otherwise(F.col("sequence_id")).alias("sequence_id"),
        F.when(whole, F.lit(0).cast("long")).otherwise(F.col("offset")).alias("offset"),
    )


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in as few sequences of 4,096 tokens as best fit and local search find; see `pack_best_fit`."""
    return pack_best_fit(documents(spark, sf_dir), checksum=True)
