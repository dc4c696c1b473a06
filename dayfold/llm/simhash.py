"""Near duplicates by SimHash: 64-bit fingerprints, pigeonhole blocks, exact Hamming check, components.

A fingerprint pair at most 4 bits apart agrees on at least 3 of 7 blocks, so each distinct fingerprint is
filed under the 35 choices of 3 blocks (27 to 28 bits). Fingerprints that share a choice meet, and the
Hamming distance decides. Equal fingerprints are one node, so copies cost nothing. A choice that more than
`BUCKET` distinct fingerprints share is split once more by the same principle: the bits left fall into five
blocks, one of which must agree. The splitting ends at the latest when no more than 4 bits are left, as all
fingerprints of such a bucket are close. No pair list is made: a bucket yields the links of a spanning
forest of its close pairs, at most one per member, and the components are those of all close pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayfold.llm.common import documents, free_name, keyed_text, released, written
from dayfold.llm.components import components
from dayfold.llm.shingles import representatives

DISTANCE = 4
BLOCKS = 7
#: Distinct fingerprints that one task compares with each other; larger buckets are split by more blocks.
BUCKET = 512
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
STEP = 1 << 15


def simhash(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Majority bits of the XXH64 values of all word shingles, as an unsigned number; 0 without words."""
    words = WORD.findall(text.lower())
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    begin, end = starts[:len(words) - width + 1].tolist(), ends[width - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(begin), STEP):
        values = np.array([digest(joined[a:b], seed) for a, b in zip(begin[at:at + STEP], end[at:at + STEP])], np.uint64)
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(begin), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([simhash(t.as_py().encode()) for t in batch.column("text")], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per document, fp the fingerprint's 64 bits as a signed long."""
    return keyed_text(docs, id_col, text_col).mapInArrow(released(_fingerprints), "doc_id long, fp long")


def _spread(bits: list[int], parts: int) -> list[list[int]]:
    cuts = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def _mask(bits: list[int]) -> int:
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def first_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """Every choice of `blocks - distance` of the blocks, as a mask; a close pair agrees on one of them."""
    return [_mask(sum(choice, [])) for choice in combinations(_spread(list(range(64)), blocks), blocks - distance)]


def next_masks(mask: int, distance: int = DISTANCE) -> list[int]:
    """The mask with one more of the `distance + 1` blocks that the other bits fall into."""
    left = [b for b in range(64) if not (mask >> b) & 1]
    return [mask | _mask(part) for part in _spread(left, distance + 1)] if len(left) > distance else []


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[int, list[int]] = {}
    for batch in batches:
        fps, masks = [], []
        for fp, mask in zip(batch.column("fp").to_pylist(), batch.column("mask").to_pylist()):
            if mask not in known:
                known[mask] = next_masks(mask)
            fps += [fp] * len(known[mask])
            masks += known[mask]
        yield pa.RecordBatch.from_arrays([pa.array(fps, pa.int64()), pa.array(masks, pa.int64())], ["fp", "mask"])


def spanning_links(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """(member, smallest member) for every component of the close pairs among a bucket's fingerprints."""
    if len(fps) == 2:
        a, b = int(fps[0]), int(fps[1])
        return [(max(a, b), min(a, b))] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance else []
    fps = np.sort(fps)
    close = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= distance
    label = np.arange(len(fps))
    while True:
        found = np.where(close, label[None, :], len(fps)).min(axis=1)
        found = np.minimum(found, found[found])
        if (found == label).all():
            break
        label = found
    return [(int(fps[i]), int(fps[j])) for i, j in enumerate(label.tolist()) if i != j]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("fps")
        values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
        links = [x for a, b in zip(offsets, offsets[1:]) for x in spanning_links(values[a:b])]
        if links:
            u, v = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def close_links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between distinct fingerprints `fp`; their components are those of all close pairs."""
    masks = F.array(*[F.lit(m) for m in first_masks()])
    partitions = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes, but 35 rows from each: by their size alone they would be merged into very few tasks
    filed = fps.repartition(partitions, "fp").select("fp", F.explode(masks).alias("mask"))
    links = None
    while True:
        key = [F.col("mask"), F.col("fp").bitwiseAND(F.col("mask")).alias("part")]
        filed = filed.select("fp", *key)
        shared = filed.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1")
        # without the hint one side may be sent to the driver: its size is taken from before the explode
        shared = written(filed.join(shared.hint("merge"), ["mask", "part"]), "blocks")
        light = shared.where(F.col("n") <= BUCKET).groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))
        found = light.select("fps").mapInArrow(_links, "u long, v long")
        links = found if links is None else links.union(found)
        dense = shared.where(F.col("n") > BUCKET).select("fp", "mask", "part")
        if dense.isEmpty():
            return links
        left = F.lit(64) - F.bit_count("mask")
        whole = dense.where(left <= DISTANCE)
        least = whole.groupBy("mask", "part").agg(F.min("fp").alias("v"))
        links = links.union(whole.join(least, ["mask", "part"]).select(F.col("fp").alias("u"), "v"))
        filed = dense.where(left > DISTANCE).select("fp", "mask").mapInArrow(_refine, "fp long, mask long").distinct()


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    The component id is the smallest doc_id reachable over fingerprints at most 4 bits apart. A null or
    empty text has fingerprint zero and links like any other. A null doc_id keeps its row and links its
    fingerprint, but never names a component unless no other id is there. Repeated rows repeat.
    Every row is used; an empty table gives an empty result.
    """
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(close_links(nodes.select("fp")))
    # the hints: compressed files look far smaller than the rows that a broadcast would bring to the driver
    placed = nodes.join(roots.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = written(placed, "placed")  # so that a large component is summed before it is shuffled, and its join can be split
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "components")
    named = placed.join(least.hint("merge"), "root").select("fp", "component_id")
    return rows.join(named.hint("merge"), "fp").select("doc_id", hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """The documents, whole rows, whose doc_id is the smallest of its near-duplicate group.

    The groups are those of `shingles` (SimHash over five words, similarity 0.8), not those of `near_duplicates`.
    Repeated rows of one doc_id are one document and give one row, the one whose hash is smallest. Rows with a
    null doc_id cannot be named as a group's representative by others and stay as they are.
    """
    keep = representatives(docs)
    named = docs.join(keep, docs["doc_id"] == keep["_kept"], "left_semi")
    place = free_name(docs, "_place")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64(*docs.columns), F.hash(*docs.columns))
    named = named.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1).drop(place)
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
