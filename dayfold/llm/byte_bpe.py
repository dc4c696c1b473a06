"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

All pre-tokens of a batch share one queue. Their pairs that can merge wait in one bucket per merge rank, which
holds the places of their left parts in a linked list. Two levels of bitmap mark the ranks with a bucket, and
find-first-set on each level gives the lowest one, so picking the next merge costs the same for any length, and
once for all pre-tokens that wait for the same rank; entries that an earlier merge made stale are skipped when
they come up. The work for a pre-token of n bytes grows as n log n.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from dayfold.llm.common import documents, keyed_text, slices

#: The lower bitmap has words of 2 to the power SHIFT ranks.
SHIFT = 8
LOW = (1 << SHIFT) - 1
BITS = [1 << i for i in range(1 << 12)]  # so many words, over a million ranks
#: Bytes of pre-tokens, about, that share a queue.
QUEUED = 1 << 19
#: Bytes of text that a worker holds as pre-tokens at a time.
STEP_BYTES = 2_000_000
#: Distinct pre-tokens that a Python worker remembers.
REMEMBERED = 700_000


def merge(token: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank merges first, of equal ranks the leftmost."""
    return merge_all([token], ranks)[0]


def merge_all(tokens: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each pre-token, as `merge` says.

    The queue: `buckets` has a list of places for each waiting rank, `words` the bits of neighbouring ranks, and
    `summary` one bit for each word that is not empty. Pre-tokens do not touch, so the places of one rank may
    merge in one go, from left to right. A pre-token in which this makes a lower rank keeps its other places
    of the rank in the bucket until that one has merged.
    """
    get = ranks.get
    found = [get(t) for t in tokens]
    open_ = [t for t, whole in zip(tokens, found) if whole is None]
    if not open_:
        return [[whole] for whole in found]
    flat, n = b"".join(open_), sum(map(len, open_))
    ends = np.cumsum([len(t) for t in open_])
    starts = np.concatenate(([0], ends[:-1]))
    stop = np.repeat(ends, ends - starts).tolist()
    after, before = list(range(1, n + 1)), np.arange(-1, n - 1)  # a part is known by its first byte's place
    before[starts[starts < n]] = -1
    before = before.tolist()
    waiting = [-1] * n  # the rank under which a place's pair is queued now
    buckets: dict[int, list[int]] = {}
    pairs: dict[bytes, int | None] = {}
    for i, pair in enumerate(map(bytes, pairwise(flat))):
        if pair in pairs:
            rank = pairs[pair]
        else:
            rank = pairs[pair] = get(pair)
        if rank is not None and i + 1 < stop[i]:
            waiting[i] = rank
            if rank in buckets:
                buckets[rank].append(i)
            else:
                buckets[rank] = [i]
    words: dict[int, int] = {}
    summary = 0
    for rank in buckets:
        word = rank >> SHIFT
        words[word] = words.get(word, 0) | BITS[rank & LOW]
        summary |= BITS[word]
    while summary:
        word = (summary & -summary).bit_length() - 1
        bits = words[word]
        low = bits & -bits
        rank = (word << SHIFT) + low.bit_length() - 1
        places = buckets.pop(rank)
        words[word] = bits ^ low
        if bits == low:
            summary ^= BITS[word]
        places.sort()
        held, later = 0, []  # the end of the pre-token that has a lower rank now, and its places
        for i in places:
            if waiting[i] != rank:
                continue
            if i < held:
                later.append(i)
                continue
            gone = after[i]
            end = after[i] = after[gone]
            waiting[gone] = waiting[i] = -1
            if end < stop[i]:
                before[end] = i
                new = get(flat[i:after[end]])
                if new is not None:
                    waiting[i] = new
                    if new in buckets:
                        buckets[new].append(i)
                    else:
                        buckets[new] = [i]
                        word = new >> SHIFT
                        words[word] = words.get(word, 0) | BITS[new & LOW]
                        summary |= BITS[word]
                    if new < rank:
                        held = stop[i]
            left = before[i]
            if left >= 0:
                new = get(flat[left:end])
                if new is None:
                    waiting[left] = -1
                else:
                    waiting[left] = new
                    if new in buckets:
                        buckets[new].append(left)
                    else:
                        buckets[new] = [left]
                        word = new >> SHIFT
                        words[word] = words.get(word, 0) | BITS[new & LOW]
                        summary |= BITS[word]
                    if new < rank:
                        held = stop[i]
        if later:
            buckets[rank] = later
            word = rank >> SHIFT
            words[word] = words.get(word, 0) | BITS[rank & LOW]
            summary |= BITS[word]
    out, i = [], 0
    for whole, token in zip(found, tokens):
        if whole is not None:
            out.append([whole])
            continue
        ids, end = [], i + len(token)
        while i < end:
            ids.append(ranks[flat[i:after[i]]])
            i = after[i]
        out.append(ids)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], dict[int, bytes], dict]:
    """(ranks by bytes, bytes by id, remembered pre-tokens) of a rank file, once per Python worker."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ranks, {i: b for b, i in ranks.items()}, {}


def encode(text: str, path: str) -> list[int]:
    ranks = vocabulary(path)[0]
    return [i for part in regex.findall(public_tokenizers.PATTERN, text) for i in merge(part.encode(), ranks)]


def decode(ids: list[int], path: str) -> bytes:
    table = vocabulary(path)[1]
    return b"".join([table[i] for i in ids])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, table, known = vocabulary(path)
        split = regex.compile(public_tokenizers.PATTERN).findall
        gc.freeze()  # the vocabulary and what is remembered hold no cycles to look for
        for batch in batches:
            rows, texts = [], batch.column("text")
            for i, j in slices(pc.binary_length(texts).to_numpy(zero_copy_only=False), STEP_BYTES):
                listed = [split(t.as_py()) for t in texts[i:j]]
                if len(known) > REMEMBERED:
                    known.clear()
                unknown = list(set(chain.from_iterable(listed)).difference(known))
                tokens = [part.encode() for part in unknown]
                for k, m in slices(np.fromiter(map(len, tokens), np.int64, len(tokens)), QUEUED):
                    for part, ids in zip(unknown[k:m], merge_all(tokens[k:m], ranks)):
                        known[part] = len(ids), " ".join(map(str, ids)), b"".join([table[x] for x in ids])
                for parts in listed:
                    found = [known[p] for p in parts]
                    ids = " ".join([f[1] for f in found])
                    rows.append((sum([f[0] for f in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(b"".join([f[2] for f in found])).hexdigest()))
            n, a, b = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def _ids(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t.as_py(), path) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def encoded(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of each whole text. A null or empty text has none; repeated rows repeat."""
    return keyed_text(docs, id_col, text_col).mapInArrow(_ids(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")), "doc_id long, ids array<int>")


def decoded(tokens: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, bytes) of `encoded` rows."""
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [decode(i.as_py() or [], path) for i in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.binary())], ["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip_digests(docs: DataFrame, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, then its ids decoded.

    A null or empty text has no ids and the digests of nothing; repeated rows repeat; an empty table is empty.
    """
    path = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return keyed_text(docs, id_col, text_col).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(documents(spark, sf_dir))
