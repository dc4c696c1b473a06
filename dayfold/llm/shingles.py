"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from SimHash. A fingerprint has 2,048 majority bits of the shingle hashes; two sets whose
similarity is 0.8 agree in a bit with probability 0.85, unrelated ones with 0.5. There are 100 keys of 18 bits
each: a pair at 0.8 shares one with probability 0.995, one at 0.85 with 0.9998. Twice as many sets take keys of one
bit more, and as many keys as find such a pair as surely, so a set meets few unrelated ones in a key of a table of any
size. A 64-bit fingerprint with whole blocks as keys cannot serve here: at 0.8 two of them differ in some 10 bits, 16
at the tail, so no selective block of bits agrees.

Unrelated sets meet by chance, too, so the members of a key, which one sort brings together, compare 64 further bits
first, and only those stay that have another one near. The similarity of a pair is then estimated from all bits (standard error 0.02 at
0.8). Five standard errors over the bound it is a link, five below it is none, and what lies between is decided
by the exact similarity of the
texts, so texts travel for few pairs only.

Every candidate pair is either compared or already in one component. Each member first meets the leader of its
largest key, the member that shares most keys with most others: a base whose copies are alike only through it is found at
once. The members of keys that still hold several components meet the leader of each key, then 64 and 16 times as many
in every round; a leader has then met all others and leaves the key. One sort brings leaders and members of a key
together, and only pairs that may be alike become rows, in the first key that they share.

A large family is mostly one component after the first round, and the copies that are left are under the bound to each
other, though not by much. After that round the shingles of the members left are counted: two sets have no more in common
than the lesser has of shingles that another component has too. That bounds their similarity from above, and pairs
under 0.8 by it, like members that can reach 0.8 with none, are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.llm.common import keyed_text, released, slices, text_buffers, written
from dayfold.llm.components import components
from dayfold.llm.phrases import word_units
from dayfold.llm.syncmers import gram_hashes, mixed

SHINGLE = 5
SIMILAR = 0.8
#: Bits of a fingerprint; keys and bits of each key in a table of up to 2 ** (KEY_BITS - ROOM) sets.
BITS, BANDS, KEY_BITS, ROOM = 2048, 100, 18, 2
#: Share of pairs at SIMILAR that keys of more bits may miss; those of KEY_BITS miss as many.
MISSED = 0.005
#: Rows of keys that one task sorts, about, and rows whose runs are looked through at a time.
KEY_TASK, RUN_ROWS = 2_000_000, 1 << 16
#: Rows with signatures that are looked through at a time.
SIGNED_ROWS = 1 << 13
#: Members of a key that compare their heads with each other, and the bits in which heads of near copies differ at most.
CHANCE, HEAD_BITS = 512, 21
#: Bits in which sets of similarity SIMILAR agree: the angle between sets of one size.
AGREEING = 1 - np.arccos(2 * SIMILAR / (1 + SIMILAR)) / np.pi


def estimate(agreeing: np.ndarray) -> np.ndarray:
    """Similarity from the share of equal bits of two fingerprints."""
    cosine = np.maximum(np.cos(np.pi * (1 - np.asarray(agreeing))), 0)
    return cosine / (2 - cosine)


#: Standard error of an estimate at SIMILAR, and the estimates between which texts decide.
ERROR = (estimate(AGREEING + 1e-4) - estimate(AGREEING - 1e-4)) / 2e-4 * (AGREEING * (1 - AGREEING) / BITS) ** 0.5
LOW, HIGH = SIMILAR - 5 * ERROR, SIMILAR + 5 * ERROR
#: Leaders that the members of a key meet after the first; later they are LEADERS_GROW times as many in each round.
LEADERS, LEADERS_GROW = 64, 16
#: Fingerprints whose keys are made at a time: each bit takes eight bytes meanwhile.
KEY_ROWS = 256
#: Shingles whose bits are added up at a time; their sums fit into bytes.
STEP = 255
#: Bytes of text that a worker holds as shingles at a time.
STEP_BYTES = 200_000
_rng = np.random.default_rng(11)
FACTORS = _rng.integers(0, 2 ** 64, BITS // 64, np.uint64) | np.uint64(1)
SALT = _rng.integers(0, 2 ** 64, dtype=np.uint64)
#: The bits of each key, none in two, and those of the head.
_places = _rng.permutation(BITS)
PLACES, HEAD = _places[:BANDS * KEY_BITS], _places[-64:]
NONE = np.zeros(0, np.uint64)
ESTIMATE = "u long, v long, estimate double"


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles; fewer than five words are one shingle."""
    flat, offsets = text_buffers(column)
    for i, j in slices(np.diff(offsets), STEP_BYTES):
        part = flat[offsets[i]:offsets[j]]
        part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.uint8)
        units = word_units(part, offsets[i:j + 1] - offsets[i])
        ends = np.cumsum(units.sizes)
        for a, b in zip((ends - units.sizes).tolist(), ends.tolist()):
            width = min(SHINGLE, b - a)
            yield np.unique(mixed(gram_hashes(units.codes[a:b], width) + np.uint64(width))) if width else NONE


def set_digest(shingles: np.ndarray) -> np.ndarray:
    return mixed(shingles ^ SALT).sum(dtype=np.uint64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """Majority bits of BITS bits made of each shingle's hash."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(shingles), STEP):
        bits = mixed(shingles[at:at + STEP, None] * FACTORS).view(np.uint8)
        counts += np.add.reduce(np.unpackbits(bits, axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(shingles)).tobytes()


def fingerprints(column: pa.Array) -> np.ndarray:
    """A row of bytes for each fingerprint of a column."""
    return text_buffers(column)[0].reshape(-1, BITS // 8)


def key_bits(sets: int) -> int:
    """Bits of the keys of a table: there are at least 2 ** ROOM / 2 times as many keys of a band as sets."""
    return max(KEY_BITS, sets.bit_length() + ROOM)


@cache
def band_places(bits: int) -> np.ndarray:
    """The bits of each key, a row for each; no bit is in two keys while the fingerprint lasts, then they are dealt anew.

    Keys of more than KEY_BITS bits are as many as a pair at SIMILAR needs to miss all with probability MISSED, over all
    numbers of bits in which its fingerprints may agree.
    """
    if bits == KEY_BITS:
        return PLACES.reshape(BANDS, KEY_BITS)
    agree = np.arange(BITS + 1)
    logs = np.concatenate(([0.0], np.cumsum(np.log(agree[1:]))))
    share = np.exp(logs[-1] - logs - logs[::-1] + agree * np.log(AGREEING) + (BITS - agree) * np.log(1 - AGREEING))
    bands, miss = BANDS, 1 - (agree / BITS) ** bits
    while (share * miss ** bands).sum() > MISSED:
        bands += 1
    rng = np.random.default_rng(bits)
    free, dealt = _places[:-64], []
    while len(dealt) < bands:
        dealt += [*free[:len(free) // bits * bits].reshape(-1, bits)]
        free = rng.permutation(free)
    return np.array(dealt[:bands])


def band_keys(rows: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """The keys of each fingerprint: the bits of a band, and above them its number."""
    places = band_places(bits)
    found = np.empty((len(rows), len(places)), np.int64)
    for at in range(0, len(rows), KEY_ROWS):
        some = np.unpackbits(rows[at:at + KEY_ROWS], axis=1)[:, places]
        found[at:at + KEY_ROWS] = some @ (1 << np.arange(bits)) + (np.arange(len(places)) << bits)
    return found


def heads(rows: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(np.unpackbits(rows, axis=1)[:, HEAD], axis=1)).view(np.int64)[:, 0]


def agreeing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal bits of the fingerprints in the rows."""
    return 1 - np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64) / BITS


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two shingle sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps, made = [], []
        for shingles in shingle_sets(batch.column("text")):
            fps.append(set_digest(shingles))
            made.append(fingerprint(shingles))
        values = [batch.column("doc_id"), batch.column("text_key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(made, pa.binary())]
        yield pa.RecordBatch.from_arrays(values, ["doc_id", "text_key", "fp", "signature"])


def _keys(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, fps = fingerprints(batch.column("signature")), batch.column("fp").to_numpy()
        for at in range(0, len(rows), KEY_ROWS):
            some = slice(at, at + KEY_ROWS)
            found = band_keys(rows[some], bits)
            each = found.shape[1]
            columns = [pa.array(found.ravel()), pa.array(np.repeat(fps[some], each)), pa.array(np.repeat(heads(rows[some]), each))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "fp", "head"])


def run_starts(values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def whole_runs(batches: Iterator[pa.RecordBatch], limit: int | None = None) -> Iterator[tuple[list[np.ndarray], bool]]:
    """The columns of rows sorted by the first one, some at a time and never a part of a run of equal values.

    A run of more than `limit` rows, or else RUN_ROWS, comes in parts, each by itself and with True.
    """
    limit = limit or RUN_ROWS
    held, rows, long = [], 0, None

    def cut(end: bool) -> Iterator[tuple[list[np.ndarray], bool]]:
        nonlocal held, rows, long
        columns = [np.concatenate(c) for c in zip(*held)]
        if long is not None:
            of_long = int(np.searchsorted(columns[0], long, "right"))
            if of_long:
                yield [c[:of_long] for c in columns], True
            columns = [c[of_long:] for c in columns]
        if len(columns[0]):
            long = None
            last = len(columns[0]) if end else int(np.searchsorted(columns[0], columns[0][-1], "left"))
            if last:
                yield [c[:last] for c in columns], False
            elif len(columns[0]) >= limit:
                long, last = columns[0][-1], len(columns[0])
                yield columns, True
            columns = [c[last:] for c in columns]
        held, rows = [columns], len(columns[0])

    for batch in batches:
        held.append([fingerprints(c) if c.type == pa.binary() else c.to_numpy() for c in batch.columns])
        rows += len(batch)
        if rows >= limit:
            yield from cut(False)
    if rows:
        yield from cut(True)


def near_members(keys: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Whether the head of a row is near that of another row of its key; rows of a key of more than CHANCE rows count as near."""
    starts = run_starts(keys)
    sizes = np.diff(np.append(starts, len(keys)))
    size = np.repeat(sizes, sizes)
    near = size > CHANCE
    some = np.flatnonzero((size > 1) & ~near)
    keys, head, found, at = keys[some], head[some], np.zeros(len(some), bool), np.arange(len(some))
    for apart in range(1, CHANCE):
        at = at[at + apart < len(some)]
        at = at[keys[at] == keys[at + apart]]
        if not len(at):
            break
        close = at[np.bitwise_count((head[at] ^ head[at + apart]).view(np.uint64)) <= HEAD_BITS]
        found[close] = found[close + apart] = True
    near[some[found]] = True
    return near


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members (key, fp, n) of each key whose head is near that of another member, of rows (key, fp, head) sorted by key.

    `n` counts such members of the key, in a key of more than RUN_ROWS those of a part.
    """
    for (keys, fps, head), long in whole_runs(batches):
        near = np.ones(len(keys), bool) if long else near_members(keys, head)
        if near.any():
            sizes = np.diff(np.append(run_starts(keys[near]), near.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(keys[near]), pa.array(fps[near]), pa.array(np.repeat(sizes, sizes))], ["key", "fp", "n"])


def _open(batches: Iterator[pa.RecordBatch], skip: int) -> Iterator[pa.RecordBatch]:
    """The members (key, fp) that are left of each key without its first `skip`, if they are of several components.

    Rows (key, weight, fp, root) come sorted by key, the first members first. Of a long key only fps are held until a
    second component shows.
    """
    key = seen = root = None
    held: list[np.ndarray] = []

    def rows(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps)], ["key", "fp"])

    for (keys, _, fps, roots), long in whole_runs(batches):
        if long:
            if keys[0] != key:
                key, seen, root, held = keys[0], 0, None, []
            left = slice(max(skip - seen, 0), None)
            seen += len(keys)
            keys, fps, roots = keys[left], fps[left], roots[left]
            if not len(keys):
                continue
            root = roots[0] if root is None else root
            held.append(fps)
            if root == "several" or (roots != root).any():
                root = "several"
                yield from (rows(np.full(len(x), key), x) for x in held)
                held = []
            continue
        starts = run_starts(keys)
        left = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys)))) >= skip
        keys, fps, roots = keys[left], fps[left], roots[left]
        if len(keys):
            starts = run_starts(keys)
            several = np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts)
            several = np.repeat(several, np.diff(np.append(starts, len(keys))))
            yield rows(keys[several], fps[several])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fp, root, shingles in zip(batch.column("fp").to_pylist(), batch.column("root").to_pylist(), shingle_sets(batch.column("text"))):
            columns = [pa.array(shingles.view(np.int64)), pa.array(np.full(len(shingles), fp)), pa.array(np.full(len(shingles), root))]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "fp", "root"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, common) of each row (shingle, fp, root), sorted by shingle: 1 if another component has the shingle too, else 0."""
    for (shingles, fps, roots), long in whole_runs(batches):
        starts = run_starts(shingles)
        several = (np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts)) | long  # a part may hold one component only
        common = np.repeat(several, np.diff(np.append(starts, len(fps)))).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(fps), pa.array(common)], ["fp", "common"])


def reachable(size, other, common):
    """Whether sets of these sizes that have `common` shingles in common at most may reach SIMILAR; arrays or columns."""
    return (1 + SIMILAR) * common + 1e-6 >= SIMILAR * (size + other)


def _estimates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = estimate(agreeing(*(fingerprints(batch.column(c)) for c in ("u_signature", "v_signature"))))
        near = found >= LOW
        yield pa.RecordBatch.from_arrays([batch.column("u").filter(pa.array(near)), batch.column("v").filter(pa.array(near)), pa.array(found[near])], ["u", "v", "estimate"])


def first_of_sure(near: np.ndarray, found: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Places in `near` of leaders: of those of one component that are surely alike, the first stands for all."""
    sure = np.flatnonzero(found >= HIGH)
    first = sure[np.unique(roots[near[sure]], return_index=True)[1]]
    return np.concatenate((first, np.flatnonzero(found < HIGH)))


def _led(batches: Iterator[pa.RecordBatch], bits: int, leading: int) -> Iterator[pa.RecordBatch]:
    """Pairs of members of a key and those before them of its first `leading` that may be alike and are of other components.

    Rows (key, weight, fp, root, size, common, signature) come sorted by key, the first members first. A pair is left
    to the first band that both have in common.
    """
    key, seen = None, 0
    for columns, long in whole_runs(batches, SIGNED_ROWS):
        u, v, values = [], [], []
        starts = run_starts(columns[0])
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(columns[0])).tolist()):
            mine = [c[a:b] for c in columns[2:]]
            fps, roots, size, common, own = mine
            if not long or columns[0][a] != key:
                key, seen, first = columns[0][a] if long else None, 0, [c[:leading] for c in mine]
            elif seen < leading:
                first = [np.concatenate((x, c[:leading - seen])) for x, c in zip(first, mine)]
            lead_fps, lead_roots, lead_size, lead_common, theirs = first
            keys = None
            for i in range(len(fps)):
                before = slice(min(seen + i, leading))
                may = (lead_roots[before] != roots[i]) & reachable(size[i], lead_size[before], np.minimum(common[i], lead_common[before]))
                near = np.flatnonzero(may)
                if not len(near):
                    continue
                found = estimate(agreeing(theirs[near], own[i]))
                near, found = near[found >= LOW], found[found >= LOW]
                if not len(near):
                    continue
                if keys is None:
                    keys, lead_keys = band_keys(own, bits), band_keys(theirs, bits)
                here = (lead_keys[near] == keys[i]).argmax(axis=1) == columns[0][a] >> bits
                near, found = near[here], found[here]
                some = first_of_sure(near, found, lead_roots)
                others = lead_fps[near[some]]
                u.append(np.maximum(others, fps[i]))
                v.append(np.minimum(others, fps[i]))
                values.append(found[some])
            seen += len(fps)
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (u, v, values)], ["u", "v", "estimate"])


def _with_leaders(batches: Iterator[pa.RecordBatch], bits: int = KEY_BITS) -> Iterator[pa.RecordBatch]:
    """Pairs of a member (band, fp, root, signature) and those of its key's leaders that may be alike and are not in its component.

    A pair is left to the first band that both have in common; of leaders of one component that are surely alike, the first stands for all.
    """
    for batch in batches:
        u, v, values = [], [], []
        own = fingerprints(batch.column("signature"))
        own_bands = band_keys(own, bits)
        leaders = batch.column("leaders")
        offsets = leaders.offsets.to_numpy() - leaders.offsets[0].as_py()
        flat = leaders.flatten()
        fps, roots = flat.field("fp").to_numpy(), flat.field("root").to_numpy()
        theirs = fingerprints(flat.field("signature"))
        for i, (band, fp, root) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("band", "fp", "root")))):
            some = slice(offsets[i], offsets[i + 1])
            found = estimate(agreeing(theirs[some], own[i]))
            near = np.flatnonzero((found >= LOW) & (roots[some] != root))
            near = near[(band_keys(theirs[some][near], bits) == own_bands[i]).argmax(axis=1) == band]
            near = near[first_of_sure(near, found[near], roots[some])]
            others = fps[some][near]
            u.append(np.maximum(others, fp))
            v.append(np.minimum(others, fp))
            values.append(found[near])
        none = [np.zeros(0, np.int64)]
        columns = [np.concatenate(x or none) for x in (u, v)] + [np.concatenate(values or [np.zeros(0)])]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["u", "v", "estimate"])


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [jaccard(a, b) for a, b in zip(shingle_sets(batch.column("u_text")), shingle_sets(batch.column("v_text")))]
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(found, pa.float64())], ["u", "v", "likeness"])


def _with_both(pairs: DataFrame, nodes: DataFrame, value: str) -> DataFrame:
    for side in ("u", "v"):
        pairs = pairs.join(nodes.select(F.col("fp").alias(side), F.col(value).alias(f"{side}_{value}")), side)
    return pairs.select("u", "v", f"u_{value}", f"v_{value}")


def alike(near: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes whose similarity is SIMILAR or more, of pairs with an estimate of LOW or more."""
    near = written(near.distinct(), "estimates")
    exact = _with_both(near.where(F.col("estimate") < HIGH).select("u", "v"), texts, "text").mapInArrow(released(_likeness), "u long, v long, likeness double")
    sure = near.where(F.col("estimate") >= HIGH).select("u", "v")
    return written(sure.union(exact.where(F.col("likeness") >= SIMILAR).select("u", "v")), "alike")


def _rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def _keyed(members: DataFrame, *columns: str) -> DataFrame:
    """A row for each key of a member, sorted by key within the tasks, the members that share most keys first."""
    rows = members.withColumn("key", F.explode("keys")).select("key", "weight", "fp", *columns)
    return rows.repartition("key").sortWithinPartitions("key", F.desc("weight"), "fp")


def still_open(members: DataFrame, skip: int) -> DataFrame:
    """The members with those of their keys that hold several components even without their first `skip` members."""
    rows = _keyed(members, "root").mapInArrow(released(partial(_open, skip=skip)), "key long, fp long")
    keys = rows.groupBy("fp").agg(F.collect_list("key").alias("keys"))
    return written(members.drop("keys").join(keys, "fp"), "open")


def reach(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(fp, size, common) of the members (fp, root) that may be alike with one of another component.

    `size` counts a member's shingles, `common` those that a member of another component has too.
    """
    every = texts.join(members, "fp").mapInArrow(released(_shingles), "shingle long, fp long, root long")
    counted = every.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(released(_common), "fp long, common long")
    counted = counted.groupBy("fp").agg(F.count("*").alias("size"), F.sum("common").alias("common"))
    return counted.where(F.col("common") + 1e-6 >= SIMILAR * F.col("size"))


def similar_roots(members: DataFrame, texts: DataFrame, bits: int = KEY_BITS) -> DataFrame:
    """(node, root) of the components of all pairs that share a key and are alike.

    `members` has (fp, weight, keys, largest, signature), the keys being of `bits` bits and `largest` one of them, `texts` (fp, text).
    """
    most = F.max(F.struct("weight", (-F.col("fp")).alias("order"), "fp")).alias("x")
    leaders = members.select("fp", "weight", F.explode("keys").alias("key")).groupBy("key").agg(most).select("key", F.col("x.fp").alias("leader"))
    pairs = members.select("fp", F.col("largest").alias("key")).join(leaders, "key").where("fp <> leader")
    pairs = pairs.select(F.greatest("fp", "leader").alias("u"), F.least("fp", "leader").alias("v")).distinct()
    near = _with_both(pairs, members, "signature").mapInArrow(released(_estimates), ESTIMATE)
    roots = written(components(alike(near, texts)), "roots")
    skip, leading = 0, 1
    while True:
        members = still_open(written(_rooted(members, roots), "members"), skip)
        if not skip and not members.isEmpty():
            members = written(members.join(reach(members.select("fp", "root"), texts), "fp"), "reach")
        if members.isEmpty():
            return roots
        rows = _keyed(members, "root", "size", "common", "signature")
        links = alike(rows.mapInArrow(released(partial(_led, bits=bits, leading=leading)), ESTIMATE), texts)
        roots = written(components(links.union(roots.select(F.col("node").alias("u"), F.col("root").alias("v")))), "roots")
        members = members.drop("root")
        skip, leading = leading, LEADERS if leading == 1 else LEADERS_GROW * leading


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_kept): the smallest doc_id of each group of near copies; a group without any id gives no row.

    A null text is empty, and texts without words are alike. Texts of any length are taken whole; repeated rows
    and equal shingle sets are one node. Other columns are ignored.
    """
    rows = keyed_text(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    place: Column = F.coalesce("doc_id", "text_key").alias("place")
    made = rows.mapInArrow(released(_fingerprints), "doc_id long, text_key long, fp long, signature binary")
    made = written(made, "shingles")
    nodes = made.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(F.struct(place, "text_key", "signature")).alias("at"))
    nodes = written(nodes.select("fp", "least", "at.*"), "nodes")
    sets = nodes.count()
    bits = key_bits(sets)
    every = nodes.select("fp", "signature").mapInArrow(released(partial(_keys, bits=bits)), "key long, fp long, head long")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets * len(band_places(bits)) // KEY_TASK)
    met = every.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(released(_met), "key long, fp long, n long")
    most = F.max(F.struct("n", "key"))["key"].alias("largest")
    members = met.groupBy("fp").agg(F.sum("n").alias("weight"), F.collect_list("key").alias("keys"), most)
    members = written(members.join(nodes.select("fp", "signature"), "fp"), "met")
    wanted = nodes.join(members.select("fp"), "fp", "left_semi").select("fp", "place", "text_key")
    texts = rows.select("text", place, "text_key").join(wanted, ["place", "text_key"]).select("fp", "text").dropDuplicates(["fp"])
    roots = similar_roots(members, written(texts, "texts"), bits)
    placed = written(_rooted(nodes.select("fp", "least"), roots), "placed")
    return placed.groupBy("root").agg(F.min("least").alias("_kept")).where("_kept is not null").select("_kept").distinct()
