"""Document fingerprints from closed syncmers.

A k-byte string is chosen if the smallest hash among its s-byte strings stands at its first or last place.
The choice depends on the string alone, so two texts that share a passage share the anchors inside it,
whatever surrounds them. A fingerprint is the smallest anchor hashes of a text (a bottom sketch), and the
likeness of two fingerprints estimates the share of anchors that the texts have in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayfold.llm.common import documents, importable

K, S = 16, 6
SKETCH = 64
#: Rows of one run of neighbouring ids, and runs at most (then they get longer).
RUN_ROWS, RUNS = 32, 8192
#: Code units hashed at a time; neighbouring pieces overlap by K - 1.
STEP = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def gram_hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive 64-bit codes, by doubling: a gram's hash is made of those of its halves."""
    with np.errstate(over="ignore"):
        out, done, power = None, 0, codes  # power covers `width` codes
        width, base = 1, BASE
        while True:
            if n & width:
                if out is None:
                    out = power
                else:
                    m = len(codes) - done - width + 1
                    out = out[:max(m, 0)] * base + power[done:done + max(m, 0)]
                done += width
            if done == n:
                return out[:max(len(codes) - n + 1, 0)]
            power = power[:-width] * base + power[width:] if len(power) > width else power[:0]
            width, base = width * 2, base * base


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values, by doubling."""
    width, out = 1, values
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    rest = n - width
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def anchors(text: bytes, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of every closed syncmer of a text; a text without one is one anchor, an empty one none."""
    whole = np.zeros(min(len(text), 1), np.int64), np.frombuffer(hashlib.blake2b(text, digest_size=8).digest(), np.uint64)[:min(len(text), 1)]
    if len(text) < k:
        return whole
    places, hashes = [], []
    flat = np.frombuffer(text, np.uint8)
    for at in range(0, len(flat) - k + 1, STEP):
        codes = mixed(flat[at:at + STEP + k - 1].astype(np.uint64) + np.uint64(1))
        small = mixed(gram_hashes(codes, s))
        inner = k - s + 1
        least = sliding_min(small, inner)
        chosen = np.flatnonzero((small[:len(least)] == least) | (small[inner - 1:] == least))
        places.append(chosen + at)
        hashes.append(mixed(gram_hashes(codes, k)[chosen]))
    return (np.concatenate(places), np.concatenate(hashes)) if any(map(len, places)) else whole


def sketch(text: bytes) -> np.ndarray:
    """The smallest distinct anchor hashes, cut to 32 bits."""
    return np.unique(anchors(text)[1] >> np.uint64(32))[:SKETCH].astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the anchors of two texts that both have, from their sketches; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    least = np.union1d(a, b)[:SKETCH]
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(both, least, assume_unique=True).sum() / len(least))


def as_text(values: np.ndarray) -> str:
    """A fingerprint as hex digits, eight for each anchor."""
    return values.astype(">u4").tobytes().hex()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, np.ndarray] = {}
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    for batch in batches:
        rows = []
        for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after"))):
            own = known[text] if text in known else sketch(text.encode())
            following = sketch(after.encode())
            known = {after: following}  # the next row's text, as the rows come in order
            n = len(text)
            edited = (text[:n - n // 3] + after[:n // 3]).encode()
            changed = sketch(edited)
            rows.append((doc, n, hashlib.sha256(edited).hexdigest(), as_text(own), as_text(changed), likeness(own, changed), likeness(own, following)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _runs(bounds: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-(2 ** 63)).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.searchsorted(bounds, ids).astype(np.int32))], [*batch.schema.names, "run"])

    return run


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, after): each text with that of the next document in descending order of doc_id.

    The last one's next is the first. Equal ids follow by digest of the text, null ids come last.
    The ids are cut into runs of neighbours at their quantiles; the largest of each run is also the guest
    of the run above, so a window per run sees every successor.
    """
    importable(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    runs = max(1, min(RUNS, n // RUN_ROWS))
    cuts = [i / runs for i in range(1, runs)]
    found = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 10 * runs))).first()[0] if cuts else []
    bounds = np.unique(np.array(found or [], np.int64))  # RUNS numbers at most
    placed = rows.mapInArrow(_runs(bounds), "doc_id long, text string, run int")
    order = F.struct(F.coalesce("doc_id", F.lit(-(2 ** 63))), F.xxhash64("text"))
    heads = placed.groupBy("run").agg(F.max(order).alias("head")).orderBy(F.desc("run")).collect()  # one row for each run
    above = {r["run"]: heads[i - 1]["run"] for i, r in enumerate(heads)}
    lines = [(r["run"], above[r["run"]], r["head"][0], r["head"][1], i == 0) for i, r in enumerate(heads)]
    guests = F.broadcast(docs.sparkSession.createDataFrame(lines, "run int, host int, head_id long, head_hash long, wraps boolean"))
    rank = F.coalesce("doc_id", F.lit(-(2 ** 63)))
    marked = placed.select("*", rank.alias("rank"), F.xxhash64("text").alias("digest")).join(guests, "run")
    is_head = (F.col("rank") == F.col("head_id")) & (F.col("digest") == F.col("head_hash"))
    own = F.struct(F.col("run").alias("at"), F.lit(False).alias("guest"))
    guest = F.struct(F.col("host").alias("at"), F.lit(True).alias("guest"))
    both = marked.select("doc_id", "text", "rank", "digest", F.explode(F.when(is_head, F.array(own, guest)).otherwise(F.array(own))).alias("seat"))
    window = Window.partitionBy("seat.at").orderBy(F.col("seat.guest"), F.desc("rank"), F.desc("digest"))
    followed = both.select("doc_id", "text", "seat", F.lead("text").over(window).alias("after"))
    return followed.where("not seat.guest").select("doc_id", "text", F.coalesce("after", "text").alias("after"))


def fingerprints_of_edits(docs: DataFrame) -> DataFrame:
    """One row per document: n_chars, edited_sha256, both fingerprints, near_edited, near_next.

    The edit replaces the last third of the code points by as many first ones of the next document. A null or
    empty text is an empty fingerprint; repeated rows repeat; a single document is its own next one.
    """
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs).mapInArrow(_compare, kind)


def op2_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_of_edits(documents(spark, sf_dir))
