import re

import numpy as np
import xxhash

from dayfold.llm import simhash as S
from dayfold.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow(text):
    words = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    values = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def slow_components(pairs):
    """Smallest id reachable over fingerprints at most 4 bits apart, by comparing all."""
    fps = sorted({f for _, f in pairs})
    label = {f: f for f in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= 4 and label[b] < label[a]:
                    label[a], changed = label[b], True
    least = {}
    for i, f in pairs:
        if i is not None:
            least[label[f]] = min(least.get(label[f], i), i)
    return {f: least.get(label[f]) for f in fps}


def test_fingerprints_and_components(frame, awkward):
    rows = S.near_duplicates(frame).collect()
    pairs = [(i, slow(t)) for i, t in awkward]
    named = slow_components(pairs)
    want = sorted(((i, f"{f:016x}", named[f]) for i, f in pairs), key=str)
    assert sorted(((r[0], r[1], r[2]) for r in rows), key=str) == want


def test_empty_and_only_blank(empty, spark):
    assert S.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(3, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert {(r[0], r[1], r[2]) for r in S.near_duplicates(df).collect()} == {(3, "0" * 16, 2), (2, "0" * 16, 2), (None, "0" * 16, 2)}


def test_dense_blocks_split(spark, monkeypatch):
    """A family of fingerprints that shares most bits, with buckets far smaller than the family."""
    monkeypatch.setattr(S, "BUCKET", 8)
    rng = np.random.default_rng(1)
    family = {int(sum(1 << int(b) for b in rng.choice(14, rng.integers(0, 5), replace=False))) for _ in range(150)}
    far = {int(x) for x in rng.integers(-(2 ** 63), 2 ** 63, 50)}
    chain = {0x00FF00FF00000000, 0x00FF00FF0000000F << 20, 0x00FF00FF000000FF << 12}
    fps = sorted(family | far | {c - (1 << 64) if c >> 63 else c for c in (x & (2 ** 64 - 1) for x in chain)})
    links = S.close_links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    root = {r.node: r.root for r in components(links).collect()}
    unsigned = slow_components([(f, f & (2 ** 64 - 1)) for f in fps])
    assert {f: root.get(f, f) for f in fps} == {f: unsigned[f & (2 ** 64 - 1)] for f in fps}


def test_every_close_pair_shares_a_mask():
    rng = np.random.default_rng(2)
    masks = S.first_masks()
    for _ in range(300):
        flips = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not flips & m for m in masks)
        assert all(any(not flips & n for n in S.next_masks(m)) for m in masks if not flips & m)


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (5, 5), (None, 3), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {101: 100}


def test_one_per_group(frame):
    kept = S.one_per_group(frame)
    assert kept.columns == frame.columns
    ids = sorted(r.doc_id for r in kept.where("doc_id is not null").collect())
    assert len(ids) == len(set(ids)) and 43 not in ids and 1 in ids and 41 not in ids and 40 in ids
    assert kept.where("doc_id is null").count() == 2


def test_no_table_that_grows_with_the_documents_is_broadcast(spark, monkeypatch):
    """Blocks are 35 rows from each fingerprint, but their size is taken from before the explode, and files are compressed."""
    plans = {}

    def kept(df, name, write=S.written):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(S, "written", kept)
    words = ["alpha", "beta", "gamma", "delta", "eta", "iota"]
    texts = [(i, " ".join(words[(i * i + j * (i % 5)) % 6] for j in range(9))) for i in range(60)]
    found = S.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"))
    assert found.count() == 60
    plans["result"] = found._jdf.queryExecution().executedPlan().toString()
    for name in ("blocks", "placed", "components", "result"):
        assert "Broadcast" not in plans[name], name
    assert all("SortMergeJoin" in plans[name] for name in ("blocks", "placed", "result"))
