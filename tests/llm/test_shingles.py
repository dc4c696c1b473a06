import random
import tracemalloc

import numpy as np
import pyarrow as pa

from dayfold.llm import shingles as S
from dayfold.llm import simhash
from tests.llm.conftest import prose


def slow_jaccard(a, b):
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def edited(rng, text, edits):
    words = text.split(" ")
    for i in rng.sample(range(len(words)), edits):
        words[i] = f"new{rng.randrange(10 ** 6)}"
    return " ".join(words)


def test_jaccard_of_texts():
    rng = random.Random(3)
    for n in range(8):
        a = prose(rng, 200)
        b = edited(rng, a, n)
        assert S.jaccard(*S.shingle_sets(pa.array([a, b]))) == slow_jaccard(a, b)
    assert len(list(S.shingle_sets(pa.array(["", "One two", "one  TWO"])))[1]) == 1
    assert S.jaccard(*S.shingle_sets(pa.array(["One two", "one  TWO"]))) == 1


def test_near_copies_at_and_under_the_bound(spark):
    """One copy of each text is edited; it goes if and only if the exact similarity is 0.8 or more."""
    rng = random.Random(4)
    rows, want = [], set()
    for i in range(240):
        a = prose(rng, rng.randint(200, 900), [f"w{k}" for k in range(400)])
        b = edited(rng, a, max(1, round(len(a.split(" ")) * rng.uniform(0.002, 0.04))))
        rows += [(2 * i, a), (2 * i + 1, b)]
        want |= {2 * i} if slow_jaccard(a, b) >= 0.8 else {2 * i, 2 * i + 1}
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert 250 < len(want) < 470
    assert want <= kept and len(kept - want) <= 1  # a pair at the very bound may miss all bands


def test_a_large_group_needs_no_pair_list(spark, monkeypatch):
    """Copies of one base, far from each other but near the base, and a second family that shares keys."""
    made, compared = [], S.alike
    monkeypatch.setattr(S, "alike", lambda near, texts: made.append(near.distinct().count()) or compared(near, texts))
    rng = random.Random(5)
    base = prose(rng, 400, [f"w{k}" for k in range(400)])
    other = edited(rng, base, 24)
    rows = [(i, edited(rng, base, 3)) for i in range(1, 120)] + [(0, base)] + [(200 + i, edited(rng, other, 3)) for i in range(1, 120)] + [(200, other)]
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0, 200}
    assert sum(made) < 240 * 239 / 8


def test_copies_alike_only_through_their_base(spark, monkeypatch):
    """Every copy is at 0.85 or so from the base and under 0.8 from the others: the base has to lead."""
    made, compared = [], S.alike
    monkeypatch.setattr(S, "alike", lambda near, texts: made.append(near.distinct().count()) or compared(near, texts))
    rng = random.Random(7)
    base = prose(rng, 500, [f"w{k}" for k in range(500)])
    rows = [(900, base)] + [(i, edited(rng, base, 8)) for i in range(300)]
    assert slow_jaccard(rows[1][1], rows[2][1]) < 0.8 <= slow_jaccard(base, rows[1][1])
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {0}
    assert sum(made) < 300 * 299 / 8


def test_recall_against_brute_force(spark):
    """All pairs of a corpus with edits of every size: components as in the plain comparison of all pairs."""
    rng = random.Random(8)
    rows = []
    for _ in range(60):
        texts = [prose(rng, rng.randint(60, 300), [f"w{k}" for k in range(300)])]
        for _ in range(4):
            source = rng.choice(texts)
            texts.append(edited(rng, source, max(1, round(len(source.split(" ")) * rng.choice([0.003, 0.01, 0.02, 0.03])))))
        rows += [(len(rows) + k, t) for k, t in enumerate(texts)]
    sets = [{tuple(w[i:i + 5]) for i in range(len(w) - 4)} for w in (t.split(" ") for _, t in rows)]
    root = list(range(len(rows)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    want = {find(i) for i in range(len(rows))}
    kept = {r.doc_id for r in simhash.one_per_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert want <= kept and len(kept - want) <= 2


def test_edge_rows_through_large_keys(spark):
    """Nulls, repeated rows and a hot group of copies; the row kept of a repeated id is always the same."""
    rng = random.Random(9)
    base = prose(rng, 300, [f"w{k}" for k in range(300)])
    rows = [(i, edited(rng, base, 2), "x") for i in range(40)] + [(i, base, "y") for i in range(100, 160)] + [(0, base, "z"), (0, base, "w"), (None, base, "n"), (None, None, "n"), (500, None, "e"), (501, "", "e"), (502, " \n", "e")]
    found = []
    for parts in (1, 7):
        docs = spark.createDataFrame(rows, "doc_id long, text string, _place string").repartition(parts)
        found.append(sorted(map(tuple, simhash.one_per_group(docs).collect()), key=str))
    assert found[0] == found[1]
    assert [r[0] for r in found[0] if r[0] is not None] == [0, 500] and sum(r[0] is None for r in found[0]) == 2


def test_keys_of_similar_sets():
    """SimHash fingerprints at the bound: the share of pairs with a key and a head in common, the estimate's error."""
    rng = np.random.default_rng(6)
    a = rng.integers(0, 2 ** 64, 900, np.uint64)
    hits, near = [], []
    for _ in range(200):
        b = np.concatenate((a[100:], rng.integers(0, 2 ** 64, 100, np.uint64)))
        one, two = (np.frombuffer(S.fingerprint(np.unique(x)), np.uint8)[None] for x in (a, b))
        hits.append((S.band_keys(one) == S.band_keys(two)).any())
        near.append(int(S.heads(one)[0] ^ S.heads(two)[0] & -1) & (2 ** 64 - 1))
        assert abs(S.estimate(S.agreeing(one, two))[0] - 8 / 10) < 5 * S.ERROR
        a = b
    assert np.mean(hits) > 0.9
    assert np.mean([x.bit_count() <= S.HEAD_BITS for x in near]) > 0.99


def test_fingerprints_are_majority_bits():
    shingles = np.random.default_rng(7).integers(0, 2 ** 64, 700, np.uint64)
    bits = np.unpackbits(S.mixed(shingles[:, None] * S.FACTORS).view(np.uint8), axis=1).astype(int)
    assert S.fingerprint(shingles) == np.packbits(2 * bits.sum(axis=0) > 700).tobytes()


def test_leaders_take_little_memory():
    """A batch of 400 members with 64 leaders each: keys are made for the near leaders only, some rows at a time."""
    rng = np.random.default_rng(8)
    members = rng.integers(0, 256, (400, S.BITS // 8), np.uint8)
    lists = [[{"fp": 1000 + 64 * i + k, "root": 1000 + 64 * i + k, "signature": (members[i] if k == i % 64 else rng.integers(0, 256, S.BITS // 8, np.uint8)).tobytes()}
              for k in range(64)] for i in range(400)]
    kinds = pa.list_(pa.struct([("fp", pa.int64()), ("root", pa.int64()), ("signature", pa.binary())]))
    columns = [pa.array([0] * 400, pa.int32()), pa.array(range(400)), pa.array(range(400)), pa.array([m.tobytes() for m in members]), pa.array(lists, kinds)]
    batch = pa.RecordBatch.from_arrays(columns, ["band", "fp", "root", "signature", "leaders"])
    tracemalloc.start()
    found = pa.Table.from_batches(S._with_leaders([batch])).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(found["u"], found["v"])) == [(1000 + 64 * i + i % 64, i) for i in range(400)]
    assert peak < 60e6


def test_keys_grow_with_the_table():
    """Four times the sets take keys of two bits more, so that unrelated ones share as few; pairs at the bound are found as before."""
    rng = np.random.default_rng(12)
    assert S.key_bits(40_000) == S.KEY_BITS and S.key_bits(160_000) == S.KEY_BITS + 2 and S.key_bits(10 ** 7) >= 26
    for bits in (S.KEY_BITS, S.KEY_BITS + 2):
        places = S.band_places(bits)
        assert places.shape[1] == bits and all(len(set(p)) == bits for p in places.tolist())
        one = rng.integers(0, 2, (1000, S.BITS), np.uint8)
        two = one ^ (rng.random(one.shape) > S.AGREEING).astype(np.uint8)
        hits = S.band_keys(np.packbits(one, axis=1), bits) == S.band_keys(np.packbits(two, axis=1), bits)
        assert hits.any(axis=1).mean() > 0.98
    unrelated = [len(np.unique(k)) for k in S.band_keys(rng.integers(0, 256, (20_000, S.BITS // 8), np.uint8), 20)[:, :3].T]
    assert min(unrelated) > 0.98 * 20_000


def test_members_of_sorted_keys(monkeypatch):
    """Rows sorted by key, in batches of every size, give the members that a comparison of all pairs of a key gives."""
    monkeypatch.setattr(S, "RUN_ROWS", 50)
    monkeypatch.setattr(S, "CHANCE", 20)
    rng = np.random.default_rng(13)
    keys = np.sort(np.concatenate((rng.integers(0, 200, 500), np.full(30, 77), np.full(300, 120), np.full(90, 199))))
    bases = rng.integers(0, 2 ** 63, 4, np.int64)
    head = bases[rng.integers(0, 4, len(keys))] ^ (1 << rng.integers(0, 60, len(keys)))
    head = np.where(rng.random(len(keys)) < 0.5, rng.integers(0, 2 ** 63, len(keys), np.int64), head)
    fps = np.arange(len(keys))
    want = []
    for k in np.unique(keys):
        mine = np.flatnonzero(keys == k)
        for i in mine:
            if len(mine) > S.CHANCE or any(j != i and int(head[i] ^ head[j]).bit_count() <= S.HEAD_BITS for j in mine):
                want.append((int(k), int(i)))
    cuts = [0, *np.sort(rng.choice(len(keys), 12, replace=False)).tolist(), len(keys)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a:b]) for c in (keys, fps, head)], ["key", "fp", "head"]) for a, b in zip(cuts, cuts[1:])]
    got = [x for b in S._met(iter(batches)) for x in zip(b.column("key").to_pylist(), b.column("fp").to_pylist())]
    assert sorted(got) == sorted(want) and 0 < len(want) < len(keys)
    assert list(S._met(iter([]))) == []


def test_members_out_of_reach_are_not_compared(spark):
    """Sizes and common shingles as counted pair by pair; they keep every pair that is alike and drop sets mostly their own."""
    rng = random.Random(14)
    base = prose(rng, 200, [f"w{k}" for k in range(400)])
    texts = [base, edited(rng, base, 2), edited(rng, base, 4), edited(rng, base, 14), prose(rng, 200, [f"v{k}" for k in range(400)])]
    roots = [0, 0, 2, 3, 4]
    frame = spark.createDataFrame(list(enumerate(texts)), "fp long, text string")
    members = spark.createDataFrame(list(enumerate(roots)), "fp long, root long")
    got = {r.fp: (r["size"], r.common) for r in S.reach(members, frame).collect()}
    sets = [set(x.tolist()) for x in S.shingle_sets(pa.array(texts))]
    others = [set().union(*(s for s, r in zip(sets, roots) if r != mine)) for mine in roots]
    want = {i: (len(s), len(s & o)) for i, (s, o) in enumerate(zip(sets, others))}
    assert got == {i: x for i, x in want.items() if x[1] >= 0.8 * x[0]} and set(got) == {0, 1, 2}
    for i in got:
        for j in got:
            if roots[i] != roots[j]:
                alike = len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
                assert S.reachable(got[i][0], got[j][0], min(got[i][1], got[j][1])) >= alike


def batches_of(columns, names, cuts):
    arrays = lambda a, b: [pa.array([x.tobytes() for x in c[a:b]], pa.binary()) if c.ndim == 2 else pa.array(c[a:b]) for c in columns]
    return iter([pa.RecordBatch.from_arrays(arrays(a, b), names) for a, b in zip(cuts, cuts[1:])])


def test_members_left_of_open_keys(monkeypatch):
    """Keys of every size, long ones in parts: what is left without the first members, if it is of several components."""
    monkeypatch.setattr(S, "RUN_ROWS", 40)
    rng = np.random.default_rng(15)
    keys = np.sort(np.concatenate((rng.integers(0, 60, 150), np.full(200, 70), np.full(170, 71), np.full(90, 72), np.full(45, 73))))
    fps, roots = np.arange(len(keys)), rng.integers(0, 3, len(keys))
    roots[keys == 71] = 5
    roots[np.flatnonzero(keys == 72)] = 6
    roots[np.flatnonzero(keys == 72)[-1]] = 7
    for skip in (0, 1, 3, 64, 180):
        want = []
        for k in np.unique(keys):
            left = np.flatnonzero(keys == k)[skip:]
            if len(set(roots[left])) > 1:
                want += [(int(k), int(i)) for i in left]
        cuts = [0, *np.sort(rng.choice(len(keys), 25, replace=False)).tolist(), len(keys)]
        found = S._open(batches_of([keys, fps * 0, fps, roots], ["key", "weight", "fp", "root"], cuts), skip)
        assert sorted(x for b in found for x in zip(b.column("key").to_pylist(), b.column("fp").to_pylist())) == sorted(want)


def test_leaders_of_sorted_keys(monkeypatch):
    """Members meet those before them of the first of their key, once for all keys, whatever parts a key comes in."""
    monkeypatch.setattr(S, "SIGNED_ROWS", 16)
    rng = np.random.default_rng(16)
    base = rng.integers(0, 2, S.BITS).astype(np.uint8)
    signs = np.packbits(base ^ (rng.random((60, S.BITS)) < rng.choice([0.005, 0.1, 0.3], 60)[:, None]).astype(np.uint8), axis=1)
    bands = S.band_keys(signs)
    roots, size = np.arange(60) // 2, np.full(60, 100)
    common = np.where(rng.random(60) < 0.3, 70, 100)
    rows = sorted((int(k), i) for i in range(60) for k in bands[i])
    keys, at = (np.array(x) for x in zip(*rows))
    columns = [keys, at * 0, at, roots[at], size[at], common[at], signs[at]]
    names = ["key", "weight", "fp", "root", "size", "common", "signature"]
    for leading in (1, 5, 64):
        want = set()
        for i in range(60):
            for j in range(i):
                shared = np.flatnonzero(bands[i] == bands[j])
                near = S.estimate(S.agreeing(signs[i:i + 1], signs[j:j + 1]))[0]
                if len(shared) and near >= S.LOW and roots[i] != roots[j] and min(common[i], common[j]) > 90:
                    if (bands[:j, shared[0]] == bands[i, shared[0]]).sum() < leading:
                        want.add((i, j, near >= S.HIGH))
        cuts = [*range(0, len(keys), 7), len(keys)]
        found = [x for b in S._led(batches_of(columns, names, cuts), S.KEY_BITS, leading) for x in zip(*(c.to_pylist() for c in b.columns))]
        got = {(u, v, x >= S.HIGH) for u, v, x in found}
        assert len(got) == len(found) and got <= want
        assert {x[:2] for x in want if not x[2]} == {x[:2] for x in got if not x[2]}
        assert {(i, roots[j]) for i, j, sure in want if sure} == {(i, roots[j]) for i, j, sure in got if sure}
