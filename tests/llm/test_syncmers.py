import hashlib
import random

import numpy as np

from dayfold.llm import syncmers as S
from tests.llm.conftest import prose


def test_anchors_are_closed_syncmers():
    text = prose(random.Random(1), 200).encode()
    places, hashes = S.anchors(text)
    codes = S.mixed(np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1))
    small = {}
    for i in range(len(text) - S.S + 1):
        small[i] = int(S.mixed(S.gram_hashes(codes[i:i + S.S], S.S))[0])
    chosen = [i for i in range(len(text) - S.K + 1) if min(small[j] for j in range(i, i + S.K - S.S + 1)) in (small[i], small[i + S.K - S.S])]
    assert places.tolist() == chosen
    grams = {}
    for i, h in zip(places, hashes):
        assert grams.setdefault(text[i:i + S.K], h) == h


def test_anchors_do_not_depend_on_context(monkeypatch):
    middle = prose(random.Random(2), 100)
    inside = lambda t: {(p - t.encode().index(middle.encode()), h) for p, h in zip(*S.anchors(t.encode())) if t.encode().index(middle.encode()) <= p <= t.encode().index(middle.encode()) + len(middle.encode()) - S.K}
    assert inside("left " + middle + " right") == inside("something else " * 9 + middle)
    whole = S.anchors(("z" + middle * 3).encode())
    monkeypatch.setattr(S, "STEP", 64)
    pieces = S.anchors(("z" + middle * 3).encode())
    assert whole[0].tolist() == pieces[0].tolist() and whole[1].tolist() == pieces[1].tolist()


def test_likeness():
    rng = random.Random(3)
    a, b = prose(rng, 400).encode(), prose(random.Random(99), 400, ["lorem", "ipsum", "dolor", "amet"]).encode()
    assert S.likeness(S.sketch(a), S.sketch(a)) == 1 and S.likeness(S.sketch(a), S.sketch(b)) < 0.1
    assert S.likeness(S.sketch(b""), S.sketch(b"")) == 1 and S.likeness(S.sketch(b""), S.sketch(a)) == 0
    assert 0.3 < S.likeness(S.sketch(a), S.sketch(a[:len(a) * 2 // 3] + b[:len(a) // 3])) < 0.7


def test_edits_against_brute_force(frame, awkward, empty, spark):
    got = S.fingerprints_of_edits(frame).collect()
    least = -(2 ** 63)
    order = sorted(awkward, key=lambda x: -(least if x[0] is None else x[0]))
    ids = [i for i, _ in order]
    want = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        want[i] = n, hashlib.sha256((t[:n - n // 3] + after[:n // 3]).encode()).hexdigest(), S.as_text(S.sketch(t.encode()))
    assert len(got) == len(awkward)
    for r in got:
        nxt = order[(ids.index(r.doc_id) + 1) % len(order)][0] if r.doc_id is not None else None
        if ids.count(r.doc_id) == 1 and ids.count(nxt) == 1:
            assert (r.n_chars, r.edited_sha256, r.fingerprint) == want[r.doc_id]
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    assert S.fingerprints_of_edits(empty).count() == 0
    alone = S.fingerprints_of_edits(spark.createDataFrame([(4, "one two three")], "doc_id long, text string")).collect()
    assert len(alone) == 1 and alone[0].near_next == 1 and alone[0].edited_sha256 == hashlib.sha256(b"one two tone ").hexdigest()


def test_runs_have_every_successor(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN_ROWS", 4)
    rng = random.Random(8)
    ids = rng.sample(range(10 ** 6), 333)
    df = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(5)
    down = sorted(ids, reverse=True)
    want = {i: f"text {j}" for i, j in zip(down, down[1:] + down[:1])}
    assert {r.doc_id: r.after for r in S.with_next(df).collect()} == want


def test_no_text_but_the_empty_one_is_without_anchor():
    rng = random.Random(4)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in range(1, 40) for _ in range(20)]
    assert all(len(S.sketch(t)) for t in texts) and not len(S.sketch(b""))
    assert S.likeness(S.sketch(texts[300]), S.sketch(b"")) == 0
    short = [t for t in texts if 16 <= len(t) <= 25]
    assert all(S.likeness(S.sketch(a), S.sketch(b)) == 0 for a, b in zip(short, short[20:]))
