import zlib
from itertools import combinations

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dayfold.llm import best_fit as B
from dayfold.llm.word_bpe import encoder

FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def ids_of(library, text):
    return np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.lists(st.sampled_from(["<|endoftext|>", "<|startOFtext|>", "'S", "don't", "It's", "É", "é", "İ", "ΣΑΣ", "ǅ", "²3", "\x1c", "\x85", "\xa0", " ", " ", "\n", "aaaa", "...", "_a_", "日本", "🎉"]), max_size=9).map("".join))
def test_ids_are_those_of_the_library(library, text):
    assert encoder(FILE)(text) == ids_of(library, text)


def test_other_files_go_to_their_library():
    path = P.path("byte_bpe_50k.json")
    assert encoder(path)("Hello world") == ids_of(Tokenizer.from_file(path), "Hello world")


def check_bins(bins, sizes, length):
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(0 < sizes[b].sum() <= length for b in bins)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.just(41) | st.integers(40, 90))
def test_local_search_packs_all_items_and_is_never_worse(sizes, length):
    sizes = np.array(sizes, np.int64)
    first = B.best_fit(sizes, length)
    check_bins(first, sizes, length)
    found = B.local_search(first, sizes, length)
    check_bins(found, sizes, length)
    assert -(-int(sizes.sum()) // length) <= len(found) <= len(first)


def test_local_search_empties_sequences():
    sizes = np.random.default_rng(1).integers(1200, 1500, 600)
    first = B.best_fit(sizes, 4096)
    assert len(B.local_search(first, sizes, 4096)) < len(first)
    # one-for-one: [6, 3] and [5, 4, 1] and [1] hold 20 in two sequences of 10
    assert len(B.local_search([[0, 1], [2, 3], [4, 5]], np.array([6, 3, 5, 4, 1, 1]), 10)) == 2


def test_a_step_moves_most(monkeypatch):
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(1, 30, rng.integers(1, 5)).tolist(), rng.integers(1, 30, rng.integers(1, 6)).tolist()
        length = max(sum(a), sum(b)) + int(rng.integers(0, 8))
        if sum(a) > sum(b):
            a, b = b, a
        search = B._Search([list(range(len(a))), list(range(len(a), len(a) + len(b)))], np.array(a + b), length)
        room = length - sum(b)
        some = lambda x, n: [sum(c) for c in combinations(x, n)]
        moves = [g - t for i, j in ((1, 0), (2, 0), (1, 1), (2, 1), (1, 2)) for g in some(a, i) for t in some(b, j) if 0 < g - t <= room]
        step = search.step(0)
        assert (step is None) == (not moves)
        if step:
            assert sum((a + b)[i] for i in step[1]) - sum((a + b)[i] for i in step[2]) == max(moves)


def check_pieces(rows, texts, library, length):
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= length
    want = sorted((str(i), k, k * length, len(x[4 * length * k:4 * length * (k + 1)]) // 4, zlib.crc32(x[4 * length * k:4 * length * (k + 1)]))
                  for i, x in texts for k in range(-(-len(x) // (4 * length))))
    got = sorted((str(None if r.doc_id is None or r.doc_id != r.doc_id else int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in rows.itertuples())
    assert got == want


def test_pieces(spark, frame, awkward, empty, library, monkeypatch):
    texts = [(i, ids_of(library, t or "") + b"\1\0\0\0") for i, t in awkward]
    assert any(len(x) > 4 * 4096 for _, x in texts)
    rows = B.pack_best_fit(frame, checksum=True).toPandas()
    check_pieces(rows, texts, library, B.LENGTH)
    least = -(-sum(len(x) // 4 for _, x in texts) // B.LENGTH)
    assert rows.sequence_id.nunique() <= least + 1
    assert B.pack_best_fit(empty).count() == 0
    sums = sorted(zlib.crc32(bytes(r.ids)) for r in B.pack_best_fit(frame).select("ids").collect())
    assert sums == sorted(rows.ids_crc32)


def test_rounds_of_groups(spark, library):
    """Many groups: every item is packed once, and the rounds leave few sequences over the bound."""
    rng = np.random.default_rng(3)
    sizes = np.minimum(rng.exponential(30, 3000).astype(int) + 1, 99)
    items = spark.createDataFrame([(i % 7, i // 7, int(s)) for i, s in enumerate(sizes)], "task int, row long, size int")
    rows = B.assigned(items, 100, 64).toPandas()
    assert sorted(zip(rows.task, rows.row)) == sorted((i % 7, i // 7) for i in range(3000))
    for _, g in rows.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *np.cumsum(g["size"])[:-1]] and g["size"].sum() <= 100
    assert rows.sequence_id.nunique() <= 1.02 * -(-sizes.sum() // 100) + 1
