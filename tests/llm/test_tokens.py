import base64
import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dayfold.llm import byte_bpe as B
from dayfold.llm import packing

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_encoding_matches_the_library(encoding, tokenizer, text):
    ids = encoding.encode_ordinary(text)
    assert B.encode(text, RANKS) == ids
    assert B.decode(ids, RANKS) == text.encode()
    assert packing.encode([text], JSON)[0] == tokenizer.encode(text, add_special_tokens=False).ids


def test_very_long_pre_tokens(encoding):
    for text in ("a" * 20_000, "ab" * 9_000 + "é" * 50, "=" * 5_000, "thethethe" * 2_000):
        assert B.encode(text, RANKS) == encoding.encode_ordinary(text)


def test_other_tokenizer_files_use_their_library():
    path = P.path("word_bpe_49k.json")
    assert packing.encode(["Hello world"], path)[0] == Tokenizer.from_file(path).encode("Hello world", add_special_tokens=False).ids


def test_merge_order_with_own_ranks():
    ranks = {bytes([b]): 5000 + b for b in range(256)} | {b"ab": 3000, b"bc": 40, b"abc": 2, b"aa": 1, b"aaa": 0}
    assert B.merge(b"abcab", ranks) == [2, 3000]
    assert B.merge(b"aaaaa", ranks) == [0, 1]
    assert B.merge(b"xbcx", ranks) == [5000 + 120, 40, 5000 + 120]


def test_one_queue_for_many_pre_tokens():
    """Every pre-token as by itself, also where a merge makes a pair of lower rank, as the plain rule says."""
    def plain(token, ranks):
        parts = [token[i:i + 1] for i in range(len(token))]
        while token not in ranks and (pairs := [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]):
            i = min(pairs)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[token]] if token in ranks else [ranks[p] for p in parts]

    rng = np.random.default_rng(3)
    some = lambda most: bytes(rng.choice(list(b"abc"), rng.integers(0, most + 1)).tolist())
    for _ in range(300):
        known = sorted({b"a", b"b", b"c"} | {some(5) for _ in range(12)} - {b""})
        ranks = dict(zip(known, rng.permutation(len(known)).tolist()))
        tokens = [some(14) for _ in range(8)]
        assert B.merge_all(tokens, ranks) == [plain(t, ranks) for t in tokens]


def test_round_trip_digests(frame, awkward, empty, encoding):
    got = sorted(map(tuple, B.round_trip_digests(frame).collect()), key=str)
    want = []
    for i, t in awkward:
        ids = encoding.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert B.round_trip_digests(empty).count() == 0
    decoded = {(r.doc_id, bytes(r.bytes)) for r in B.decoded(B.encoded(frame)).collect()}
    assert decoded == {(i, (t or "").encode()) for i, t in awkward}


def test_packing(frame, awkward, empty, tokenizer):
    pieces = packing.pack(frame).cache()
    rows = pieces.toPandas()
    assert packing.pack(empty).count() == 0
    by_sequence = {s: g.sort_values("offset") for s, g in rows.groupby("sequence_id")}
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, g in by_sequence.items():
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]]
        assert g.length.sum() == packing.SEQUENCE or s == len(by_sequence) - 1
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in awkward]
    assert sorted((i, len(w)) for (i, _), w in zip(awkward, want) if i is not None) == sorted(
        (int(r.doc_id), r.doc_tokens) for r in rows[(rows.start == 0) & rows.doc_id.notna()].itertuples()
    )
    joined = b"".join(bytes(r.ids) for r in packing.sequences(pieces).orderBy("sequence_id").collect())
    assert sorted(x.tobytes() for x in want) == sorted(x + b"\1\0\0\0" for x in _split(joined))
    sums = packing.pieces_with_checksum(pieces).toPandas()
    assert sorted(sums.ids_crc32) == sorted(zlib.crc32(bytes(x)) for x in rows.ids)


def _split(joined):
    ids, out, last = np.frombuffer(joined, "<u4"), [], 0
    for end in np.flatnonzero(ids == 1):
        out.append(ids[last:end].tobytes())
        last = end + 1
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", " ", "\n", "don't", "é", "12 ", "a"]), max_size=8).map("".join))
def test_added_tokens_keep_their_ids(text):
    assert packing.encode([text], JSON, added=True)[0] == Tokenizer.from_file(JSON).encode(text, add_special_tokens=False).ids


def test_packed_query_has_added_tokens(spark, monkeypatch):
    monkeypatch.setattr(packing, "documents", lambda *_: spark.createDataFrame([(1, "a<|endoftext|>b")], "doc_id long, text string"))
    want = [*Tokenizer.from_file(JSON).encode("a<|endoftext|>b", add_special_tokens=False).ids, 1]
    row = packing.op4_packing(spark, "").first()
    assert 50256 in want and (row.length, row.ids_crc32) == (len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
