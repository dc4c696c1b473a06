import hashlib
import random
import re

import numpy as np
import pytest

from dayfold.llm import automata, phrases, suffixes
from tests.llm.conftest import SCHEMA, prose, rows_of

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
BIG = 2 ** 63 - 1


def slow_bytes(texts):
    least = {}
    for i, t in texts:
        b, key = (t or "").encode(), BIG if i is None else i
        for k in range(len(b) - 49):
            least[b[k:k + 50]] = min(least.get(b[k:k + 50], key), key)
    out = []
    for i, t in texts:
        b, key = (t or "").encode(), BIG if i is None else i
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if least[b[k:k + 50]] < key:
                gone[k:k + 50] = True
        spans = int((gone[:-1] & ~np.concatenate(([False], gone[:-2]))).sum()) if len(b) else 0
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return out


def slow_words(texts):
    """Rows of one id with different texts come in some order, so the caller leaves those out."""
    words = [(BIG if i is None else i, WORD.findall((t or "").encode())) for i, t in texts]
    first = {}
    for i, w in words:
        for k in range(len(w) - 19):
            s = tuple(w[k:k + 20])
            first[s] = min(first.get(s, (i, k)), (i, k))
    out = []
    for (i, t), (key, w) in zip(texts, words):
        gone = set()
        for k in range(len(w) - 19):
            if first[tuple(w[k:k + 20])] != (key, k):
                gone.update(range(k, k + 20))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def by_text(rows):
    return sorted(rows, key=str)


def test_bytes_against_brute_force(frame, awkward, empty):
    rows = suffixes.repeated_bytes(frame).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert by_text(map(tuple, rows)) == by_text(slow_bytes(awkward))
    assert suffixes.repeated_bytes(empty).count() == 0


def test_words_against_brute_force(spark, awkward, empty):
    texts = [(i, t) for i, t in awkward if i not in (53, None)]
    rows = automata.repeated_words(spark.createDataFrame(rows_of(texts), SCHEMA)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert by_text(map(tuple, rows)) == by_text(slow_words(texts))
    assert automata.repeated_words(empty).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_many_overlaps(spark, seed):
    """Few words and many cut-and-pasted pieces, so that windows overlap in every way; short parses."""
    rng = random.Random(seed)
    pool = [prose(rng, 50, ["ab", "cd", "é", "f"]) for _ in range(6)]
    texts = []
    for i in range(60):
        parts = [p[a:a + rng.randint(20, 200)] for p in rng.choices(pool, k=3) for a in [rng.randint(0, 60)]]
        texts.append((rng.randint(0, 10 ** 6) * 100 + i, rng.choice([" ", "\n", "  "]).join(parts)))
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    rows = suffixes.repeated_bytes(df).selectExpr("doc_id", "n_bytes", "n_removed", "size(spans)", "kept_sha256").collect()
    assert by_text(map(tuple, rows)) == by_text(slow_bytes(texts))
    rows = automata.repeated_words(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert by_text(map(tuple, rows)) == by_text(slow_words(texts))


def test_pieces_of_a_long_text_cover_every_window(monkeypatch):
    monkeypatch.setattr(phrases, "PARSE", 120)
    for sizes in ([500], [60, 700, 3, 49, 50], [10]):
        seen = {(t, k) for group in phrases.segments(np.array(sizes), 50) for t, base, n in group for k in range(base, base + n - 49)}
        assert seen == {(t, k) for t, n in enumerate(sizes) for k in range(n - 49)}


def test_equal_windows_have_equal_triggers():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    p = phrases.parse(phrases.BYTE_CODES[data], np.array([1500, 20, 2480]), 50, 12)
    covered = {}
    for text, start, windows, shift, first in zip(p.text, p.start, p.windows, p.shift, p.first):
        for w in range(windows):
            content = data[first + w:first + w + 50].tobytes()
            trigger = data[first + shift:first + shift + 12].tobytes()
            assert covered.setdefault(content, trigger) == trigger
    assert int(p.windows.sum()) == 1451 + 2431


def test_suffix_order():
    flat = np.frombuffer(b"banana" * 30, np.uint8)
    places = np.arange(len(flat) - 50)
    order, same = suffixes.suffix_order(flat, places, 50)
    found = [flat[i:i + 50].tobytes() for i in order]
    assert found == sorted(found)
    assert same.tolist() == [False, *(a == b for a, b in zip(found, found[1:]))]


def test_suffix_automaton():
    rng = random.Random(3)
    for _ in range(50):
        shard, texts = automata.SuffixAutomaton(), []
        for _ in range(4):
            words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 25))]
            want = [max((n for n in range(j + 2) if any(tuple(words[j + 1 - n:j + 1]) == tuple(t[k:k + n]) for t in texts for k in range(len(t) - n + 1))), default=0) for j in range(len(words))]
            assert shard.matches(words) == want
            shard.add(words)
            texts.append(words)


def test_rewritten_documents(frame, empty):
    out = suffixes.without_repeated_bytes(frame)
    assert out.schema == frame.schema and out.count() == frame.count()
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[40].text is None and rows[43].text == "" and rows[43].n_chars == 0 and rows[43].extra == "x"
    assert suffixes.without_repeated_bytes(empty).count() == 0
