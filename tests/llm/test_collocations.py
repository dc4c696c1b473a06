import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from dayfold.llm import collocations as C
from tests.llm.conftest import rows_of, SCHEMA


def slow(texts, least, longest, share):
    """texts: (lang, text) -> {(lang, phrase): (a, l, r, n, score)}, straight from the definition."""
    f, n = Counter(), Counter()
    for lang, text in texts:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", tuple(w[i:i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    kept = {x: a for x, a in f.items() if a >= least and len(x[1]) > 1}
    out = {}
    for (lang, p), a in kept.items():
        inside = (x for (other, x), b in kept.items() if other == lang and len(x) > len(p) and 100 * b >= share * a)
        if any(x[i:i + len(p)] == p for x in inside for i in range(len(x) - len(p) + 1)):
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out[lang, " ".join(p)] = (a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score)
    return out


@pytest.mark.parametrize("share", [100, 60])
def test_against_the_definition(spark, awkward, share):
    langs = ["en", None, "de", "und"]
    rows = [(*r[:2], langs[k % 4], *r[3:]) for k, r in enumerate(rows_of(awkward + [(90, "New York, New York! NEW york\tnew\tyork"), (91, "É É é É É")]))]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {(r.lang, r.phrase): (r.a, r.l, r.r, r.n, r.score) for r in C.collocations(docs, 3, 5, share).collect()}
    want = slow([(r[2], r[1]) for r in rows], 3, 5, share)
    assert got == want and len(want) > 100


def test_words_are_cut_at_marks_and_texts(spark):
    w = C.words_of(pa.array(["One two,three", "", "four . five", "\x01six six"]), pa.array(["a", "a", "b", "b"]))
    assert [w.word[i].as_py() for i in w.at] == ["one", "two", "three", "four", "five", "\x01six", "six"]
    assert w.joined.tolist() == [True, False, False, False, False, True, False]


def test_filter_holds_back_no_member(spark):
    codes = np.random.default_rng(1).integers(-2 ** 63, 2 ** 63, 3000)
    made = C.bit_filter(spark.createDataFrame([(int(c),) for c in codes], "code long"))
    assert made.has(codes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(0, 2 ** 63, 3000).astype(np.uint64)
    assert made.has(others).mean() < 0.1
    assert not C.bit_filter(spark.createDataFrame([], "code long")).has(others).any()


def test_no_rows(spark, empty):
    assert C.first_of_each(C.collocations(empty, 1)).count() == 0
    assert C.collocations(spark.createDataFrame(rows_of([(1, None), (2, " .,")]), SCHEMA), 1).count() == 0


def test_large_counts_do_not_overflow(spark):
    """1000 a n passes 64 bits: streams are made by hand."""
    big = 10 ** 12
    streams = spark.createDataFrame([("en", ["a"], 2 * big), ("en", ["b"], 3 * big), ("en", ["a", "b"], big)], "lang string, words array<string>, f long")
    totals = spark.createDataFrame([("en", 10 ** 13)], "lang string, n long")
    original, C.count_streams = C.count_streams, lambda *a, **k: (streams, totals)
    try:
        row = C.collocations(spark.createDataFrame([("x", "en")], "text string, lang string")).first()
    finally:
        C.count_streams = original
    assert (row.phrase, row.l, row.r, row.score) == ("a b", 2 * big, 3 * big, 1000 * big * 10 ** 13 // (6 * big * big))


def test_ranks(spark):
    rows = [("en", f"p{i % 7} {chr(233 if i % 2 else 122)}{i}", i % 3 + 5, 1, 1, 9, i % 4) for i in range(40)]
    found = C.first_of_each(spark.createDataFrame(rows, "lang string, phrase string, a long, l long, r long, n long, score long"), 11).orderBy("rank").collect()
    want = sorted(rows, key=lambda r: (-r[6], -r[2], r[1].encode()))[:11]
    assert [(r.rank, r.phrase) for r in found] == [(i + 1, r[1]) for i, r in enumerate(want)]


def test_orders_are_joined_once(spark, frame):
    """What the lockstep joins have made is written: the result's plan does not repeat them for the driver to hold."""
    plan = C.collocations(frame, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 2
