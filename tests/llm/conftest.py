import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double, fp long, verdict string, bucket int"


def prose(rng, n, words=None):
    words = words or ["alpha", "beta", "gamma", "Delta,", "epsilon", "zeta.", "eta", "théta", "iota", "kappa"]
    return " ".join(rng.choice(words) + rng.choice(["", "", "s", "ing", "ly"]) for _ in range(n))


def rows_of(texts):
    return [(i, t, "en", f"s{(i or 0) % 2}", None if t is None else len(t), "x", 1.0, 7, "block", 3) for i, t in texts]


@pytest.fixture(scope="session")
def awkward():
    """(doc_id, text): nulls, empties, blanks, copies, near copies, shared passages, a long text, odd characters."""
    rng = random.Random(5)
    shared = prose(rng, 60)
    base = [prose(rng, rng.randint(5, 150)) for _ in range(30)]
    near = base[0].replace("alpha", "omega", 1)
    texts = [(i, t) for i, t in enumerate(base)]
    texts += [
        (40, None), (41, ""), (42, " \t\n "), (43, base[1]), (44, near), (45, base[2] + "\n" + shared), (46, shared + " tail"), (47, "x"),
        (48, "aaaa" * 60), (49, "a b " * 60), (50, prose(rng, 9000)), (51, "naïve \u2003 日本語 🎉 <|endoftext|> it's 12\u00b2 \r\n\x0b end"),
        (52, base[3]), (52, base[3]), (53, base[4] + shared), (53, shared + base[5]), (None, shared), (None, base[6]), (-7, base[7]),
    ]
    return texts


@pytest.fixture(scope="session")
def frame(spark, awkward):
    return spark.createDataFrame(rows_of(awkward), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
