import random
import zlib

import numpy as np
import pytest

from dayfold.llm import pseudo_likelihood as L
from dayfold.llm import quality, toxicity
from tests.llm.conftest import SCHEMA, prose, rows_of

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, rng.randint(40, 120)).split(" ")
        toxic, poor = i % 6 == 0, i % 7 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vermin", "dimwit", "wretch"]))
        if poor:
            words = [w + rng.choice(["%%%", "$$$", "***"]) for w in words]
        texts.append((i, " ".join(words)))
        labels.append((i, int(not poor), int(toxic)))
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).cache()
    return docs, spark.createDataFrame(labels + [(None, 1, 1), (700, None, None), (3, 1, 0)], LABELS).cache(), labels


def test_toxicity_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    rows = {r.doc_id: r.likely for r in toxicity.scored(docs, toxicity.fit(docs, labels), "likely").collect()}
    held = [(rows[i] >= 0.5, t) for i, _, t in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([p for p, t in held if t]) > 0.9 and np.mean([p for p, t in held if not t]) < 0.05


def test_toxicity_of_odd_rows(labelled, frame, empty, spark):
    docs, labels, _ = labelled
    model = toxicity.fit(docs, labels)
    rows = toxicity.scored(frame, model, "likely").collect()
    assert len(rows) == frame.count() and all(0 <= r.likely <= 1 for r in rows)
    assert {r.likely < 0.5 for r in rows if not (r.text or "").strip()} == {True}
    assert toxicity.drop_toxic(frame, model).columns == frame.columns
    assert toxicity.drop_toxic(empty, model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.fit(empty, labels).weights == {}


def test_quality_on_held_out_rows(labelled):
    docs, labels, truth = labelled
    rows = {r.doc_id: r.v.kept for r in quality.judged(docs, quality.fit(docs, labels), "v").collect()}
    held = [(rows[i], q) for i, q, _ in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([k for k, q in held if q]) > 0.97 and np.mean([k for k, q in held if not q]) < 0.1


def test_quality_counts():
    words = "a b c d e x a b c d e y a b c d e"
    counts, _ = quality.statistics(words + "\n\n#$ |\n#$ |\n \n#$ |")
    assert counts == [23, 26, 9, 2, 15]
    assert quality.statistics(None)[0] == [0] * 5 and quality.base_failed([9, 0, 0, 0, 0])
    assert quality.base_failed([100, 0, 0, 0, 21]) and not quality.base_failed([100, 0, 0, 0, 20])
    rng = random.Random(4)
    for _ in range(200):
        w = [rng.choice("ab") for _ in range(rng.randint(0, 30))]
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(5)}
        assert quality.statistics(" ".join(w))[0][4] == len(covered)


def test_quality_of_odd_rows(labelled, frame, empty):
    docs, labels, _ = labelled
    model = quality.fit(docs, labels)
    kept = quality.keep_good(frame, model)
    assert kept.schema == frame.schema and kept.where("text is null or trim(text) = ''").count() == 0
    assert quality.keep_good(empty, model).count() == 0
    nothing = quality.fit(docs, labels.limit(0))
    assert quality.keep_good(docs, nothing).count() == docs.count()


def test_isolation_forest_isolates():
    rng = np.random.default_rng(0)
    good = rng.normal(0, 1, (2000, 4))
    odd = rng.normal(6, 1, (40, 4))
    forest = quality.fit_forest(good, odd)
    a, b = quality.path_lengths(forest, good), quality.path_lengths(forest, odd)
    assert b.mean() < a.mean() - 2
    assert len(quality.path_lengths(forest, np.zeros((0, 4)))) == 0


def test_gradient_of_the_network():
    net = L.fresh()
    padded = np.concatenate(([L.WORDS] * 2, np.random.default_rng(1).integers(0, L.WORDS, 40), [L.WORDS] * 2)).astype(np.int32)
    places = np.arange(2, 42)
    loss = lambda n: -L.log_probabilities(n, padded, places).mean()
    trainer = L.Trainer(net)
    trainer.squares = [np.zeros(p.shape, np.float32) for p in net]
    before = [p.copy() for p in trainer.net]
    trainer.squares = [np.full(p.shape, 1e12, np.float32) for p in net]  # steps so small that they follow the gradient
    trainer.step(padded, places)
    gradient = [np.sqrt(np.maximum(s - np.float32(1e12), 0)) for s in trainer.squares]
    assert loss(trainer.net) <= loss(L.Network(*before)) + 1e-6 and len(gradient) == 7
    for _ in range(30):
        fast = L.Trainer(trainer.net)
        fast.step(padded, places)
        trainer.net = fast.net
    assert loss(trainer.net) < loss(L.Network(*before)) - 0.5


def test_log_probabilities_sum_to_one():
    net = L.fresh()
    around = np.array([[1, 2, 3, 4]] * L.WORDS)
    _, _, by_class, inner, _ = L._forward(net, around, np.arange(L.WORDS))
    rows = np.arange(L.WORDS)
    size = L.WORDS // L.CLASSES
    assert np.exp(by_class[rows, rows // size] + inner[rows, rows % size]).sum() == pytest.approx(1, abs=1e-4)


def test_scores_prefer_the_corpus(labelled, frame, empty, awkward):
    docs, _, _ = labelled
    net = L.train(docs)
    rows = L.scored(frame, net).collect()
    assert len(rows) == len(awkward)
    assert all(r.log_likelihood == 0 and r.mean_log_likelihood is None for r in rows if r.n_words == 0)
    assert len({(r.n_words, round(r.log_likelihood, 4)) for r in rows if r.doc_id in (1, 43)}) == 1
    long = next(r.mean_log_likelihood for r in rows if r.doc_id == 50)
    assert long > -np.log(L.WORDS) + 1  # far better than guessing
    assert L.scored(empty, net).count() == 0 and L.scored(empty, L.train(empty)).count() == 0


def test_toxicity_windows():
    assert toxicity.windows(None) == set() and toxicity.windows("A a  B") == {b"a", b"b"}
    assert toxicity.windows("x" * 130) == {b"x" * 64, b"xx"}
