"""Post-hoc candidate: temporal priors, blend, score, guard."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayfold.operators import blend, guards
from dayfold.operators.neighbours import targetwise_temporal_prior
from dayfold.schema import KEYS, TARGETWISE_PRIOR_WEIGHTS

ROW = [*KEYS, "target"]


def temporal_pairs(base: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base predictions (a) next to the temporal prior (b) for labelled and unlabelled rows.

    ``base`` is (keys, split, target, y, p). Labelled rows leave their own day out.
    """
    out = []
    for split, exclude in (("train", True), ("test", False)):
        rows = base.where(F.col("split") == split)
        prior = targetwise_temporal_prior(rows, labels, exclude_same_day=exclude)
        pairs = rows.select(*ROW, "y", F.col("p").alias("a")).join(prior.select(*ROW, F.col("p").alias("b")), ROW)
        out.append(pairs)
    return out[0], out[1]


def temporal_candidate(
    base: DataFrame, labels: DataFrame, weights: Mapping[str, float] = TARGETWISE_PRIOR_WEIGHTS
) -> tuple[DataFrame, DataFrame]:
    """Blended predictions of both splits: (keys, target, y, a, b, p)."""
    train, test = temporal_pairs(base, labels)
    return blend.mix_runs(train, weights, clip=True), blend.mix_runs(test, weights, clip=True)


def judge_candidate(train: DataFrame, test: DataFrame, name: str, weights: Mapping[str, float]) -> DataFrame:
    """Guard verdict of a blended candidate against its base."""
    as_pairs = lambda df: df.select(*ROW, "y", "a", F.col("p").alias("b"))
    effects = guards.target_effects(as_pairs(train), as_pairs(test))
    return guards.guard_candidate(effects, name, list(weights.values()))
