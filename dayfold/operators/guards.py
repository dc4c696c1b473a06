"""Candidate guards and target-wise selection with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.operators.scoring import log_loss
from dayfold.schema import FORBIDDEN_NAME_TOKENS


def target_effects(train_pairs: DataFrame, test_pairs: DataFrame) -> DataFrame:
    """Score change (b minus a) on labelled rows and mean move on test rows, per target."""
    scores = train_pairs.groupBy("target").agg(
        log_loss("y", "a").alias("current_score"), log_loss("y", "b").alias("candidate_score")
    )
    moves = test_pairs.groupBy("target").agg(F.avg(F.abs(F.col("b") - F.col("a"))).alias("drift"))
    joined = scores.join(moves, "target")
    return joined.withColumn("delta", F.col("candidate_score") - F.col("current_score"))


def guard_candidate(
    effects: DataFrame, name: str, weights: list[float] | None = None, exempt: str = "S4",
    min_improved: int = 2, max_loss: float = 5e-5, max_drift: float = 0.005, allow_name: bool = False,
) -> DataFrame:
    """One verdict row: approved flag and the list of broken rules."""
    hits = [t for t in FORBIDDEN_NAME_TOKENS if t in name.lower()]
    row = effects.agg(
        F.count(F.when((F.col("target") != exempt) & (F.col("delta") < 0), 1)).alias("improved"),
        F.greatest(F.max("delta"), F.lit(0.0)).alias("worst_loss"),
        F.max("drift").alias("worst_drift"),
    )
    empty_weights = weights is not None and not any(abs(w) > 1e-12 for w in weights)
    rules: list[tuple[str, Column]] = [
        ("forbidden name", F.lit(bool(hits) and not allow_name)),
        ("too few improved targets", F.col("improved") < min_improved),
        ("target loss too large", F.col("worst_loss") > max_loss),
        ("test drift too large", F.col("worst_drift") > max_drift),
        ("no test effect", F.col("worst_drift") <= 1e-12),
        ("all weights zero", F.lit(empty_weights)),
    ]
    broken = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return row.select(
        F.lit(name).alias("candidate"), "improved", "worst_loss", "worst_drift",
        (F.size(broken) == 0).cast("int").alias("approved"), F.array_join(broken, "; ").alias("failures"),
    )


def numeric_leaves(payload) -> list[float]:
    """All numbers of a nested weight configuration."""
    if isinstance(payload, bool) or isinstance(payload, str) or payload is None:
        return []
    if isinstance(payload, (int, float)):
        return [float(payload)]
    items = payload.values() if isinstance(payload, dict) else payload
    return [x for item in items for x in numeric_leaves(item)]


def select_per_target(
    candidates: DataFrame, baseline: DataFrame, protected: list[str], tolerance: float,
    min_gain: float | None = None,
) -> DataFrame:
    """Best feasible candidate per target, else the baseline.

    ``candidates`` is (target, candidate, score, drift_ok), ``baseline`` is (target, score). Without
    ``min_gain`` a candidate may lose up to the tolerance (nothing on protected targets); with it
    the candidate must gain that much and keep its drift.
    """
    base = baseline.select("target", F.col("score").alias("base_score"))
    rows = candidates.join(base, "target")
    if min_gain is None:
        slack = F.when(F.col("target").isin(protected), 0.0).otherwise(tolerance)
        feasible = F.col("score") <= F.col("base_score") + slack
    else:
        feasible = (F.col("score") <= F.col("base_score") - min_gain) & (F.col("drift_ok") == 1)
    kept = rows.where(feasible).select("target", "candidate", "score", "drift_ok", F.lit(0).alias("tier"))
    stay = base.select(
        "target", F.lit("baseline").alias("candidate"), F.col("base_score").alias("score"),
        F.lit(1).alias("drift_ok"), F.lit(1).alias("tier"),
    )
    order = Window.partitionBy("target").orderBy("tier", "score", "candidate")
    both = kept.unionByName(stay).withColumn("n", F.row_number().over(order))
    return both.where("n = 1").select("target", "candidate", "score", "drift_ok")


def with_global_fallback(primary: DataFrame, safe: DataFrame, baseline: DataFrame, mean_tolerance: float) -> DataFrame:
    """The safe selection for all targets when the primary one fails as a whole.

    It fails when its mean score is above the baseline mean plus the tolerance or when a moved
    target broke the drift limits. The verdict is one row.
    """
    moved_badly = F.max(((F.col("candidate") != "baseline") & (F.col("drift_ok") != 1)).cast("int"))
    verdict = primary.join(baseline.select("target", F.col("score").alias("base_score")), "target").agg(
        ((F.avg("score") > F.avg("base_score") + mean_tolerance) | (moved_badly == 1)).cast("int").alias("failed")
    )
    tagged = primary.withColumn("which", F.lit(0)).unionByName(safe.withColumn("which", F.lit(1)))
    joined = tagged.join(F.broadcast(verdict), F.col("which") == F.col("failed"))
    return joined.select("target", "candidate", "score", "drift_ok", F.col("failed").alias("used_safe"))
