"""Smoothed and half-life priors of a subject, and their grid search.

Subject statistics are plain sums that combine on the map side and are joined back on the
subject, so a subject with a third of all rows is split by the adaptive skew join rather than
gathered. Broadcast sides have one row per target (and fold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import log_loss_term, probability
from dayfold.operators.scoring import global_means
from dayfold.schema import HALF_LIFE_GRID, SMOOTHING_GRID, SUBJECT_SMOOTHING


def smoothed(total: Column, weight: Column, mean: Column, m: Column | float) -> Column:
    return (total + m * mean) / (weight + m)


def subject_sums(train: DataFrame, subject: str = "subject_id", by: list[str] = []) -> DataFrame:
    labelled = train.where(F.col("y").isNotNull())
    return labelled.groupBy(*by, subject, "target").agg(
        F.sum("y").cast("double").alias("y_sum"), F.count("y").alias("y_cnt")
    )


def subject_priors(
    train: DataFrame, m: float = SUBJECT_SMOOTHING, subject: str = "subject_id", by: list[str] = []
) -> DataFrame:
    """(sum + m * global) / (count + m) per subject and target."""
    sums = subject_sums(train, subject, by)
    joined = sums.join(global_means(train, by), [*by, "target"])
    prior = smoothed(F.col("y_sum"), F.col("y_cnt"), F.col("global_mean"), m)
    return joined.select(*by, subject, "target", prior.alias("prior"))


def lookup_prior(
    rows: DataFrame, priors: DataFrame, means: DataFrame, subject: str = "subject_id", by: list[str] = []
) -> DataFrame:
    """Subject prior, or the global mean for an unseen subject, clipped to a probability."""
    joined = rows.join(priors, [*by, subject, "target"], "left").join(means, [*by, "target"])
    p = probability(F.coalesce("prior", "global_mean"))
    return joined.withColumn("p", p).drop("prior", "global_mean")


def leave_one_out_prior(train: DataFrame, m: float = SUBJECT_SMOOTHING, subject: str = "subject_id") -> DataFrame:
    """Prior of the row's subject without the row itself."""
    joined = train.join(subject_sums(train, subject), [subject, "target"]).join(
        F.broadcast(global_means(train)), "target"
    )
    weight = F.greatest(F.col("y_cnt") - 1.0 + m, F.lit(m))
    p = (F.col("y_sum") - F.col("y") + m * F.col("global_mean")) / weight
    return joined.withColumn("p", probability(p)).drop("y_sum", "y_cnt", "global_mean")


def recency_weight(half_life: Column | float | None, age: Column) -> Column:
    """0.5 ** (age / half_life); no half-life weighs every row the same."""
    if half_life is None:
        return F.lit(1.0)
    return F.pow(F.lit(0.5), age / half_life)


def with_age(rows: DataFrame, by: list[str] = []) -> DataFrame:
    """Age in rows inside subject and target: 0 is the newest labelled day."""
    newest = Window.partitionBy(*by, "subject_id", "target").orderBy(F.desc("lifelog_date"))
    return rows.withColumn("age", F.row_number().over(newest) - 1)


def half_life_priors(train: DataFrame, m: float, half_life: float | None, by: list[str] = []) -> DataFrame:
    labelled = train.where(F.col("y").isNotNull())
    w = recency_weight(half_life, F.col("age"))
    sums = with_age(labelled, by).groupBy(*by, "subject_id", "target").agg(
        F.sum(w * F.col("y")).alias("wy"), F.sum(w).alias("w")
    )
    joined = sums.join(global_means(labelled, by), [*by, "target"])
    prior = smoothed(F.col("wy"), F.col("w"), F.col("global_mean"), m)
    return joined.select(*by, "subject_id", "target", prior.alias("prior"))


def prior_grid_scores(outer_train: DataFrame, valid: DataFrame) -> DataFrame:
    """Out-of-fold log-loss of every (smoothing, half-life) pair per target.

    A prior is constant within (fold, subject, target), so training and validation rows are
    first reduced to sums at that grain; the 81 settings only multiply those small rows.
    """
    grain = ["fold_id", "subject_id", "target"]
    trained = with_age(outer_train.where(F.col("y").isNotNull()), ["fold_id"])
    weights = [recency_weight(h, F.col("age")) for h in HALF_LIFE_GRID]
    sums = trained.groupBy(*grain).agg(
        *[F.sum(w * F.col("y")).alias(f"wy{i}") for i, w in enumerate(weights)],
        *[F.sum(w).alias(f"w{i}") for i, w in enumerate(weights)],
    )
    means = global_means(trained, ["fold_id"])
    held = valid.where(F.col("y").isNotNull()).groupBy(*grain).agg(
        F.sum("y").cast("double").alias("hits"), F.count("y").alias("n")
    )
    joined = held.join(sums, grain, "left").join(means, ["fold_id", "target"])
    settings = F.array(*[
        F.struct(
            F.lit(9 * mi + hi).alias("config"), F.lit(m).alias("m"), F.lit(h).cast("double").alias("half_life"),
            F.coalesce(F.col(f"wy{hi}"), F.lit(0.0)).alias("wy"), F.coalesce(F.col(f"w{hi}"), F.lit(0.0)).alias("w"),
        )
        for mi, m in enumerate(SMOOTHING_GRID) for hi, h in enumerate(HALF_LIFE_GRID)
    ])
    rows = joined.select("target", "hits", "n", "global_mean", F.explode(settings).alias("s"))
    p = smoothed(F.col("s.wy"), F.col("s.w"), F.col("global_mean"), F.col("s.m"))
    loss = F.col("hits") * log_loss_term(F.lit(1), p) + (F.col("n") - F.col("hits")) * log_loss_term(F.lit(0), p)
    return rows.groupBy(
        "target", F.col("s.config").alias("config"), F.col("s.m").alias("smoothing_m"),
        F.col("s.half_life").alias("half_life"),
    ).agg((F.sum(loss) / F.sum("n")).alias("score"))


def evaluate_prior(train: DataFrame, valid: DataFrame, m: float = SUBJECT_SMOOTHING) -> DataFrame:
    """Out-of-fold log-loss of the smoothed prior and of the global mean, per target."""
    priors, means = subject_priors(train, m, by=["fold_id"]), global_means(train, ["fold_id"])
    scored = valid.where(F.col("y").isNotNull())
    scored = scored.join(priors, ["fold_id", "subject_id", "target"], "left").join(
        means, ["fold_id", "target"]
    )
    return scored.groupBy("target").agg(
        F.avg(log_loss_term("y", F.coalesce("prior", "global_mean"))).alias("prior_score"),
        F.avg(log_loss_term("y", "global_mean")).alias("dummy_score"),
    )
