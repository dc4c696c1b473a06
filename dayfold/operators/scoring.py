"""Log-loss, stability, drift and score trends on long prediction tables.

Long predictions: keys, target, y, p, and a run name. Every score is one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import log_loss_term, ratio
from dayfold.schema import KEYS


def log_loss(y: Column | str = "y", p: Column | str = "p") -> Column:
    return F.avg(log_loss_term(y, p))


def target_scores(predictions: DataFrame, by: list[str] = ["run"]) -> DataFrame:
    """Log-loss per run and target; rows without label or prediction do not count."""
    return predictions.groupBy(*by, "target").agg(log_loss().alias("score"))


def macro_scores(scores: DataFrame, by: list[str] = ["run"]) -> DataFrame:
    """Mean and population deviation over the targets."""
    return scores.groupBy(*by).agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


def global_means(labels: DataFrame, by: list[str] = []) -> DataFrame:
    """Positive rate per target: one row per target (and per ``by`` value)."""
    return labels.groupBy(*by, "target").agg(F.avg("y").alias("global_mean"))


def dummy_predictions(labels: DataFrame) -> DataFrame:
    """The training mean of each target for every row. The broadcast side has one row per target."""
    return labels.join(F.broadcast(global_means(labels)), "target").withColumnRenamed("global_mean", "p")


def stability_table(predictions: DataFrame, folds: DataFrame) -> DataFrame:
    """Log-loss per target, seed and fold, with the target's mean and deviation attached."""
    scored = (
        predictions.join(folds, [*KEYS, "target"])
        .groupBy("target", "fold_id", "seed").agg(log_loss().alias("logloss"))
    )
    target = Window.partitionBy("target")  # seeds x folds rows per target
    return scored.select(
        "target", F.col("fold_id").alias("fold"), "seed", "logloss",
        F.avg("logloss").over(target).alias("mean"), F.stddev_pop("logloss").over(target).alias("std"),
    )


def paired(left: DataFrame, right: DataFrame, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Two runs side by side, aligned on keys and target."""
    on = [*KEYS, "target"]
    return left.select(*on, "y", F.col("p").alias(names[0])).join(
        right.select(*on, F.col("p").alias(names[1])), on
    )


def drift(pairs: DataFrame, mean_limit: float, max_limit: float, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    """Mean and largest absolute difference of two aligned runs per target, with a pass flag."""
    gap = F.abs(F.col(names[0]) - F.col(names[1]))
    stats = pairs.groupBy("target").agg(F.avg(gap).alias("mean_abs"), F.max(gap).alias("max_abs"))
    ok = (F.col("mean_abs") <= mean_limit) & (F.col("max_abs") <= max_limit)
    return stats.withColumn("ok", ok.cast("int"))


def compare_runs(predictions: DataFrame, dummy: str) -> DataFrame:
    """Mean, deviation and gain over the dummy run for every run."""
    macro = macro_scores(target_scores(predictions))
    base = macro.where(F.col("run") == dummy).select("mean").scalar()
    return macro.select("run", "mean", "std", (base - F.col("mean")).alias("improvement"))


def linear_trend(points: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """Least-squares line through (x, y) and its value at ``at``."""
    fit = points.groupBy(*by).agg(
        F.regr_slope(F.col(y), F.col(x)).alias("slope"), F.regr_intercept(F.col(y), F.col(x)).alias("intercept")
    )
    return fit.withColumn("projection", F.col("slope") * at + F.col("intercept"))


def quadratic_trend(points: DataFrame, by: list[str], x: str, y: str, at: float) -> DataFrame:
    """Least-squares parabola from power sums, its vertex and its value at ``at``."""
    fx, fy = F.col(x), F.col(y)
    powers = {f"s{k}": F.sum(F.pow(fx, F.lit(k))) for k in range(5)}
    mixed = {f"t{k}": F.sum(F.pow(fx, F.lit(k)) * fy) for k in range(3)}
    sums = points.groupBy(*by).agg(*[c.alias(n) for n, c in (powers | mixed).items()])
    s = [F.col(f"s{k}") for k in range(5)]
    t = [F.col(f"t{k}") for k in range(3)]

    def det(m: list[list[Column]]) -> Column:
        (a, b, c), (d, e, f), (g, h, i) = m
        return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)

    whole = det([[s[4], s[3], s[2]], [s[3], s[2], s[1]], [s[2], s[1], s[0]]])
    top = {
        "a": det([[t[2], s[3], s[2]], [t[1], s[2], s[1]], [t[0], s[1], s[0]]]),
        "b": det([[s[4], t[2], s[2]], [s[3], t[1], s[1]], [s[2], t[0], s[0]]]),
        "c": det([[s[4], s[3], t[2]], [s[3], s[2], t[1]], [s[2], s[1], t[0]]]),
    }
    fit = sums.select(*by, *[ratio(c, whole).alias(n) for n, c in top.items()])
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    vertex = F.when(F.abs(a) > 1e-15, ratio(-b, 2.0 * a))
    return fit.select("*", vertex.alias("vertex"), (a * at * at + b * at + c).alias("estimate"))


def prediction_statistics(predictions: DataFrame, by: list[str] = ["target"]) -> DataFrame:
    return predictions.groupBy(*by).agg(
        F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max")
    )


def seen_subject_rate(test: DataFrame, train: DataFrame) -> DataFrame:
    """Share of rows to predict whose subject has training rows."""
    known = train.select("subject_id").distinct().withColumn("__seen", F.lit(1.0))
    return test.join(known, "subject_id", "left").agg(F.avg(F.coalesce("__seen", F.lit(0.0))).alias("seen_rate"))
