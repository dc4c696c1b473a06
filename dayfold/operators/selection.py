"""Feature scores, top-k choices and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.operators.quantiles import exact_quantiles
from dayfold.functions.scalar import finite, ratio


def long_features(df: DataFrame, ids: list[str], features: list[str]) -> DataFrame:
    """(ids, feature, x) rows from a wide table."""
    wide = df.select(*ids, *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(ids, features, "feature", "x")


def absolute_correlations(long: DataFrame, by: list[str] = ["feature"]) -> DataFrame:
    """|Pearson| of x and y over complete pairs; under three pairs or without spread 0.

    Built from covariance and deviations because ``corr`` raises on a constant series.
    """
    rows = long.where(F.col("x").isNotNull() & F.col("y").isNotNull())
    y = F.col("y").cast("double")
    spread = F.stddev_pop("x") * F.stddev_pop(y)
    score = F.abs(ratio(F.covar_pop(F.col("x"), y), spread))
    flat = (F.stddev_pop("x") == 0) | (F.stddev_pop(y) == 0)
    guarded = F.when((F.count("*") < 3) | flat, 0.0).otherwise(F.coalesce(score, F.lit(0.0)))
    return rows.groupBy(*by).agg(guarded.alias("score"))


def first_per(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group in the given order, with their rank."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.where(F.col(rank) <= n)


def select_features(
    scores: DataFrame, top_k: int, forced: list[str], extra: str, by: list[str] = ["target"]
) -> DataFrame:
    """Top-k features by score (ties by name), then forced ones by name, then the extra one.

    A name that appears twice keeps its first place. Rows are features, not data.
    """
    best = first_per(scores.where("score > 0"), by, [F.desc("score"), F.asc("feature")], top_k)
    best = best.select(*by, "feature", F.col("rank").cast("int").alias("place"))
    groups = scores.select(*by).distinct()
    fixed = [*sorted(forced), extra]
    added = groups.select(
        *by,
        F.explode(F.array(*[
            F.struct(F.lit(name).alias("feature"), F.lit(top_k + i).alias("place"))
            for i, name in enumerate(fixed, start=1)
        ])).alias("e"),
    ).select(*by, "e.feature", "e.place")
    merged = best.unionByName(added).groupBy(*by, "feature").agg(F.min("place").alias("place"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("place"))
    return merged.select(*by, "feature", place.alias("place"))


def importance_statistics(importances: DataFrame, by: list[str] = ["target"]) -> DataFrame:
    """Mean, sample deviation and variation of each feature over seeds (and folds)."""
    stats = importances.groupBy(*by, "feature").agg(
        F.avg("gain").alias("mean_gain"), F.stddev_samp("gain").alias("std_gain")
    )
    return stats.withColumn("cv_gain", F.col("std_gain") / (F.abs("mean_gain") + 1e-9))


def stable_features(
    importances: DataFrame, top_k: int | None, cv_limit: float = 1.5, strict_median: bool = False,
    usable: DataFrame | None = None, by: list[str] = ["target"],
) -> DataFrame:
    """Features with steady gain or a gain at (or above) the median, by falling mean.

    ``usable`` names features with enough values and variance. When nothing passes both rules the
    usable ones are ranked, and when none is usable all are.
    """
    stats = importance_statistics(importances, by)
    medians = stats.groupBy(*by).agg(F.percentile("mean_gain", F.lit(0.5)).alias("__median"))
    high = F.col("mean_gain") > F.col("__median") if strict_median else F.col("mean_gain") >= F.col("__median")
    rows = stats.join(medians, by)
    rows = rows.withColumn("__stable", ((F.coalesce("cv_gain", F.lit(0.0)) <= cv_limit) | high).cast("int"))
    if usable is None:
        rows = rows.withColumn("__usable", F.lit(1))
    else:
        flags = usable.select("feature", F.lit(1).alias("__usable"))
        rows = rows.join(flags, "feature", "left").withColumn("__usable", F.coalesce("__usable", F.lit(0)))
    group = Window.partitionBy(*by)
    tier = F.when(F.max(F.col("__stable") * F.col("__usable")).over(group) > 0, 2).when(
        F.max("__usable").over(group) > 0, 1
    ).otherwise(0)
    rows = rows.withColumn("__tier", tier)
    keep = (
        F.when(F.col("__tier") == 2, F.col("__stable") * F.col("__usable"))
        .when(F.col("__tier") == 1, F.col("__usable")).otherwise(1)
    )
    kept = rows.where(keep == 1).select(*by, "feature", "mean_gain", "cv_gain")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("mean_gain"), "feature"))
    ranked = kept.withColumn("place", place)
    return ranked if top_k is None else ranked.where(F.col("place") <= top_k)


def usable_features(long: DataFrame, missing_limit: float = 0.95, variance_floor: float = 1e-12) -> DataFrame:
    """Features with a missing rate below the limit and variance after median filling.

    Median filling of the m missing among n values changes the variance only through sums, so
    the table is aggregated twice and never rewritten.
    """
    x = finite("x")
    stats = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.count(x).alias("k"), F.avg(x).alias("mu"), F.var_pop(x).alias("var")
    )
    medians = feature_medians(long)
    m = F.col("n") - F.col("k")
    mean_all = (F.col("k") * F.col("mu") + m * F.col("median")) / F.col("n")
    about = lambda c: (c - mean_all) * (c - mean_all)
    squares = F.col("k") * (F.col("var") + about(F.col("mu"))) + m * about(F.col("median"))
    joined = stats.join(medians, "feature", "left")
    variance = ratio(squares, F.col("n") - 1)
    return joined.where((m / F.col("n") < missing_limit) & (variance > variance_floor)).select("feature")


def feature_medians(long: DataFrame) -> DataFrame:
    """Exact medians per feature by rank selection over value buckets: a feature has a value per row."""
    return exact_quantiles(long, ["feature"], finite("x"), {"median": 0.5})


def top_importances(importances: DataFrame, view: list[str], top_k: int = 50, by: list[str] = ["target"]) -> DataFrame:
    """Mean-importance top-k restricted to the columns of a view."""
    inside = importances.where(F.col("feature").isin(view))
    means = inside.groupBy(*by, "feature").agg(F.avg("gain").alias("mean_gain"))
    return first_per(means, by, [F.desc("mean_gain"), F.asc("feature")], top_k, "place")


def best_settings(scores: DataFrame, by: list[str] = ["target"], order: str = "config") -> DataFrame:
    """Lowest score per group; the earlier setting wins a tie."""
    return first_per(scores, by, [F.asc("score"), F.asc(order)]).drop("rank")


def best_subset_size(results: DataFrame, full: str = "all") -> DataFrame:
    """Best k per target with its gain over the full set; rows are (target, k, k_order, n, oof)."""
    best = first_per(results, ["target"], [F.asc("oof"), F.asc("k_order")]).drop("rank")
    whole = results.where(F.col("k") == full).select("target", F.col("oof").alias("full_oof"))
    return best.join(whole, "target").select(
        "target", F.col("k").alias("best_k"), F.col("n").alias("best_n"), "full_oof",
        F.col("oof").alias("best_oof"), (F.col("full_oof") - F.col("oof")).alias("delta"),
    )


def candidate_ranking(scores: DataFrame, notes: dict[str, tuple[int, str]]) -> DataFrame:
    """Candidates with a fixed rank and note; ``scores`` has run and mean."""
    entries = F.array(*[
        F.struct(F.lit(n).alias("run"), F.lit(r).alias("rank"), F.lit(t).alias("notes")) for n, (r, t) in notes.items()
    ])
    matched = F.filter(entries, lambda e: e["run"] == F.col("run"))
    rows = scores.withColumn("__note", F.try_element_at(matched, F.lit(1))).where(F.col("__note").isNotNull())
    return rows.select(
        F.col("__note.rank").alias("rank"), F.col("run").alias("candidate"),
        F.col("mean").alias("oof_mean"), F.col("__note.notes").alias("notes"),
    )
