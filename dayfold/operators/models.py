"""Model training over fold tables with Spark ML.

The driver only starts fits; rows stay distributed. The feature frame is written to the shared
folder once (``cut_lineage``) because every fit scans it again. Independent fits run side by side
from a small thread pool so that a cluster is not idle between stages of one model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Model, Pipeline
from pyspark.ml.classification import (
    GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier,
)
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import bounded, finite, logit, probability
from dayfold.operators.blend import prior_alpha
from dayfold.operators.folds import calibration_split, outer_train_rows
from dayfold.operators.priors import leave_one_out_prior, lookup_prior, subject_priors
from dayfold.operators.scoring import global_means, macro_scores, target_scores
from dayfold.operators.selection import absolute_correlations, long_features, select_features
from dayfold.schema import KEYS
from dayfold.session import cut_lineage

# Own settings per target (depth, step, row share, minimum leaf, tolerance of the held-out loss), sized for Spark's
# trees, each round of which is some ten jobs: few deep steps instead of thousands of small ones. The held-out loss
# sets the rounds; it falls by one in so many parts for ever where a day's own features decide the target (S1, S3).
TREE_SETTINGS: dict[str, dict] = {
    "Q1": {"maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "minInstancesPerNode": 25, "validationTol": 0.002},
    "Q2": {"maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "minInstancesPerNode": 20, "validationTol": 0.002},
    "Q3": {"maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "minInstancesPerNode": 20, "validationTol": 0.005},
    "S1": {"maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "validationTol": 0.05},
    "S2": {"maxDepth": 3, "stepSize": 0.3, "subsamplingRate": 0.7, "minInstancesPerNode": 15, "validationTol": 0.002},
    "S3": {"maxDepth": 3, "stepSize": 0.5, "subsamplingRate": 0.7, "minInstancesPerNode": 15, "validationTol": 0.05},
    "S4": {"maxDepth": 2, "stepSize": 0.3, "subsamplingRate": 0.6, "minInstancesPerNode": 30, "validationTol": 0.002},
}
PARALLEL_FITS = 4
MakeModel = Callable[[str, int], Pipeline]


def in_parallel(jobs: list[Callable[[], DataFrame]], spark, parallel: int = PARALLEL_FITS) -> list[DataFrame]:
    pool = ThreadPool(max(1, min(parallel, len(jobs))))
    try:
        return pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)
    finally:
        pool.close()


def model_input(df: DataFrame, features: list[str], flags: list[str] = []) -> DataFrame:
    """Finite features with nulls as zero, plus a missing flag for the named ones."""
    kept = [c for c in df.columns if c not in features]
    return df.select(
        *kept,
        *[F.coalesce(finite(f), F.lit(0.0)).alias(f) for f in features],
        *[finite(f).isNull().cast("double").alias(f"{f}__missing") for f in flags],
    )


def boosted_trees(features: list[str], target: str = "", seed: int = 42, **overrides) -> Pipeline:
    settings = {"maxDepth": 4, "stepSize": 0.05, "maxIter": 20, "subsamplingRate": 0.7, "minInstancesPerNode": 20}
    settings |= {k: v for k, v in TREE_SETTINGS.get(target, {}).items() if k != "validationTol"} | overrides
    trees = GBTClassifier(featuresCol="features", labelCol="y", seed=seed, featureSubsetStrategy="0.7", **settings)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), trees])


SUBJECT_FEATURE = "subject_prior_feature"


def encode_subject(reference: DataFrame, others: list[DataFrame], m: float = 5.0) -> list[DataFrame]:
    """Subject as a target statistic, the way ordered boosting treats a category.

    Reference rows get the smoothed prior of their subject without themselves, other rows the
    prior from the reference. An index with one code per subject would have to be collected and
    would outgrow the bins of the trees; this is two sums per subject.
    """
    priors, means = subject_priors(reference, m), global_means(reference)
    encoded = [leave_one_out_prior(reference, m), *[lookup_prior(rows, priors, means) for rows in others]]
    return [df.withColumnRenamed("p", SUBJECT_FEATURE) for df in encoded]


def random_forest(features: list[str], seed: int = 42, **overrides) -> Pipeline:
    """The second, more diverse family for guarded blends."""
    settings = {"numTrees": 20, "maxDepth": 5, "minInstancesPerNode": 20} | overrides
    gather = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[gather, RandomForestClassifier(labelCol="y", seed=seed, **settings)])


def positive(df: DataFrame) -> Column:
    return probability(vector_to_array("probability")[1])


def out_of_fold(
    frame: DataFrame, folds: DataFrame, targets: Iterable[str], seeds: Iterable[int],
    model: MakeModel, forward: bool = False, with_importance: list[str] | None = None, by_subject: bool = False,
) -> tuple[DataFrame, DataFrame | None]:
    """Predictions of every target, seed and fold: (keys, split, target, seed, fold_id, y, p).

    ``frame`` is a materialised wide table with split and target columns; ``folds`` has keys,
    target, seed and fold_id of the validation rows. With ``forward`` a fold trains only on rows
    before each subject's validation start. Rows never validated get no prediction. Rows of
    the test split are predicted by every fold; ``average_runs`` takes the mean. ``by_subject``
    adds the subject as a target statistic of the fold's own training rows.

    The folds are joined once, one column per target and seed; every fit then filters the written frame.
    """
    spark = frame.sparkSession
    jobs, gains = [], []
    plan = sorted((r["target"], r["seed"], r["fold_id"]) for r in
                  folds.select("target", "seed", "fold_id").distinct().collect())  # targets x seeds x folds
    wanted, chosen = set(targets), set(seeds)
    runs = sorted({(t, s) for t, s, _ in plan if t in wanted and s in chosen})
    column = lambda t, s: f"__fold_{t}_{s}"
    mine = lambda t, s: (F.col("target") == t) & (F.col("seed") == s)
    by_key = folds.groupBy(*KEYS).agg(*[F.max(F.when(mine(t, s), F.col("fold_id"))).alias(column(t, s)) for t, s in runs])
    frame = cut_lineage(frame.join(by_key, KEYS, "left"))
    test = frame.where(F.col("split") == "test")

    def fit(target: str, seed: int, fold: int) -> DataFrame:
        rows = frame.where((F.col("split") == "train") & F.col(target).isNotNull())
        rows = rows.withColumn("y", F.col(target).cast("double"))
        held_out = F.col(column(target, seed)).eqNullSafe(fold)
        valid = rows.where(held_out)
        if forward:
            manifest = valid.select(*KEYS, F.lit(fold).alias("fold_id"), F.lit("valid").alias("role"))
            train = outer_train_rows(rows, manifest, "group_time")
        else:
            train = rows.where(~held_out)
        asked = test.withColumn("y", F.lit(None).cast("double"))
        if by_subject:
            named = [df.withColumn("target", F.lit(target)) for df in (train, valid, asked)]
            train, valid, asked = encode_subject(named[0], named[1:])
        fitted = model(target, seed).fit(train)
        if with_importance is not None:
            values = fitted.stages[-1].featureImportances.toArray().tolist()
            gains.extend((target, seed, fold, f, float(g)) for f, g in zip(with_importance, values))
        tags = [F.lit(target).alias("target"), F.lit(seed).alias("seed"), F.lit(fold).alias("fold_id")]
        held = fitted.transform(valid).select(*KEYS, "split", *tags, F.col("y"), positive(valid).alias("p"))
        asked = fitted.transform(asked)
        return held.unionByName(asked.select(*KEYS, "split", *tags, F.col("y"), positive(asked).alias("p")))

    for t, s, f in plan:
        if t in wanted and s in chosen:
            jobs.append(lambda t=t, s=s, f=f: fit(t, s, f))
    parts = in_parallel(jobs, spark)
    importance = None
    if with_importance is not None:
        schema = "target string, seed int, fold_id int, feature string, gain double"
        importance = spark.createDataFrame(gains, schema)
    return reduce(DataFrame.unionByName, parts), importance


def average_runs(predictions: DataFrame) -> DataFrame:
    """Mean over seeds (and over folds for test rows)."""
    return predictions.groupBy(*KEYS, "split", "target").agg(F.max("y").alias("y"), F.avg("p").alias("p"))


# ---- calibration ---------------------------------------------------------------


def fit_platt(rows: DataFrame) -> Model | None:
    """Logistic regression on the logit; None (identity) when only one class is present."""
    labelled = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    sizes = labelled.agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).first()
    if sizes["k"] < 2:
        return None
    regression = LogisticRegression(
        featuresCol="z", labelCol="y", regParam=1.0 / sizes["n"], standardization=False, maxIter=100
    )
    return regression.fit(logit_vector(labelled).withColumn("y", F.col("y").cast("double")))


def logit_vector(rows: DataFrame) -> DataFrame:
    with_logit = rows.withColumn("logit", logit("p"))
    return VectorAssembler(inputCols=["logit"], outputCol="z", handleInvalid="skip").transform(with_logit)


def apply_platt(model: Model | None, rows: DataFrame) -> DataFrame:
    if model is None:
        return rows.withColumn("p", probability("p"))
    out = model.transform(logit_vector(rows))
    return out.withColumn("p", positive(out)).select(*rows.columns)


def isotonic(rows: DataFrame, apply_to: DataFrame, min_rows: int = 10) -> DataFrame:
    """Monotone calibration of one target; too few rows or one class keep the input."""
    labelled = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    sizes = labelled.agg(F.count("*").alias("n"), F.count_distinct("y").alias("k")).first()
    clipped = apply_to.withColumn("p", probability("p"))
    if sizes["n"] < min_rows or sizes["k"] < 2:
        return clipped
    columns = apply_to.columns
    model = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="iso").fit(
        labelled.select(F.col("y").cast("double").alias("label"), probability("p").alias("p"))
    )
    return model.transform(clipped).withColumn("p", probability("iso")).select(*columns)


def isotonic_by_fold(predictions: DataFrame, targets: list[str], folds: list[int]) -> DataFrame:
    """Each fold is calibrated by a model fitted on the other folds."""
    parts = []
    for t in targets:
        mine = predictions.where(F.col("target") == t)
        for f in folds:
            held = F.col("fold_id") == f
            parts.append(isotonic(mine.where(~held), mine.where(held)))
    return reduce(DataFrame.unionByName, parts)


# ---- baseline bundle ---------------------------------------------------------------


def baseline_stages(
    train: DataFrame, apply_to: DataFrame, features: list[str], target: str, scheme: str = "group_time",
    residual: bool = False, min_gain: float = 0.30, m: float = 5.0, **tree_settings,
) -> DataFrame:
    """Raw, calibrated and blended predictions of one target: (keys, target, stage, y, p).

    Fit on the early part of each subject, calibrate and tune the blend with the prior on the
    late part, then refit on everything.
    """
    ids = [*KEYS, "split"]
    labelled = train.where(F.col(target).isNotNull())
    labelled = labelled.withColumn("y", F.col(target).cast("double")).withColumn("target", F.lit(target))
    split = calibration_split(labelled, scheme)
    fit, calib = (split.where(F.col("part") == part).drop("part") for part in ("fit", "calib"))

    def prior_of(reference: DataFrame, rows: DataFrame) -> DataFrame:
        return lookup_prior(rows, subject_priors(reference, m), global_means(reference))

    def learner(reference: DataFrame) -> Callable[[DataFrame], DataFrame]:
        if residual:
            return residual_learner(reference, features, m, **tree_settings)
        fitted = boosted_trees(features, target, **tree_settings).fit(reference)
        return lambda rows: _raw(fitted.transform(rows), rows)

    raw_calib = learner(fit)(calib)
    platt = fit_platt(raw_calib)
    calibrated = apply_platt(platt, raw_calib)
    prior_calib = prior_of(fit, calib.select(*ids, "target", "y"))
    pairs = calibrated.select(*KEYS, "target", "y", F.col("p").alias("a")).join(
        prior_calib.select(*KEYS, "target", F.col("p").alias("b")), [*KEYS, "target"]
    )
    alpha = prior_alpha(pairs, min_gain).first()["alpha"]  # one row
    rows = apply_to.withColumn("target", F.lit(target)).withColumn("y", F.col(target).cast("double"))
    raw = learner(labelled)(rows)
    cal = apply_platt(platt, raw)
    prior = prior_of(labelled, rows.select(*ids, "target", "y")).select(*KEYS, F.col("p").alias("prior_p"))
    blend = cal.join(prior, KEYS).withColumn("p", probability(alpha * F.col("p") + (1.0 - alpha) * F.col("prior_p")))
    pick = lambda df, stage: df.select(*ids, "target", F.lit(stage).alias("stage"), "y", "p")
    return pick(raw, "raw").unionByName(pick(cal, "cal")).unionByName(pick(blend, "blend"))


def _raw(scored: DataFrame, rows: DataFrame) -> DataFrame:
    return scored.withColumn("p", positive(scored)).select(*KEYS, "split", "target", "y", "p")


def residual_learner(
    reference: DataFrame, features: list[str], m: float, limit: float = 0.05, top_k: int = 8, **tree_settings
) -> Callable[[DataFrame], DataFrame]:
    """Trees on the clipped residual against the leave-one-out prior, over few chosen features."""
    loo = leave_one_out_prior(reference, m).withColumnRenamed("p", "subject_prior_feature")
    loo = loo.withColumn("residual", bounded(F.col("y") - F.col("subject_prior_feature"), -limit, limit))
    long = long_features(loo, ["target", "residual"], [*features, "subject_prior_feature"])
    scores = absolute_correlations(long.withColumnRenamed("residual", "y"), ["target", "feature"])
    picked = select_features(scores, top_k, [], "subject_prior_feature")
    chosen = [r["feature"] for r in picked.orderBy("place").select("feature").collect()]  # at most top_k + 1
    settings = {"maxDepth": 2, "maxIter": 10, "stepSize": 0.03} | tree_settings
    trees = GBTRegressor(featuresCol="features", labelCol="residual", seed=42, **settings)
    fitted = Pipeline(stages=[VectorAssembler(inputCols=chosen, outputCol="features"), trees]).fit(loo)
    priors, means = subject_priors(reference, m), global_means(reference)

    def predict(rows: DataFrame) -> DataFrame:
        known = lookup_prior(rows, priors, means).withColumnRenamed("p", "subject_prior_feature")
        scored = fitted.transform(known)
        p = probability(F.col("subject_prior_feature") + F.col("prediction"))
        return scored.withColumn("p", p).select(*KEYS, "split", "target", "y", "p")

    return predict


# ---- diagnostics ---------------------------------------------------------------------


def adversarial_auc(frame: DataFrame, features: list[str], folds: DataFrame, n_folds: int, **settings) -> DataFrame:
    """AUC of telling test rows from training rows, per fold. Half means alike."""
    rows = model_input(frame, features).withColumn("y", (F.col("split") == "test").cast("double"))
    joined = rows.join(folds.select(*KEYS, "fold_id"), KEYS)
    evaluator = BinaryClassificationEvaluator(labelCol="y", rawPredictionCol="rawPrediction")
    out = []
    for f in range(n_folds):
        fitted = boosted_trees(features, "", 42, **settings).fit(joined.where(F.col("fold_id") != f))
        held = fitted.transform(joined.where(F.col("fold_id") == f))
        out.append((f, float(evaluator.evaluate(held))))
    return frame.sparkSession.createDataFrame(out, "fold_id int, auc double")


def rank_auc(predictions: DataFrame, by: list[str]) -> DataFrame:
    """Area under the ROC curve from rank sums, ties counted half.

    Scores are counted per value and ordered inside narrow probability buckets; only bucket
    totals are accumulated per group.
    """
    rows = predictions.where(F.col("y").isNotNull() & F.col("p").isNotNull())
    counted = rows.groupBy(*by, "p").agg(
        F.count(F.when(F.col("y") == 1, 1)).alias("pos"), F.count(F.when(F.col("y") == 0, 1)).alias("neg")
    ).withColumn("__b", F.floor(F.col("p") * 4096))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = counted.groupBy(*by, "__b").agg(F.sum("neg").alias("__neg"))
    totals = totals.select(*by, "__b", F.coalesce(F.sum("__neg").over(before), F.lit(0)).alias("__start"))
    local = Window.partitionBy(*by, "__b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("__below", F.coalesce(F.sum("neg").over(local), F.lit(0))).join(totals, [*by, "__b"])
    wins = F.sum(F.col("pos") * (F.col("__start") + F.col("__below") + F.col("neg") / 2.0))
    return placed.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg").cast("double")).alias("auc"))


def subset_scores(
    frame: DataFrame, folds: DataFrame, subsets: dict[str, list[str]], target: str, seed: int = 42, **settings
) -> DataFrame:
    """Out-of-fold log-loss of one target for several feature subsets."""
    parts = []
    for name, features in subsets.items():
        oof, _ = out_of_fold(frame, folds, [target], [seed], lambda t, s, f=features: boosted_trees(f, t, s, **settings))
        parts.append(average_runs(oof).withColumn("run", F.lit(name)))
    predictions = reduce(DataFrame.unionByName, parts)
    return target_scores(predictions.where(F.col("split") == "train"))


def window_classifier(windows: DataFrame, folds: DataFrame, target: str, days: int, width: int, hidden: int = 16,
                      epochs: int = 20, seed: int = 42) -> DataFrame:
    """Perceptron on flattened day windows, scored out of fold (one head per target)."""
    flat = F.transform(F.flatten("window"), lambda x: x.cast("double"))
    from pyspark.ml.functions import array_to_vector

    rows = windows.where(F.col(target).isNotNull()).select(
        *KEYS, "split", F.col(target).cast("double").alias("y"), array_to_vector(flat).alias("features")
    )
    joined = rows.join(folds.select(*KEYS, "fold_id"), KEYS)
    ids = sorted(r["fold_id"] for r in folds.select("fold_id").distinct().collect())  # k rows
    net = MultilayerPerceptronClassifier(
        layers=[days * width, hidden, 2], labelCol="y", maxIter=epochs, seed=seed, solver="l-bfgs"
    )
    parts = []
    for f in ids:
        fitted = net.fit(joined.where(F.col("fold_id") != f))
        held = fitted.transform(joined.where(F.col("fold_id") == f))
        parts.append(held.select(*KEYS, "split", F.lit(target).alias("target"), "y", positive(held).alias("p")))
    return reduce(DataFrame.unionByName, parts)


def ablation_table(runs: dict[str, DataFrame]) -> DataFrame:
    """Score table of named variants, each an averaged prediction frame."""
    tagged = [df.withColumn("run", F.lit(name)) for name, df in runs.items()]
    scored = reduce(DataFrame.unionByName, tagged).where(F.col("split") == "train")
    return macro_scores(target_scores(scored))
