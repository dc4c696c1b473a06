"""Leakage-aware splits as fold tables: keys, split_scheme, fold_id, role.

Folds are joined, never looped over. Windows over a subject are bounded by its calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.operators.ranking import key_digest, rank_in_group
from dayfold.schema import KEYS

MANIFEST = [*KEYS, "split_scheme", "fold_id", "role"]


def with_position(df: DataFrame) -> DataFrame:
    """Zero-based day position inside the subject and the subject's row count."""
    subject = Window.partitionBy("subject_id")
    return df.select(
        "*",
        (F.row_number().over(subject.orderBy("lifelog_date")) - 1).alias("position"),
        F.count("*").over(subject).alias("group_size"),
    )


def _manifest(df: DataFrame, scheme: str, fold: Column, role: Column | str = "valid") -> DataFrame:
    role = F.lit(role) if isinstance(role, str) else role
    return df.select(
        *KEYS, F.lit(scheme).alias("split_scheme"), fold.cast("int").alias("fold_id"), role.alias("role")
    )


def group_folds(train: DataFrame, n_splits: int = 5) -> DataFrame:
    """Whole-subject folds: subjects are dealt back and forth over the folds by falling size.

    The global subject rank is built from ranks inside each (size, digest slice), so no task
    orders all subjects. Subjects are validated exactly once and fold sizes stay balanced.
    With fewer subjects than folds the upper fold numbers stay empty.
    """
    subjects = train.groupBy("subject_id").agg(F.count("*").alias("size"))
    subjects = subjects.withColumn("digest", key_digest("subject_id"))
    ranked = rank_in_group(subjects, ["size"], "digest", "in_size", digits=2)
    per_size = subjects.groupBy("size").agg(F.count("*").alias("n"))
    # one entry per distinct subject size, at most one per calendar day
    sizes = per_size.agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("s"))
    larger = lambda i: F.aggregate(F.slice("s", 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x["n"])
    starts = sizes.select(F.inline(F.transform("s", lambda x, i: F.struct(x["size"].alias("size"), larger(i).alias("start")))))
    step = (F.col("start") + F.col("in_size")) % (2 * n_splits)
    dealt = ranked.join(starts, "size").select(
        "subject_id", F.when(step < n_splits, step).otherwise(2 * n_splits - 1 - step).alias("fold")
    )
    return _manifest(train.join(dealt, "subject_id"), "group", F.col("fold"))


def rolling_origin_folds(train: DataFrame) -> DataFrame:
    """Subject positions [40, 60), [60, 80) and [80, 100] per cent validate folds 0, 1, 2."""
    placed = with_position(train)
    cut = lambda share: F.floor(F.col("group_size") * F.lit(share))
    position = F.col("position")
    fold = F.when(position >= cut(0.8), 2).when(position >= cut(0.6), 1).when(position >= cut(0.4), 0)
    return _manifest(placed.withColumn("f", fold).where("f is not null"), "group_time", F.col("f"))


def fold_manifest(train: DataFrame, n_splits: int = 5) -> DataFrame:
    return group_folds(train, n_splits).unionByName(rolling_origin_folds(train))


def forward_folds(train: DataFrame, n_folds: int = 3, valid_fraction: float = 0.2) -> DataFrame:
    """Forward chaining with train and valid roles.

    Subjects with fewer than four rows only ever train. An empty validation slice falls back to
    the last row, which then leaves the training side.
    """
    placed = with_position(train)
    size, position = F.col("group_size"), F.col("position")
    cuts = [F.floor(size * F.lit(1.0 - valid_fraction * (n_folds - f))) for f in range(n_folds)] + [size]
    folds = F.array(*[
        F.struct(F.lit(f).alias("f"), cuts[f].alias("lo"), cuts[f + 1].alias("hi")) for f in range(n_folds)
    ])
    spread = placed.select("*", F.explode(folds).alias("c"))
    lo, hi = F.col("c.lo"), F.col("c.hi")
    start = F.when(lo < hi, lo).otherwise(F.greatest(size - 1, F.lit(0)))
    end = F.when(lo < hi, hi).otherwise(size)
    role = (
        F.when(size < 4, "train").when(position < start, "train")
        .when((position >= start) & (position < end), "valid")
    )
    return _manifest(spread.withColumn("r", role).where("r is not null"), "forward", F.col("c.f"), F.col("r"))


def leave_one_subject_out(train: DataFrame) -> DataFrame:
    """Validation rows only, one fold per subject; the training side of a fold is the anti join.

    Writing out both sides would square the table.
    """
    return train.select(
        *KEYS, F.lit("loso").alias("split_scheme"), F.col("subject_id").alias("fold_id"), F.lit("valid").alias("role")
    )


def within_subject_folds(train: DataFrame, n_folds: int = 5, seed: int = 42) -> DataFrame:
    """Each subject's rows in digest order, dealt to folds in near-equal chunks.

    The first ``n mod k`` folds get one extra row. Every subject is on both sides.
    """
    subject = Window.partitionBy("subject_id")
    dealt = train.withColumn("digest", key_digest(*KEYS, seed=seed)).select(
        *KEYS,
        (F.row_number().over(subject.orderBy("digest")) - 1).alias("i"),
        F.count("*").over(subject).alias("n"),
    )
    base, extra = F.floor(F.col("n") / n_folds), F.col("n") % n_folds
    long_part = extra * (base + 1)
    fold = F.when(F.col("i") < long_part, F.floor(F.try_divide(F.col("i"), base + 1))).otherwise(
        extra + F.floor(F.try_divide(F.col("i") - long_part, base))
    )
    return _manifest(dealt, "subject_holdout", fold)


def stratified_folds(labels: DataFrame, n_folds: int = 5, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """Label-stratified folds per target and seed on long labels (keys, target, y).

    A label class can hold most rows, so positions come from sliced ranks.
    """
    seeded = labels.where(F.col("y").isNotNull()).select(
        *KEYS, "target", "y", F.explode(F.array(*[F.lit(s) for s in seeds])).alias("seed")
    )
    seeded = seeded.withColumn("digest", key_digest("seed", "target", *KEYS))
    ranked = rank_in_group(seeded, ["target", "seed", "y"], "digest", "i")
    return ranked.select(
        *KEYS, "target", "seed", F.lit("public_stratified").alias("split_scheme"),
        (F.col("i") % n_folds).cast("int").alias("fold_id"), F.lit("valid").alias("role"),
    )


def calibration_split(train: DataFrame, scheme: str = "group_time", share: float = 0.8) -> DataFrame:
    """Adds ``part``: 'fit' or 'calib'.

    Time schemes hold out the last fifth of each subject; the group scheme holds out whole
    subjects by a digest threshold.
    """
    if scheme == "group":
        bucket = F.conv(F.substring(key_digest("subject_id", seed="calib"), 1, 4), 16, 10).cast("int")
        return train.withColumn("part", F.when(bucket < int(65536 * share), "fit").otherwise("calib"))
    placed = with_position(train)
    cutoff = F.greatest(F.floor(F.col("group_size") * F.lit(share)), F.lit(1))
    part = F.when(F.col("position") < cutoff, "fit").otherwise("calib")
    return placed.withColumn("part", part).drop("position", "group_size")


def folds_for_scheme(labels: DataFrame, scheme: str, n_folds: int = 5, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """Validation folds (keys, target, seed, fold_id) of one scheme for stability scoring."""
    if scheme == "public_stratified":
        return stratified_folds(labels, n_folds, seeds).select(*KEYS, "target", "seed", "fold_id")
    pairs = labels.where(F.col("y").isNotNull()).select(*KEYS, "target")
    keys = labels.select(*KEYS).distinct()
    if scheme == "subject_holdout":
        parts = [within_subject_folds(keys, n_folds, s).withColumn("seed", F.lit(s)) for s in seeds]
        manifest = parts[0]
        for part in parts[1:]:
            manifest = manifest.unionByName(part)
    elif scheme == "group_time":
        manifest = forward_folds(keys, n_folds, 1.0 / n_folds).where(F.col("role") == "valid")
        manifest = manifest.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    else:
        raise ValueError(f"unknown validation scheme: {scheme}")
    return pairs.join(manifest.select(*KEYS, "seed", "fold_id"), KEYS)


def valid_rows(train: DataFrame, manifest: DataFrame, fold_id: int) -> DataFrame:
    """Membership of one fold: semi join on the keys."""
    chosen = manifest.where((F.col("fold_id") == fold_id) & (F.col("role") == "valid"))
    return train.join(chosen.select(*KEYS), KEYS, "left_semi")


def outer_train_rows(train: DataFrame, manifest: DataFrame, scheme: str) -> DataFrame:
    """Training rows of every fold, with ``fold_id``.

    Time scheme: subjects of the fold, strictly before their first validation sleep date.
    Other schemes: all rows that the fold does not validate (each key validates once).
    """
    valid = manifest.where(F.col("role") == "valid")
    if scheme == "group_time":
        starts = valid.groupBy("subject_id", "fold_id").agg(F.min("sleep_date").alias("__start"))
        return train.join(starts, "subject_id").where(F.col("sleep_date") < F.col("__start")).drop("__start")
    folds = sorted(r["fold_id"] for r in valid.select("fold_id").distinct().collect())  # k rows
    own = train.join(valid.select(*KEYS, F.col("fold_id").alias("__own")), KEYS, "left")
    spread = own.withColumn("fold_id", F.explode(F.array(*[F.lit(f) for f in folds])))
    return spread.where(~F.col("fold_id").eqNullSafe(F.col("__own"))).drop("__own")


def fold_report(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("split_scheme", "fold_id").agg(F.count("*").alias("rows"))
