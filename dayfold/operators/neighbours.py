"""Temporal-neighbour priors and history features of labels.

Labels are first reduced to one row per subject, target and day. Neighbours are then read from a
RANGE frame over the day number, so no row pairs are shuffled: a frame holds at most one entry
per calendar day within the horizon. Keys are unique per subject and day (date rule).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dayfold.functions.scalar import probability, ratio
from dayfold.operators.scoring import global_means
from dayfold.schema import (
    KEYS, NEIGHBOUR_RANKS, NEIGHBOUR_WINDOWS, PROB_HIGH, PROB_LOW, TARGET_KERNELS,
)
from dayfold.session import cut_lineage

Kernel = Callable[[Column], Column]
Setting = tuple[str, int, float]
ALL = "*"


def day_number(day: str = "lifelog_date") -> Column:
    return F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))


def power_kernel(power: float) -> Kernel:
    return lambda distance: 1.0 / F.pow(distance + 1.0, F.lit(float(power)))


def exp_kernel(tau: float) -> Kernel:
    return lambda distance: F.exp(-distance / float(tau))


def kernel(kind: str, value: float) -> Kernel:
    if kind == "power":
        return power_kernel(value)
    if kind == "exp":
        return exp_kernel(value)
    raise ValueError(f"unknown kernel: {kind}")


def neighbour_pairs(samples: DataFrame, reference: DataFrame, days: int, keep_same_day: bool) -> DataFrame:
    """Bounded interval join: reference days of the same subject within ``days`` of each sample day.

    The equi key is (subject, day bin); each reference day goes to its own and the two adjacent
    bins, so a subject is spread over bins instead of one hash partition.
    """
    width = max(days, 1)
    left = samples.select(*KEYS, day_number().alias("day")).withColumn("bin", F.floor(F.col("day") / width))
    right = reference.select("subject_id", day_number().alias("near")).distinct()
    own = F.floor(F.col("near") / width)
    right = right.withColumn("bin", F.explode(F.array(own - 1, own, own + 1)))
    gap = F.col("near") - F.col("day")
    close = (F.abs(gap) <= days) & (F.lit(keep_same_day) | (gap != 0))
    return left.join(right, ["subject_id", "bin"]).where(close).select(*KEYS, "near", gap.alias("gap"))


def _day_rows(samples: DataFrame, reference: DataFrame, by: list[str], apart: list[str] = []) -> DataFrame:
    """Samples and labelled reference days in one frame; reference rows carry ``ref``, with the ``apart`` column if any."""
    labelled = reference.where(F.col("y").isNotNull()).withColumn("__day", day_number())
    per_day = labelled.groupBy(*by, *apart, "subject_id", "target", "__day").agg(
        F.struct(F.col("__day").alias("day"), F.sum("y").cast("double").alias("y"), F.count("y").alias("n"), *apart)
        .alias("ref")
    )
    asked = samples.select(*by, *apart, *KEYS, "target", day_number().alias("__day"), F.lit(True).alias("__asked"))
    return asked.unionByName(per_day, allowMissingColumns=True)


def _by_day(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by, "subject_id", "target").orderBy("__day")


def kernel_average(entries: Column, today: Column, weight: Callable[[Column], Column]) -> Column:
    """Weighted mean of labels over collected (day, y, n) entries; null when there are none."""
    zero = F.struct(F.lit(0.0).alias("wy"), F.lit(0.0).alias("w"))

    def add(acc: Column, e: Column) -> Column:
        w = weight((e["day"] - today).cast("double"))
        return F.struct((acc["wy"] + w * e["y"]).alias("wy"), (acc["w"] + w * e["n"]).alias("w"))

    return F.aggregate(entries, zero, add, lambda acc: F.when(acc["w"] > 1e-12, acc["wy"] / acc["w"]))


def _near_columns(kernels: Mapping[str, Setting], by: list[str]) -> dict[int, Column]:
    """One collected frame per distinct horizon; a row only fills the frame of its own target."""
    horizons: dict[int, list[str]] = {}
    for target, (_, days, _) in kernels.items():
        horizons.setdefault(days, []).append(target)
    return {
        days: F.collect_list(F.when(_is_target(targets), F.col("ref"))).over(_by_day(by).rangeBetween(-days, days))
        for days, targets in horizons.items()
    }


def _is_target(targets: list[str]) -> Column:
    return F.lit(True) if ALL in targets else F.col("target").isin(targets)


def local_average(
    samples: DataFrame, reference: DataFrame, kernels: Mapping[str, Setting], exclude_same_day: bool,
    by: list[str] = [],
) -> DataFrame:
    """Kernel mean of the labels near each sample (``local``) and the subject mean (``subj``).

    ``kernels`` maps a target, or ALL, to (kind, horizon, power or tau). All targets share one
    exchange and one sort.
    """
    rows = _day_rows(samples, reference, by)
    near = _near_columns(kernels, by)
    whole = Window.partitionBy(*by, "subject_id", "target")
    rows = rows.select(
        *by, *KEYS, "target", "__day", "__asked",
        *[c.alias(f"__near{days}") for days, c in near.items()],
        ratio(F.sum("ref.y").over(whole), F.sum("ref.n").over(whole)).alias("subj"),
    ).where("__asked")
    local = F.lit(None).cast("double")
    for target, (kind, days, value) in kernels.items():
        entries, weight = F.col(f"__near{days}"), kernel(kind, value)
        if exclude_same_day:
            entries = F.filter(entries, lambda e: e["day"] != F.col("__day"))
        mean = kernel_average(entries, F.col("__day"), lambda gap, w=weight: w(F.abs(gap)))
        local = mean if target == ALL else F.when(F.col("target") == target, mean).otherwise(local)
    return rows.select(*by, *KEYS, "target", local.alias("local"), "subj")


def temporal_prior(
    samples: DataFrame, labels: DataFrame, kernels: Mapping[str, Setting], exclude_same_day: bool,
    subject_weight: float = 0.05, global_weight: float = 0.05,
) -> DataFrame:
    """Mix of the kernel mean, the subject mean (its stand-in when empty) and the global mean.

    The training variant drops all labels of the sample's own day; the variant for unlabelled
    rows keeps them.
    """
    local = local_average(samples, labels, kernels, exclude_same_day)
    joined = local.join(F.broadcast(global_means(labels)), "target")  # one row per target
    subject = F.coalesce("subj", "global_mean")
    main = 1.0 - subject_weight - global_weight
    p = (
        main * F.coalesce(F.col("local"), subject) + subject_weight * subject + global_weight * F.col("global_mean")
    )
    return joined.select(*KEYS, "target", probability(p, PROB_LOW, PROB_HIGH).alias("p"))


def targetwise_temporal_prior(
    samples: DataFrame, labels: DataFrame, exclude_same_day: bool, kernels: Mapping[str, Setting] = TARGET_KERNELS
) -> DataFrame:
    """Each target with its own kernel and horizon, in one pass."""
    mine = F.col("target").isin(list(kernels))
    return temporal_prior(samples.where(mine), labels.where(mine), kernels, exclude_same_day)


def power_prior(
    samples: DataFrame, reference: DataFrame, days: int, power: float, subject_weight: float,
    future_scale: float = 1.0, global_weight: float = 0.05, by: list[str] = [], apart: str | None = None,
) -> DataFrame:
    """Power-kernel prior with a two-tier horizon; the sample's own label never counts.

    Without a label inside the window all labels of the subject count: those samples meet the
    subject's array of labelled days (one entry per calendar day), not row pairs. ``by`` columns
    separate independent references. Reference rows whose ``apart`` column (a fold) equals the
    sample's do not count: sums are totals less those of the own fold, so no row is copied per fold.
    """
    part, extra = [*by, "subject_id", "target"], [apart] if apart else []
    whole, mine = Window.partitionBy(*part), Window.partitionBy(*part, *extra)
    rows = _day_rows(samples, reference, by, extra).select(
        *by, *extra, *KEYS, "target", "__day", "__asked",
        F.collect_list("ref").over(_by_day(by).rangeBetween(-days, days)).alias("__near"),
        F.sum("ref.y").over(whole).alias("__y"), F.sum("ref.n").over(whole).alias("__n"),
        F.sum("ref.y").over(mine).alias("__own_y"), F.sum("ref.n").over(mine).alias("__own_n"),
    ).where("__asked")

    def other_days(entries: Column) -> Column:
        elsewhere = lambda e: e[apart] != F.col(apart) if apart else F.lit(True)
        return F.filter(entries, lambda e: (e["day"] != F.col("__day")) & elsewhere(e))

    today = F.try_element_at(F.filter("__near", lambda e: e["day"] == F.col("__day")), F.lit(1))
    own = {c: F.col(f"__own_{c}") if apart else today[c] for c in ("y", "n")}
    rows = rows.select(
        *by, *extra, *KEYS, "target", "__day", other_days(F.col("__near")).alias("__near"),
        (F.coalesce("__y", F.lit(0.0)) - F.coalesce(own["y"], F.lit(0.0))).alias("__y"),
        (F.coalesce("__n", F.lit(0)) - F.coalesce(own["n"], F.lit(0))).alias("__n"),
    )

    def weight(gap: Column) -> Column:
        scale = F.when(gap > 0, F.lit(float(future_scale))).otherwise(1.0)
        return scale / F.pow(F.abs(gap) + 1.0, F.lit(float(power)))

    labelled = reference.where(F.col("y").isNotNull())
    sums = labelled.groupBy(*by, *extra, "target").agg(F.sum("y").alias("sy"), F.count("y").alias("sn"))
    if apart:  # the mean of all other folds
        total = Window.partitionBy(*by, "target")
        sums = sums.select(*by, apart, "target", *[(F.sum(c).over(total) - F.col(c)).alias(c) for c in ("sy", "sn")])
    means = sums.select(*by, *extra, "target", ratio("sy", "sn").alias("global_mean"))
    all_days = (
        labelled.groupBy(*part, *extra, day_number().alias("day"))
        .agg(F.sum("y").cast("double").alias("y"), F.count("y").alias("n"))
        .groupBy(*part).agg(F.collect_list(F.struct("day", "y", "n", *extra)).alias("__all"))
    )
    close = rows.where(F.size("__near") > 0).select(
        *by, *extra, *KEYS, "target", "__y", "__n", kernel_average(F.col("__near"), F.col("__day"), weight).alias("local")
    )
    far = rows.where(F.size("__near") == 0).drop("__near").join(all_days, part, "left").select(
        *by, *extra, *KEYS, "target", "__y", "__n",
        kernel_average(other_days(F.col("__all")), F.col("__day"), weight).alias("local"),
    )
    full = close.unionByName(far).join(means, [*by, *extra, "target"])
    temporal_weight = max(0.0, 1.0 - subject_weight - global_weight)
    mean = F.col("global_mean")
    mixed = (
        temporal_weight * F.coalesce("local", "global_mean") + subject_weight * ratio("__y", "__n")
        + global_weight * mean
    )
    p = F.when(F.col("__n") > 0, mixed).otherwise(mean)
    return full.select(*by, *extra, *KEYS, "target", probability(p, PROB_LOW, PROB_HIGH).alias("p"))


def fold_safe_prior(
    labels: DataFrame, folds: DataFrame, days: int, power: float, subject_weight: float,
    future_scale: float = 1.0, global_weight: float = 0.05,
) -> DataFrame:
    """Out-of-fold power prior, averaged over seeds.

    ``folds`` assigns every labelled key to one fold per target and seed, whatever the number of folds.
    Reference rows are those of the other folds.
    """
    on = [*KEYS, "target"]
    assigned = cut_lineage(labels.join(folds.select(*on, "seed", F.col("fold_id").alias("fold")), on))  # the prior reads it four times
    predicted = power_prior(
        assigned.select(*on, "seed", "fold"), assigned, days, power, subject_weight,
        future_scale, global_weight, by=["seed"], apart="fold",
    )
    return predicted.groupBy(*on).agg(F.avg("p").alias("p"))


def nearest_label_days(samples: DataFrame, reference: DataFrame, exclude_own_day: bool) -> DataFrame:
    """Smallest distance in days to a reference day of the subject; null when there is none.

    Only the closest labelled day before and after each sample is looked at.
    """
    days = reference.select("subject_id", day_number().alias("__day")).distinct().withColumn("__ref", F.col("__day"))
    asked = samples.select(*KEYS, day_number().alias("__day"), F.lit(True).alias("__asked"))
    rows = asked.unionByName(days, allowMissingColumns=True)
    w = Window.partitionBy("subject_id").orderBy("__day")
    edge = 1 if exclude_own_day else 0
    before = F.max("__ref").over(w.rangeBetween(Window.unboundedPreceding, -edge))
    after = F.min("__ref").over(w.rangeBetween(edge, Window.unboundedFollowing))
    rows = rows.withColumn("__before", before).withColumn("__after", after).where("__asked")
    nearest = F.least(F.col("__day") - F.col("__before"), F.col("__after") - F.col("__day"))
    return rows.select(*KEYS, nearest.alias("nearest_days"))


def history_columns(target: str) -> list[str]:
    """The thirty history feature names of one target."""
    th = f"th_{target}_"
    names = ["prior_mean", "prior_count"]
    for r in NEIGHBOUR_RANKS:
        names += [f"prev{r}_value", f"prev{r}_days", f"next{r}_value", f"next{r}_days"]
    for d in NEIGHBOUR_WINDOWS:
        names += [f"past{d}_mean", f"past{d}_count", f"future{d}_mean", f"future{d}_count"]
    names += ["nearest_value", "nearest_days", "nearest_is_future", "prev_next_same"]
    return [th + n for n in names]


def target_history(samples: DataFrame, reference: DataFrame, by: list[str] = []) -> DataFrame:
    """Thirty neighbour features per key and target, long form.

    The three nearest labels on each side come from lag / lead that skip nulls, calendar-window
    means from RANGE frames. A subject absent from the reference gets nulls only.
    """
    part = [*by, "subject_id", "target"]
    ref = reference.where(F.col("y").isNotNull()).select(*part, day_number().alias("__day"), F.col("y").cast("double"))
    asked = samples.select(*by, *KEYS, "target", day_number().alias("__day"), F.lit(True).alias("__asked"))
    rows = asked.join(ref, [*part, "__day"], "full").withColumn(
        "__ref", F.when(F.col("y").isNotNull(), F.struct(F.col("__day").alias("day"), F.col("y").alias("y")))
    )
    listed = ", ".join(part)
    spec = f"(PARTITION BY {listed} ORDER BY __day)"
    w = Window.partitionBy(*part)
    ordered = w.orderBy("__day")
    out: dict[str, Column] = {
        "prior_mean": F.avg("y").over(w),
        "prior_count": F.count("y").over(w),
    }
    for r in NEIGHBOUR_RANKS:
        out[f"__prev{r}"] = F.expr(f"lag(__ref, {r}) IGNORE NULLS OVER {spec}")
        out[f"__next{r}"] = F.expr(f"lead(__ref, {r}) IGNORE NULLS OVER {spec}")
    for d in NEIGHBOUR_WINDOWS:
        past, future = ordered.rangeBetween(-d, -1), ordered.rangeBetween(1, d)
        out[f"past{d}_mean"], out[f"past{d}_count"] = F.avg("y").over(past), F.count("y").over(past)
        out[f"future{d}_mean"], out[f"future{d}_count"] = F.avg("y").over(future), F.count("y").over(future)
    rows = rows.select(*by, *KEYS, "target", "__day", "__asked", *[c.alias(n) for n, c in out.items()])
    rows = rows.where("__asked")
    today = F.col("__day")
    back, ahead = F.col("__prev1"), F.col("__next1")
    back_gap, ahead_gap = today - back["day"], ahead["day"] - today
    use_back = ahead.isNull() | (back.isNotNull() & (back_gap <= ahead_gap))
    known = F.col("prior_count") > 0
    counted = lambda name: F.when(known, F.col(name).cast("double"))
    final: dict[str, Column] = {"prior_mean": F.col("prior_mean"), "prior_count": counted("prior_count")}
    for r in NEIGHBOUR_RANKS:
        for side, gap in (("prev", today - F.col(f"__prev{r}")["day"]), ("next", F.col(f"__next{r}")["day"] - today)):
            final[f"{side}{r}_value"] = F.col(f"__{side}{r}")["y"]
            final[f"{side}{r}_days"] = gap.cast("double")
    for d in NEIGHBOUR_WINDOWS:
        for side in ("past", "future"):
            final[f"{side}{d}_mean"] = F.col(f"{side}{d}_mean")
            final[f"{side}{d}_count"] = counted(f"{side}{d}_count")
    some = back.isNotNull() | ahead.isNotNull()
    final["nearest_value"] = F.when(use_back, back["y"]).otherwise(ahead["y"])
    final["nearest_days"] = F.when(use_back, back_gap).otherwise(ahead_gap).cast("double")
    final["nearest_is_future"] = F.when(some, (~use_back).cast("double"))
    final["prev_next_same"] = F.when(
        back.isNotNull() & ahead.isNotNull(), (back["y"] == ahead["y"]).cast("double")
    )
    return rows.select(*by, *KEYS, "target", *[c.alias(n) for n, c in final.items()])


def wide_target_history(long: DataFrame, targets: list[str], by: list[str] = []) -> DataFrame:
    """History features of all targets side by side, one row per key."""
    names = [c for c in long.columns if c not in {*by, *KEYS, "target"}]
    wide = long.groupBy(*by, *KEYS).agg(*[
        F.max(F.when(F.col("target") == t, F.col(n))).alias(f"th_{t}_{n}") for t in targets for n in names
    ])
    return wide
