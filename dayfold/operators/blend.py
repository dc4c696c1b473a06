"""Blends, extrapolations, calibration and their searches on aligned long predictions.

Candidate settings are literal arrays of fixed size that each row explodes (no join), followed
by one aggregation that combines on the map side to (target, setting) sums.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import log_loss_term, logit, probability, ratio, sigmoid, temper
from dayfold.operators.scoring import log_loss
from dayfold.operators.selection import first_per
from dayfold.schema import KEYS, PROB_HIGH, PROB_LOW

ROW = [*KEYS, "target"]


def by_target(values: Mapping[str, float], default: float | None = 0.0) -> Column:
    """Value of the row's target from a mapping of at most one entry per target."""
    column = F.lit(default).cast("double")
    for target, value in values.items():
        column = F.when(F.col("target") == target, F.lit(value).cast("double")).otherwise(column)
    return column


def mix(left: Column | str, right: Column | str, weight: Column | float) -> Column:
    left, right = (F.col(c) if isinstance(c, str) else c for c in (left, right))
    return (1.0 - weight) * left + weight * right


def business(p: Column) -> Column:
    return probability(p, PROB_LOW, PROB_HIGH)


# ---- plain blends -----------------------------------------------------------


def mix_runs(pairs: DataFrame, weights: Mapping[str, float], clip: bool = False) -> DataFrame:
    """(1 - w) a + w b with one weight per target; targets without a weight keep a.

    Weights above one extrapolate.
    """
    p = mix("a", "b", by_target(weights))
    return pairs.withColumn("p", business(p) if clip else p)


def swap_targets(pairs: DataFrame, targets: list[str], weight: float | None = None) -> DataFrame:
    """Take b (or a blend towards b) on the chosen targets and a elsewhere."""
    moved = F.col("b") if weight is None else mix("a", "b", F.lit(weight))
    return pairs.withColumn("p", F.when(F.col("target").isin(targets), moved).otherwise(F.col("a")))


def weighted_runs(predictions: DataFrame, weights: DataFrame, clip: bool = True) -> DataFrame:
    """Sum of w * p over the runs named per target; ``weights`` is (target, run, weight)."""
    joined = predictions.join(F.broadcast(weights), ["target", "run"])  # targets x runs rows
    p = F.sum(F.col("weight") * F.col("p"))
    return joined.groupBy(*ROW).agg(F.max("y").alias("y"), (business(p) if clip else p).alias("p"))


def weight_rows(df: DataFrame, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(target, run, weight) rows from a nested mapping."""
    rows = [(t, r, float(w)) for t, runs in weights.items() for r, w in runs.items()]
    return df.sparkSession.createDataFrame(rows, "target string, run string, weight double")


def softblend_weights(q2: float, q3: float, s4: float, core: str, hist_a: str, hist_b: str) -> dict:
    """Core run everywhere; Q2 and S4 lean to one history run, Q3 to the other."""
    weights = {t: {core: 1.0} for t in ("Q1", "S1", "S2", "S3")}
    for target, run, w in (("Q2", hist_a, q2), ("Q3", hist_b, q3), ("S4", hist_a, s4)):
        weights[target] = {core: 1.0 - w, run: w}
    return weights


def available_weights(weights: DataFrame, runs: list[str]) -> DataFrame:
    """Weights renormalised over the runs that exist; equal shares when they sum to zero."""
    kept = weights.where(F.col("run").isin(runs))
    target = Window.partitionBy("target")
    total, n = F.sum("weight").over(target), F.count("*").over(target)
    share = F.when(total > 0, ratio("weight", total)).otherwise(1.0 / n)
    return kept.select("target", "run", share.alias("weight"))


def weight_report(weights: DataFrame, runs: list[str]) -> DataFrame:
    """One row per target, one weight column per run."""
    return weights.groupBy("target").pivot("run", runs).agg(F.first("weight"))


def assemble_by_view(predictions: DataFrame, views: Mapping[str, str], run_of_view: Mapping[str, str]) -> DataFrame:
    """Each target's predictions from the run of its mapped view."""
    wanted = None
    for target, view in views.items():
        hit = (F.col("target") == target) & (F.col("run") == run_of_view[view])
        wanted = hit if wanted is None else wanted | hit
    return predictions.where(wanted)


# ---- extrapolation ----------------------------------------------------------


def beta_step(pairs: DataFrame, beta: float, targets: list[str], mode: str = "symmetric") -> DataFrame:
    """a + beta (b - a) on the chosen targets; 'up' and 'down' keep one sign of the step."""
    delta = F.col("b") - F.col("a")
    if mode == "up":
        delta = F.greatest(delta, F.lit(0.0))
    elif mode == "down":
        delta = F.least(delta, F.lit(0.0))
    elif mode != "symmetric":
        raise ValueError(f"unknown mode: {mode}")
    moved = business(F.col("a") + beta * delta)
    return pairs.withColumn("p", F.when(F.col("target").isin(targets), moved).otherwise(F.col("a")))


def anti_blend(pairs: DataFrame, scale: float, frozen: list[str]) -> DataFrame:
    """Step away from b: a - scale (b - a), frozen targets excepted."""
    moved = F.col("a") - scale * (F.col("b") - F.col("a"))
    return pairs.withColumn("p", F.when(F.col("target").isin(frozen), F.col("a")).otherwise(moved))


def gated_beta(
    pairs: DataFrame, nearest: DataFrame, targets: list[str], base: float, near: float, near_days: int
) -> DataFrame:
    """The near step where the closest label is within ``near_days``, the base step elsewhere."""
    joined = pairs.join(nearest, KEYS, "left")
    close = F.coalesce(F.col("nearest_days") <= near_days, F.lit(False))
    beta = F.when(close, F.lit(near)).otherwise(F.lit(base))
    moved = business(F.col("a") + beta * (F.col("b") - F.col("a")))
    return joined.withColumn("p", F.when(F.col("target").isin(targets), moved).otherwise(F.col("a")))


def push(pairs: DataFrame, alphas: Mapping[str, float]) -> DataFrame:
    """a + alpha (b - a) with one alpha per target, clipped; targets without one keep a."""
    alpha = by_target(alphas, None)
    moved = business(F.col("a") + alpha * (F.col("b") - F.col("a")))
    return pairs.withColumn("p", F.when(alpha.isNull(), F.col("a")).otherwise(moved))


# ---- grid searches ----------------------------------------------------------


def setting(name: str) -> Column:
    """A parameter of the current grid setting, inside an expression over ``exploded`` rows."""
    return F.col(f"g_{name}")


def _looked_up(grid: list[dict[str, float]]) -> list[Column]:
    """The parameters of setting number ``config``, read from constant arrays."""
    def values(name: str) -> Column:
        text = ",".join(repr(float(s[name])) for s in grid)
        return F.split(F.lit(text), ",").cast("array<double>")  # folded to a constant by the optimizer

    return [F.element_at(values(k), F.col("config") + 1).alias(f"g_{k}") for k in grid[0]]


def exploded(df: DataFrame, grid: list[dict[str, float]]) -> DataFrame:
    """Every row once per setting of a fixed grid; ``config`` numbers the settings."""
    numbered = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(len(grid) - 1))).alias("config"))
    return numbered.select("*", *_looked_up(grid))


def even_grid(low: float, high: float, points: int) -> list[float]:
    step = (high - low) / (points - 1)
    return [low + i * step if i < points - 1 else high for i in range(points)]


def compacted(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Equal (target, y, predictions) rows as one with a count, spread evenly for a heavy step.

    Predictions repeat (priors, trees), so this often shrinks the table a lot; the explicit
    partition number keeps the adaptive planner from packing the now small table into few tasks
    before each row meets a thousand settings.
    """
    keys = ["target", "y", *columns]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = rows.where(F.col("y").isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.repartition(parts, *keys)


def grid_scores(rows: DataFrame, p: Column, grid: list[dict[str, float]], columns: list[str]) -> DataFrame:
    """Mean loss of ``p`` per target and setting.

    ``p`` is an expression over the named columns and ``setting`` parameters.
    """
    spread = exploded(compacted(rows, columns), grid)
    sums = spread.select("target", "config", "n", log_loss_term("y", p).alias("loss"))
    known = F.when(F.col("loss").isNotNull(), F.col("n"))
    scored = sums.groupBy("target", "config").agg(
        F.try_divide(F.sum(F.col("loss") * F.col("n")), F.sum(known)).alias("score")
    )
    named = scored.select("target", "config", "score", *_looked_up(grid))
    return named.withColumnsRenamed({f"g_{k}": k for k in grid[0]})


def weight_scores(pairs: DataFrame, weights: list[float], clip: bool = False) -> DataFrame:
    """Loss of (1 - w) a + w b for each weight of the grid."""
    p = mix("a", "b", setting("weight"))
    return grid_scores(pairs, business(p) if clip else p, [{"weight": w} for w in weights], ["a", "b"])


def base_scores(pairs: DataFrame, names: tuple[str, ...] = ("a", "b")) -> DataFrame:
    """Loss of each unblended side per target."""
    return pairs.groupBy("target").agg(*[log_loss("y", n).alias(f"score_{n}") for n in names])


def better_than_base(grid: DataFrame, base: DataFrame, side: str, fallback_weight: float) -> DataFrame:
    """Best setting per target when it beats the unblended side, else the fallback weight."""
    best = first_per(grid, ["target"], [F.asc("score"), F.asc("config")]).drop("rank")
    joined = best.join(base, "target")
    wins = F.col("score") < F.col(f"score_{side}")
    return joined.select(
        "target", F.when(wins, F.col("weight")).otherwise(F.lit(fallback_weight)).alias("weight"),
        F.when(wins, F.col("score")).otherwise(F.col(f"score_{side}")).alias("score"),
        F.col(f"score_{side}").alias("base_score"),
    )


def two_run_search(pairs: DataFrame, points: int = 201) -> DataFrame:
    """Best share of run a over an even grid on [0, 1]; a alone unless something beats it."""
    swapped = pairs.select(*ROW, "y", F.col("b").alias("a"), F.col("a").alias("b"))
    scores = weight_scores(swapped, even_grid(0.0, 1.0, points))
    return better_than_base(scores, base_scores(swapped), "b", 1.0)


def capped_search(pairs: DataFrame, max_weight: float, points: int = 46, top: float = 0.9) -> DataFrame:
    """Best weight of b up to a cap; zero unless it beats a."""
    weights = [w for w in even_grid(0.0, top, points) if w <= max_weight]
    return better_than_base(weight_scores(pairs, weights, clip=True), base_scores(pairs), "a", 0.0)


def prior_alpha(pairs: DataFrame, min_gain: float, points: int = 21) -> DataFrame:
    """Share of the model (a) against the prior (b); zero unless the gain reaches ``min_gain``."""
    swapped = pairs.select(*ROW, "y", F.col("b").alias("a"), F.col("a").alias("b"))
    scores = weight_scores(swapped, even_grid(0.0, 1.0, points))
    best = first_per(scores, ["target"], [F.asc("score"), F.asc("config")]).drop("rank")
    joined = best.join(base_scores(swapped), "target")
    short = F.col("score") > F.col("score_a") - min_gain
    return joined.select(
        "target", F.when(short, 0.0).otherwise(F.col("weight")).alias("alpha"),
        F.when(short, F.col("score_a")).otherwise(F.col("score")).alias("score"),
        F.col("score_a").alias("prior_score"),
    )


def small_grid_choice(pairs: DataFrame, weights: list[float], frozen: list[str], min_gain: float = 2.5e-5) -> DataFrame:
    """Best small weight of b; zero for frozen targets or when the gain is too small."""
    best = better_than_base(weight_scores(pairs, weights, clip=True), base_scores(pairs), "a", 0.0)
    gain = F.col("base_score") - F.col("score")
    keep = (gain >= min_gain) & ~F.col("target").isin(frozen)
    return best.select(
        "target", F.when(keep, F.col("weight")).otherwise(0.0).alias("weight"),
        F.when(keep, F.col("score")).otherwise(F.col("base_score")).alias("score"),
        F.when(keep, gain).otherwise(0.0).alias("gain"),
    )


def drift_capped_search(
    train_pairs: DataFrame, test_pairs: DataFrame, frozen: list[str], max_drift: float = 0.005, points: int = 1001
) -> DataFrame:
    """Best weight of b whose mean move of the test predictions stays within ``max_drift``.

    The full drift per target (a handful of rows) caps the grid before the choice.
    """
    full = test_pairs.groupBy("target").agg(F.avg(F.abs(F.col("b") - F.col("a"))).alias("full_drift"))
    base = base_scores(train_pairs, ("a",))
    scores = weight_scores(train_pairs, even_grid(0.0, 1.0, points)).join(full, "target").join(base, "target")
    cap = F.least(F.lit(1.0), F.try_divide(F.lit(max_drift), F.col("full_drift")))
    delta = F.col("score") - F.col("score_a")
    allowed = (F.col("weight") <= cap + 1e-12) & (delta < -1e-12) & ~F.col("target").isin(frozen)
    best = first_per(scores.where(allowed), ["target"], [F.asc("score"), F.asc("config")])
    best = best.select("target", F.col("weight").alias("w"), F.col("score").alias("s"))
    rows = full.join(base, "target").join(best, "target", "left")
    reason = (
        F.when(F.col("target").isin(frozen), "frozen").when(F.col("full_drift") == 0, "no test effect")
        .when(F.col("w").isNull(), "no improving drift-safe weight").otherwise("selected")
    )
    return rows.select(
        "target", F.coalesce("w", F.lit(0.0)).alias("weight"), F.coalesce("s", "score_a").alias("score"),
        F.coalesce(F.col("s") - F.col("score_a"), F.lit(0.0)).alias("delta"),
        (F.coalesce("w", F.lit(0.0)) * F.col("full_drift")).alias("test_drift"), reason.alias("reason"),
    )


# ---- more than two runs -----------------------------------------------------


def simplex_grid(k: int, steps: int = 20) -> list[tuple[float, ...]]:
    """All weight vectors of k runs with multiples of 1 / steps."""
    if k < 1:
        raise ValueError("a blend needs a run")
    heads: list[tuple[int, ...]] = [()]
    for _ in range(k - 1):
        heads = [(*h, i) for h in heads for i in range(steps - sum(h) + 1)]
    return [(*(i / steps for i in h), (steps - sum(h)) / steps) for h in heads]


def random_simplex(k: int, draws: int, seed: int) -> list[tuple[float, ...]]:
    """Uniform draws from the simplex by normalised exponentials, reproducible per seed."""
    import random

    rng = random.Random(seed)
    out = []
    for _ in range(draws):
        parts = [rng.expovariate(1.0) for _ in range(k)]
        out.append(tuple(x / sum(parts) for x in parts))
    return out


def neighbours_on_simplex(center: tuple[float, ...], step: float) -> list[tuple[float, ...]]:
    """Moves of ``step`` from one weight to another around a centre."""
    out = []
    for i in range(len(center)):
        for j in range(len(center)):
            if i != j and center[i] >= step:
                moved = list(center)
                moved[i] -= step
                moved[j] += step
                out.append(tuple(moved))
    return out


def weight_search(wide: DataFrame, runs: list[str], candidates: list[tuple[float, ...]]) -> DataFrame:
    """Best weight vector per target; equal weights unless a candidate beats them.

    ``wide`` has one column per run next to target and y.
    """
    equal = tuple(1.0 / len(runs) for _ in runs)
    grid = [{f"w{i}": w for i, w in enumerate(c)} for c in [equal, *candidates]]
    p = sum((setting(f"w{i}") * F.col(r) for i, r in enumerate(runs)), F.lit(0.0))
    scores = grid_scores(wide, p, grid, runs)
    return first_per(scores, ["target"], [F.asc("score"), F.asc("config")]).drop("rank")


def refined_weight_search(wide: DataFrame, runs: list[str], first: DataFrame, step: float) -> DataFrame:
    """One local step around each target's winner (a handful of rows read on the driver)."""
    out: list[DataFrame] = []
    for row in first.collect():
        center = tuple(row[f"w{i}"] for i in range(len(runs)))
        mine = wide.where(F.col("target") == row["target"])
        out.append(weight_search(mine, runs, [center, *neighbours_on_simplex(center, step)]))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part)
    return result


def runs_side_by_side(predictions: DataFrame, runs: list[str]) -> DataFrame:
    return predictions.groupBy(*ROW).agg(
        F.max("y").alias("y"), *[F.max(F.when(F.col("run") == r, F.col("p"))).alias(r) for r in runs]
    )


# ---- temperature and bias ----------------------------------------------------


def calibration_grid() -> list[dict[str, float]]:
    return [{"temp": t, "bias": b} for t in even_grid(0.70, 1.20, 26) for b in even_grid(-0.20, 0.20, 41)]


def calibration_search(rows: DataFrame, p: str = "p") -> DataFrame:
    """Best (temperature, bias) per target; the identity unless something beats it."""
    logits = rows.withColumn("__z", logit(p))  # once per row, not once per setting
    tempered = business(sigmoid(setting("temp") * F.col("__z") + setting("bias")))
    scores = grid_scores(logits, tempered, calibration_grid(), ["__z"])
    best = first_per(scores, ["target"], [F.asc("score"), F.asc("config")])
    plain = rows.groupBy("target").agg(log_loss("y", p).alias("plain"))
    joined = best.join(plain, "target")
    wins = F.col("score") < F.col("plain")
    return joined.select(
        "target", F.when(wins, F.col("temp")).otherwise(1.0).alias("temp"),
        F.when(wins, F.col("bias")).otherwise(0.0).alias("bias"),
        F.when(wins, F.col("score")).otherwise(F.col("plain")).alias("score"),
    )


def override_params(base: DataFrame, overrides: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Base parameters with some targets replaced."""
    temp = by_target({t: v[0] for t, v in overrides.items()}, None)
    bias = by_target({t: v[1] for t, v in overrides.items()}, None)
    return base.select("target", F.coalesce(temp, F.col("temp")).alias("temp"), F.coalesce(bias, F.col("bias")).alias("bias"))


def interpolate_params(base: DataFrame, tight: Mapping[str, tuple[float, float]], alpha: float) -> DataFrame:
    """Move the parameters of the named targets a share alpha towards the tight ones."""
    goal = override_params(base, tight).select("target", F.col("temp").alias("t2"), F.col("bias").alias("b2"))
    return base.join(goal, "target").select(
        "target", (F.col("temp") + alpha * (F.col("t2") - F.col("temp"))).alias("temp"),
        (F.col("bias") + alpha * (F.col("b2") - F.col("bias"))).alias("bias"),
    )


def apply_calibration(rows: DataFrame, params: DataFrame, blend: float = 1.0) -> DataFrame:
    """Calibrated predictions, optionally only part of the way; targets without params stay."""
    joined = rows.join(F.broadcast(params.select("target", "temp", "bias")), "target", "left")  # one row per target
    tempered = temper("p", "temp", "bias", PROB_LOW, PROB_HIGH)
    mixed = business(mix("p", tempered, F.lit(blend)))
    return joined.withColumn("p", F.when(F.col("temp").isNull(), F.col("p")).otherwise(mixed)).drop("temp", "bias")
