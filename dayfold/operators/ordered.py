"""Ordered target statistics: a category as the mean label of the rows before it in a random order.

Ordered boosting encodes a category this way so that no row sees its own label. The order is that of a
digest, one for each permutation; running sums are taken inside small digest slices and offset by the slice
totals, so a category that holds most rows is never ordered in one task. Sums are kept for each fold, so one
pass serves every held-out fold: its training side is the other folds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.operators.ranking import key_digest
from dayfold.schema import KEYS
from dayfold.session import cut_lineage

PERMUTATIONS = 4


def sums_before(df: DataFrame, group: list[str], digest: str, values: dict[str, Column], digits: int = 3) -> DataFrame:
    """Adds for each value its sum over the rows of the group that come before in digest order (zero for the first)."""
    sliced = df.select("*", F.substring(digest, 1, digits).alias("__slice"))  # values are made after the shuffle
    totals = sliced.groupBy(*group, "__slice").agg(*[F.sum(v).alias(f"__t_{n}") for n, v in values.items()])
    earlier = Window.partitionBy(*group).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "__slice", *[F.coalesce(F.sum(f"__t_{n}").over(earlier), F.lit(0)).alias(f"__o_{n}") for n in values])
    local = Window.partitionBy(*group, "__slice").orderBy(digest).rowsBetween(Window.unboundedPreceding, -1)
    placed = sliced.select("*", *[F.coalesce(F.sum(v).over(local), F.lit(0)).alias(f"__l_{n}") for n, v in values.items()])
    # nearly as many slices as rows, but Spark sizes them by what was before the permutations: not to be broadcast
    joined = placed.join(offsets.hint("merge"), [*group, "__slice"])
    return joined.select(*df.columns, *[(F.col(f"__o_{n}") + F.col(f"__l_{n}")).alias(n) for n in values])


def _others(prefix: str, held: int, folds: int) -> Column:
    return reduce(Column.__add__, [F.col(f"{prefix}{f}") for f in range(folds) if f != held])


def ordered_statistics(
    labels: DataFrame, folds: int, category: str = "subject_id", permutations: int = PERMUTATIONS, m: float = 1.0
) -> DataFrame:
    """(keys, target, fold_id, held_0, held_1, ...): the category's statistic for every held-out fold.

    ``labels`` has keys, target, y, fold_id (0 to folds - 1) and the category. For a fold that does not hold
    the row out, it is (sum before + m mean) / (rows before + m) over the fold's training rows, averaged over
    the permutations; for the row's own fold all training rows of the category count, as for a row that is
    only predicted. The mean is that of the target's training rows of the fold.
    """
    known = labels.where(F.col("y").isNotNull()).select(*dict.fromkeys([*KEYS, "target", "fold_id", "y", category]))
    known = cut_lineage(known)  # read five times
    in_fold = [F.col("fold_id") == f for f in range(folds)]
    counts = {f"n{f}": c.cast("long") for f, c in enumerate(in_fold)}
    sums = {f"s{f}": F.when(c, F.col("y").cast("long")).otherwise(0) for f, c in enumerate(in_fold)}
    totals = known.groupBy("target", category).agg(*[F.sum(v).alias(f"all_{n}") for n, v in (counts | sums).items()])
    whole = known.groupBy("target").agg(*[F.sum(v).alias(f"any_{n}") for n, v in (counts | sums).items()])  # one row per target
    spread = known.withColumn("permutation", F.explode(F.array(*[F.lit(p) for p in range(permutations)])))
    spread = spread.withColumn("digest", key_digest("permutation", "target", *KEYS))
    before = sums_before(spread, ["target", category, "permutation"], "digest", counts | sums)
    rows = before.join(whole, "target")
    mean = lambda h: F.try_divide(_others("any_s", h, folds).cast("double"), _others("any_n", h, folds))
    value = lambda s, n, h: (_others(s, h, folds) + m * mean(h)) / (_others(n, h, folds) + m)
    ordered = rows.groupBy(*KEYS, "target", "fold_id", category).agg(*[F.avg(value("s", "n", h)).alias(f"held_{h}") for h in range(folds)])
    joined = ordered.join(totals.hint("merge"), ["target", category]).join(whole, "target")
    own = [F.when(F.col("fold_id") == h, value("all_s", "all_n", h)).otherwise(F.col(f"held_{h}")).alias(f"held_{h}") for h in range(folds)]
    return joined.select(*KEYS, "target", "fold_id", *own)


def category_statistics(labels: DataFrame, folds: int, category: str = "subject_id", m: float = 1.0) -> DataFrame:
    """(category, target, held_0, ...): what `ordered_statistics` gives rows that are only predicted."""
    known = labels.where(F.col("y").isNotNull())
    counts = {f"n{f}": (F.col("fold_id") == f).cast("long") for f in range(folds)}
    sums = {f"s{f}": F.when(F.col("fold_id") == f, F.col("y").cast("long")).otherwise(0) for f in range(folds)}
    totals = known.groupBy("target", category).agg(*[F.sum(v).alias(f"all_{n}") for n, v in (counts | sums).items()])
    whole = known.groupBy("target").agg(*[F.sum(v).alias(f"any_{n}") for n, v in (counts | sums).items()])
    mean = lambda h: F.try_divide(_others("any_s", h, folds).cast("double"), _others("any_n", h, folds))
    joined = totals.join(whole, "target")
    held = [((_others("all_s", h, folds) + m * mean(h)) / (_others("all_n", h, folds) + m)).alias(f"held_{h}") for h in range(folds)]
    return joined.select(category, "target", *held)
