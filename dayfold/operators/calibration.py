"""Calibration of many groups (target, held-out fold) in one plan.

Scores are counted per group and distinct probability first; models are fitted on the counts. Isotonic
blocks are pooled inside sorted ranges of scores and then across them: pooling adjacent violators gives the
same blocks in whatever order it is done. Platt's regression takes Newton steps whose sums for all groups
come from one aggregation each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import logit, probability, sigmoid

#: Score ranges into which segments are dealt for the join with the rows.
CELLS = 256
NEWTON_STEPS = 10


def score_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, p, n, s): rows and positives of each labelled score, clipped to a probability."""
    known = rows.where(F.col("y").isNotNull() & F.col("p").isNotNull()).withColumn("p", probability("p"))
    return known.groupBy(*by, "p").agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("s"))


def counts_without_fold(rows: DataFrame, folds: list[int], by: list[str]) -> DataFrame:
    """Counts of each held-out fold's training side: (by, held, p, n, s); only counts are copied, not rows."""
    counts = score_counts(rows, [*by, "fold_id"])
    held = F.explode(F.array_except(F.array(*[F.lit(f) for f in folds]), F.array(F.col("fold_id").cast("int"))))
    spread = counts.withColumn("held", held)
    return spread.groupBy(*by, "held", "p").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


# ---- isotonic -------------------------------------------------------------------


def _pool(blocks: list[list], lo: float, hi: float, n: int, s: int) -> None:
    """Appends a block of higher scores; blocks whose mean is not below that of the next one become one."""
    while blocks and blocks[-1][3] * n >= s * blocks[-1][2]:
        before = blocks.pop()
        lo, n, s = before[0], n + before[2], s + before[3]
    blocks.append([lo, hi, n, s])


def _pooled_ranges(by: list[str]):
    """Pools each group's blocks inside a task's sorted range of scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, group, blocks = None, None, []

        def flush() -> pa.RecordBatch:
            columns = [pa.array([k] * len(blocks), schema.field(c).type) for k, c in zip(group, by)]
            values = [pa.array(v, t) for v, t in zip(zip(*blocks), (pa.float64(), pa.float64(), pa.int64(), pa.int64()))]
            return pa.RecordBatch.from_arrays(columns + values, [*by, "lo", "hi", "n", "s"])

        for batch in batches:
            schema = batch.schema
            keys = list(zip(*(batch.column(c).to_pylist() for c in by)))
            for key, lo, hi, n, s in zip(keys, *(batch.column(c).to_pylist() for c in ("lo", "hi", "n", "s"))):
                if key != group:
                    if blocks:
                        yield flush()
                    group, blocks = key, []
                _pool(blocks, lo, hi, n, s)
        if blocks:
            yield flush()

    return run


def _pooled_group(min_rows: int):
    """Pools the blocks of one group; a group with few rows or one class gives none."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        blocks: list[list] = []
        for row in zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "s"))):
            _pool(blocks, *row)
        n, s = sum(b[2] for b in blocks), sum(b[3] for b in blocks)
        if n < min_rows or s in (0, n):
            blocks = []
        out = table.slice(0, 1).take(pa.array([0] * len(blocks), pa.int64()))
        for i, name in enumerate(("lo", "hi", "n", "s")):
            at = out.schema.get_field_index(name)
            out = out.set_column(at, name, pa.array([b[i] for b in blocks], out.schema.field(name).type))
        return out

    return run


def isotonic_blocks(counts: DataFrame, by: list[str], min_rows: int = 10) -> DataFrame:
    """(by, lo, hi, n, s): the blocks of the isotonic fit of each group, rising in lo and in s / n.

    The last step takes one group's blocks of all ranges: with labels of 0 and 1 their means are different
    fractions, so n rows make no more than about n ** (2/3) blocks in a range, typically n ** (1/3).
    """
    start = counts.select(*by, F.col("p").alias("lo"), F.col("p").alias("hi"), "n", "s")
    ranges = start.repartitionByRange(*by, "lo").sortWithinPartitions(*by, "lo")
    return ranges.mapInArrow(_pooled_ranges(by), start.schema).groupBy(*by).applyInArrow(_pooled_group(min_rows), start.schema)


def apply_isotonic(rows: DataFrame, blocks: DataFrame, by: list[str]) -> DataFrame:
    """Rows with p calibrated: constant inside a block, linear between blocks, clipped outside.

    Groups without blocks keep their clipped p. A block reaches to the next one, so a score has one segment;
    segments are dealt to score cells, which is what they are joined on.
    """
    order = Window.partitionBy(*by).orderBy("lo")
    mean = F.col("s") / F.col("n")
    segments = blocks.select(
        *by, "hi", mean.alias("mean"), F.lead("lo").over(order).alias("next_lo"), F.lead(mean).over(order).alias("next_mean"),
        F.when(F.row_number().over(order) == 1, F.lit(0.0)).otherwise(F.col("lo")).alias("begin"),
    ).withColumn("end", F.coalesce("next_lo", F.lit(2.0)))
    cell = lambda c: F.floor(F.least(c, F.lit(1.0)) * CELLS)
    segments = segments.withColumn("cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("end")))))
    left = rows.withColumn("p", probability("p")).withColumn("cell", cell(F.col("p"))).alias("r")
    meets = [F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}")) for c in [*by, "cell"]]
    inside = (F.col("r.p") >= F.col("g.begin")) & (F.col("r.p") < F.col("g.end"))
    joined = left.join(segments.alias("g"), reduce(Column.__and__, [*meets, inside]), "left")
    p, hi = F.col("r.p"), F.col("g.hi")
    between = F.col("g.mean") + (p - hi) / (F.col("next_lo") - hi) * (F.col("next_mean") - F.col("g.mean"))
    value = F.when((p <= hi) | F.col("next_lo").isNull(), F.col("g.mean")).otherwise(between)
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns if c != "p"], probability(F.coalesce(value, p)).alias("p"))


def isotonic_out_of_fold(predictions: DataFrame, folds: list[int], by: list[str] = ["target"]) -> DataFrame:
    """Each fold's predictions calibrated by the fit on the other folds; all groups and folds in one plan."""
    blocks = isotonic_blocks(counts_without_fold(predictions, folds, by), [*by, "held"])
    rows = predictions.withColumn("held", F.col("fold_id").cast("int"))
    return apply_isotonic(rows, blocks, [*by, "held"]).select(*predictions.columns)


# ---- Platt -------------------------------------------------------------------


def platt_fits(counts: DataFrame, by: list[str], steps: int = NEWTON_STEPS, penalty: float = 1.0) -> DataFrame:
    """(by, slope, offset): logistic regression on the logit, the slope with a squared penalty, by Newton steps.

    It starts at slope 0 and the logit of the group's mean; every step is one aggregation for all groups. A
    group of one class has no row, which stands for the identity.
    """
    z = counts.withColumn("z", logit("p"))
    known = z.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where((F.col("s") > 0) & (F.col("s") < F.col("n")))
    fits = known.select(*by, F.lit(0.0).alias("slope"), F.ln(F.col("s") / (F.col("n") - F.col("s"))).alias("offset"))
    for _ in range(steps):
        rows = z.join(fits, by)
        p = sigmoid(F.col("slope") * F.col("z") + F.col("offset"))
        rows = rows.withColumn("e", F.col("n") * p - F.col("s")).withColumn("v", F.col("n") * p * (1.0 - p))
        sums = rows.groupBy(*by, "slope", "offset").agg(
            F.sum("e").alias("g0"), F.sum(F.col("e") * F.col("z")).alias("g1"), F.sum("v").alias("h00"),
            F.sum(F.col("v") * F.col("z")).alias("h01"), F.sum(F.col("v") * F.col("z") * F.col("z")).alias("h11"),
        ).withColumn("g1", F.col("g1") + penalty * F.col("slope")).withColumn("h11", F.col("h11") + penalty)
        size = F.col("h00") * F.col("h11") - F.col("h01") * F.col("h01")
        slope = F.col("slope") - (F.col("h00") * F.col("g1") - F.col("h01") * F.col("g0")) / size
        offset = F.col("offset") - (F.col("h11") * F.col("g0") - F.col("h01") * F.col("g1")) / size
        fits = sums.select(*by, slope.alias("slope"), offset.alias("offset"))
    return fits


def apply_platt_fits(rows: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """Rows with p calibrated; rows of a group without a fit keep their clipped p."""
    joined = rows.join(fits, by, "left")
    p = F.coalesce(sigmoid(F.col("slope") * logit("p") + F.col("offset")), F.col("p"))
    return joined.withColumn("p", probability(p)).select(*rows.columns)


def platt_out_of_fold(predictions: DataFrame, folds: list[int], by: list[str] = ["target"], steps: int = NEWTON_STEPS) -> DataFrame:
    """Each fold's predictions calibrated by the regression on the other folds."""
    fits = platt_fits(counts_without_fold(predictions, folds, by), [*by, "held"], steps)
    rows = predictions.withColumn("held", F.col("fold_id").cast("int"))
    return apply_platt_fits(rows, fits, [*by, "held"]).select(*predictions.columns)
