"""Exact grouped quantiles by rank selection over ordered value buckets.

There is one way for every group size. Equal values of a group are counted first, which combines before the
shuffle. A value's bucket is the head of its floating-point form (sign, exponent, leading digits of the
mantissa), so buckets are ordered and equally fine at every magnitude. The buckets that hold a wanted rank
are found from bucket counts, then split once more by further digits, and only the values of such a fine
bucket are ordered. No task sees more than one fine bucket of one group, and the log is read twice: once for
all counts, and once for the values of the wanted buckets, which the scan filters by.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps per doubling of the coarse and of the fine buckets.
COARSE, FINE = 256, 256 * 4096


def value_bucket(value: Column, steps: int = COARSE) -> Column:
    """Monotone bucket number with ``steps`` steps per doubling, mirrored for negatives; zero has its own."""
    size = F.abs(value)
    exponent = F.floor(F.log2(size))
    # just under a power of two the logarithm may round up; the step then falls on the last one below
    step = F.floor(size / F.pow(F.lit(2.0), exponent) * steps) - steps
    number = (exponent + 1100) * steps + step
    found = F.when(value == 0, F.lit(0)).when(value < 0, -number).otherwise(number).cast("bigint")
    return F.coalesce(found, F.lit(0))  # never null, so no step adds a filter of its own to the shared scan


def exact_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: dict[str, float]) -> DataFrame:
    """One row per group that has a value, with linearly interpolated quantiles; nulls and null keys are ignored."""
    rows = df.select(*keys, value.cast("double").alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    rows = rows.dropna(subset=keys)
    counted = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__c"))
    counted = counted.select("*", value_bucket(F.col("__v")).alias("__b"), value_bucket(F.col("__v"), FINE).alias("__f"))
    coarse = _starts(counted.groupBy(*keys, "__b").agg(F.sum("__c").alias("__c")), keys, "__b")
    wanted = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in quantiles.items()]))
    position = (F.col("__n") - 1) * F.col("__w.q")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), f(position).alias("rank")) for s, f in (("lo", F.floor), ("hi", F.ceil))])
    ranks = coarse.select(*keys, "__b", "__from", "__to", "__n", wanted.alias("__w")).select(
        *keys, "__b", "__from", "__to", F.col("__w.name").alias("__name"), (position - F.floor(position)).alias("__part"), F.explode(sides).alias("__r")
    )
    ranks = ranks.where((F.col("__r.rank") >= F.col("__from")) & (F.col("__r.rank") < F.col("__to")))
    ranks = ranks.select(*keys, "__b", "__name", "__part", F.col("__r.side").alias("__side"), (F.col("__r.rank") - F.col("__from")).alias("__rank"))
    ranks = _narrowed(counted.groupBy(*keys, "__b", "__f").agg(F.sum("__c").alias("__c")), ranks, [*keys, "__b"], "__f")
    chosen = _narrowed(counted, ranks, [*keys, "__b", "__f"], "__v")
    at = lambda name, side: F.max(F.when((F.col("__name") == name) & (F.col("__side") == side), F.col("__v")))
    part = lambda name: F.max(F.when(F.col("__name") == name, F.col("__part")))
    return chosen.groupBy(*keys).agg(*[(at(n, "lo") + (at(n, "hi") - at(n, "lo")) * part(n)).alias(n) for n in quantiles])


def _starts(counts: DataFrame, group: list[str], by: str) -> DataFrame:
    """Adds the ranks [__from, __to) that each row of counts covers in its group, and the group's size __n."""
    whole = Window.partitionBy(*group)
    to = F.sum("__c").over(whole.orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("*", to.alias("__to"), (to - F.col("__c")).alias("__from"), F.sum("__c").over(whole).alias("__n"))


def _narrowed(counts: DataFrame, ranks: DataFrame, group: list[str], by: str) -> DataFrame:
    """The ranks, placed into the ``by`` of their group that covers them and counted from its start."""
    some = ranks.select(*group).distinct()
    placed = _starts(counts.join(some, group, "left_semi"), group, by)
    found = placed.select(*group, by, "__from", "__to").join(ranks, group)
    found = found.where((F.col("__rank") >= F.col("__from")) & (F.col("__rank") < F.col("__to")))
    return found.select(*group, by, "__name", "__part", "__side", (F.col("__rank") - F.col("__from")).alias("__rank"))
