"""Per-row summaries of nested payloads with higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dayfold.functions.scalar import ratio, to_number


def numbers(values: Column, field: str | None = None) -> Column:
    """Parseable, non-NaN doubles of an array (or of one field of its structs)."""
    pick = (lambda item: to_number(item[field])) if field else to_number
    return F.filter(F.transform(values, pick), lambda x: x.isNotNull())


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def average(values: Column) -> Column:
    return ratio(total(values), F.size(values))


def std_pop(values: Column, mean: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(ratio(squares, F.size(values)))


def entropy(weights: Column) -> Column:
    """Natural-log entropy of renormalised weights; empty is null, no mass is zero."""
    mass = total(weights)
    terms = F.aggregate(
        F.filter(weights, lambda x: x > 0.0),
        F.lit(0.0),
        lambda acc, x: acc - F.try_divide(x, mass) * F.ln(F.try_divide(x, mass)),
    )
    # a share that is negative or zero carries no information
    return F.when(F.size(weights) == 0, F.lit(None)).when(mass <= 0.0, F.lit(0.0)).otherwise(terms)


def item_count(values: Column) -> Column:
    return F.coalesce(F.size(values), F.lit(0)).cast("double")


def or_empty(values: Column, ddl: str) -> Column:
    return F.coalesce(values, F.array().cast(ddl))


def heart_rate_stats(samples: Column) -> dict[str, Column]:
    """Row statistics of an already cleaned sample array."""
    mean = average(samples)
    return {
        "hr_mean": mean,
        "hr_min": F.array_min(samples),
        "hr_max": F.array_max(samples),
        "hr_std": std_pop(samples, mean),
        "hr_count": F.size(samples).cast("double"),
    }


def dominant_app(items: Column) -> Column:
    """Name of the first strict maximum above -1 among parseable times, else ''."""
    seed = F.struct(F.lit(-1.0).alias("best"), F.lit("").alias("app"))

    def step(acc: Column, item: Column) -> Column:
        time = to_number(item["total_time"])
        better = F.coalesce(time > acc["best"], F.lit(False))
        return F.when(
            better, F.struct(time.alias("best"), clean_app(item["app_name"]).alias("app"))
        ).otherwise(acc)

    return F.aggregate(items, seed, step, lambda acc: acc["app"])


def clean_text(text: Column) -> Column:
    """Both ends trimmed of white space; null is ''."""
    return F.coalesce(F.btrim(text, F.lit(" \t\r\n")), F.lit(""))


def clean_app(name: Column) -> Column:
    """Non-breaking spaces become plain spaces before trimming."""
    return clean_text(F.translate(name, "\u00a0", " "))


def ambience_pairs(items: Column) -> Column:
    """Only items that carry both a label and a score."""
    return F.filter(items, lambda item: F.size(item) >= 2)
