"""Past-only history over the dense calendar.

All windows share one partitioning and order (subject, day), so a plan has one exchange and one
sort however many columns it makes. A partition is one subject's calendar: its size is bounded
by the number of days covered, whatever the volume of raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dayfold.functions.scalar import ratio, variation
from dayfold.schema import HISTORY_ANCHORS, MODALITIES, RATIO_EPS, SIGNED_ANCHORS


def by_day() -> WindowSpec:
    return Window.partitionBy("subject_id").orderBy("lifelog_date")


def past() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, -1)


def last_rows(n: int) -> WindowSpec:
    return by_day().rowsBetween(-n, -1)


def lag_one(name: str) -> Column:
    return F.lag(name, 1).over(by_day())


def expanding_mean(name: str) -> Column:
    return F.avg(name).over(past())


def rolling_mean(name: str, days: int) -> Column:
    """Mean of the non-null values of the frame.

    Differences of shares cancel to zero: their sum is exact (decimals) and rounded to nine places, so that a
    mean that is zero is zero, and what divides by it is null instead of rounding noise.
    """
    if name not in SIGNED_ANCHORS:
        return F.avg(name).over(last_rows(days))
    exact = F.sum(F.col(name).cast("decimal(26,12)")).over(last_rows(days))
    return F.try_divide(F.round(exact, 9).cast("double"), F.count(name).over(last_rows(days)))


def rolling_std(name: str, days: int) -> Column:
    """Sample deviation; null with fewer than two values."""
    return F.stddev_samp(name).over(last_rows(days))


def compact_index(name: str) -> Column:
    """Running number of the non-null values: gaps close, so it is the x axis of the slope."""
    return F.count(name).over(by_day().rowsBetween(Window.unboundedPreceding, 0))


def rolling_slope(name: str, index: str, days: int) -> Column:
    """Least-squares slope over the non-null values of the frame, two at least."""
    frame = last_rows(days)
    return F.when(F.count(name).over(frame) >= 2, F.regr_slope(F.col(name), F.col(index)).over(frame))


def days_since_seen(name: str, position: str) -> Column:
    """Rows since the last positive value; 0 on such a row, null before the first."""
    seen = F.last(F.when(F.col(name) > 0, F.col(position)), ignorenulls=True)
    upto = by_day().rowsBetween(Window.unboundedPreceding, 0)
    return (F.col(position) - seen.over(upto)).cast("double")


def seen_share(name: str, position: str, days: int) -> Column:
    """Share of observed rows; the first row of a subject counts as one unobserved past row."""
    hits = F.count(F.when(F.col(name) > 0, 1)).over(last_rows(days))
    return hits / F.least(F.col(position), F.lit(days))


def anchor_windows(name: str, index: str) -> dict[str, Column]:
    out = {f"{name}__lag1": lag_one(name), f"{name}__expanding_mean": expanding_mean(name)}
    for days in (3, 7, 14):
        out[f"{name}__roll_mean_{days}"] = rolling_mean(name, days)
    for days in (7, 14):
        out[f"{name}__roll_std_{days}"] = rolling_std(name, days)
        out[f"{name}__slope_{days}"] = rolling_slope(name, index, days)
    return out


def anchor_contrasts(name: str) -> dict[str, Column]:
    """Deltas, z-scores and ratios of today against the past-only columns."""
    now, w = F.col(name), (lambda k: F.col(f"{name}__{k}"))
    out = {f"{name}__delta_{d}": now - w(f"roll_mean_{d}") for d in (3, 7, 14)}
    out[f"{name}__delta_expanding"] = now - w("expanding_mean")
    for d in (7, 14):
        out[f"{name}__zscore_{d}"] = ratio(now - w(f"roll_mean_{d}"), w(f"roll_std_{d}") + RATIO_EPS)
    for d in (3, 14):
        out[f"{name}__ratio_{d}"] = ratio(now + RATIO_EPS, w(f"roll_mean_{d}") + RATIO_EPS)
    recent, long_run = w("roll_mean_3"), w("roll_mean_14")
    out[f"{name}__recent_vs_history_gap"] = recent - long_run
    out[f"{name}__recent_vs_history_ratio"] = ratio(recent + RATIO_EPS, long_run + RATIO_EPS)
    out[f"{name}__cv_14"] = variation(long_run, w("roll_std_14"))
    return out


def presence_windows(modality: str, columns: list[str], position: str) -> dict[str, Column]:
    out: dict[str, Column] = {}
    rows, cover, seen = (f"d_{modality}_{k}" for k in ("row_cnt", "coverage_ratio", "bucket_present_cnt"))
    if rows in columns:
        out[f"miss_days_since_last_{modality}"] = days_since_seen(rows, position)
        for d in (7, 14):
            out[f"{rows}__obs_share_{d}"] = seen_share(rows, position, d)
            out[f"{rows}__roll_mean_{d}"] = rolling_mean(rows, d)
    if cover in columns:
        for d in (7, 14):
            out[f"{cover}__roll_mean_{d}"] = rolling_mean(cover, d)
    if seen in columns:
        out[f"{seen}__roll_mean_7"] = rolling_mean(seen, 7)
    return out


def presence_contrasts(modality: str, columns: list[str]) -> dict[str, Column]:
    names = [f"d_{modality}_{k}" for k in ("row_cnt", "coverage_ratio")]
    return {f"{n}__delta_7": F.col(n) - F.col(f"{n}__roll_mean_7") for n in names if n in columns}


def with_history(
    df: DataFrame, anchors: list[str] = HISTORY_ANCHORS, modalities: list[str] = MODALITIES
) -> DataFrame:
    """Add every past-only column of the present anchors and sensors in three projections."""
    columns = df.columns
    anchors = [a for a in anchors if a in columns]
    indexed = df.select(
        "*",
        F.row_number().over(by_day()).alias("__row"),
        *[compact_index(a).alias(f"__i_{a}") for a in anchors],
    )
    windows: dict[str, Column] = {}
    contrasts: dict[str, Column] = {}
    for a in anchors:
        windows |= anchor_windows(a, f"__i_{a}")
        contrasts |= anchor_contrasts(a)
    for m in modalities:
        windows |= presence_windows(m, columns, "__row")
        contrasts |= presence_contrasts(m, columns)
    windowed = indexed.select(*columns, *[c.alias(n) for n, c in windows.items()])
    return windowed.select("*", *[c.alias(n) for n, c in contrasts.items()])
