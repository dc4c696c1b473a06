"""Columns that need the label split: calendar parts, subject z-scores, target encodings, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayfold.functions.scalar import model_calendar, ratio
from dayfold.operators.history import lag_one, rolling_mean
from dayfold.schema import (
    ADVANCED_PATTERNS, ENCODING_WINDOWS, FEATURE_VIEWS, HISTORY_ANCHORS, KEYS, TARGETS, VIEW_PRESETS,
)

CALENDAR_COLUMNS = ["dow", "month", "week", "is_weekend", "subject_num"]


def with_model_calendar(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in model_calendar("lifelog_date", "subject_id").items()])


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric feature columns in table order: keys, targets and split are excluded."""
    skip = {*KEYS, *TARGETS, "split"}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in skip]


def zscore_columns(df: DataFrame) -> list[str]:
    return [c for c in numeric_columns(df) if c not in CALENDAR_COLUMNS and "__" not in c]


def with_subject_zscores(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """z-score against the subject's training rows, applied to all rows.

    The statistics are conditional aggregates over the subject partition that the history
    windows already use, so there is no separate aggregation and join. Later training days of
    the subject take part, as in the reference: these columns are not past-only.
    """
    columns = zscore_columns(df) if columns is None else columns
    subject = Window.partitionBy("subject_id")

    def z(name: str) -> Column:
        seen = F.when(F.col("split") == "train", F.col(name).cast("double"))
        return ratio(F.col(name) - F.avg(seen).over(subject), F.stddev_samp(seen).over(subject))

    return df.select("*", *[z(c).alias(f"{c}__subj_z") for c in columns])


def with_target_encodings(df: DataFrame, targets: list[str] = TARGETS) -> DataFrame:
    """Lag and rolling means of each target over earlier rows; unlabelled rows are skipped."""
    out: dict[str, Column] = {}
    for t in targets:
        out[f"{t}_te_lag1"] = lag_one(t).cast("double")
        for days in ENCODING_WINDOWS:
            out[f"{t}_te_{days}"] = rolling_mean(t, days)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


# ---- feature views: rules on names, evaluated on the driver -----------------


def _is_day_core(name: str) -> bool:
    return name.startswith("tb_") or (
        name.startswith("d_") and not name.startswith(("d_behavior", "d_modal"))
    )


def _anchored(name: str, endings: list[str]) -> bool:
    return any(name.startswith(f"{a}__") for a in HISTORY_ANCHORS) and any(e in name for e in endings)


def view_columns(columns: list[str], view: str) -> list[str]:
    """Columns of a named view in table order; ``columns`` are the numeric feature columns."""
    if view not in FEATURE_VIEWS:
        raise ValueError(f"unknown feature view: {view}")
    means = ["__lag1", "__roll_mean_3", "__roll_mean_7", "__roll_mean_14"]
    z_base = lambda c: c.removesuffix("__subj_z")
    is_z = lambda c: c.endswith("__subj_z")
    shared = lambda c: (
        ("__" not in c and (_is_day_core(c) or c.startswith("s_"))) or "_te_" in c or c in CALENDAR_COLUMNS
    )
    rules = {
        "public_full": lambda c: True,
        "public_core": lambda c: "__" not in c or is_z(c),
        "public_notebook": lambda c: shared(c) or (is_z(c) and _is_day_core(z_base(c))),
        "public_hist365": lambda c: shared(c) or _anchored(c, means) or (is_z(c) and z_base(c) in HISTORY_ANCHORS),
        "public_hist411": lambda c: shared(c)
        or _anchored(c, [*means, "__roll_std_7", "__roll_std_14"])
        or (is_z(c) and z_base(c) in HISTORY_ANCHORS),
    }
    return [c for c in columns if rules[view](c)]


def advanced_view_columns(columns: list[str], view: str) -> list[str]:
    base = set(view_columns(columns, view))
    return [c for c in columns if c in base or any(p in c for p in ADVANCED_PATTERNS)]


def target_views(
    default: str = "public_core", preset: str | None = None, overrides: dict[str, str] | None = None
) -> dict[str, str]:
    """Which view each target trains on."""
    if preset is not None and preset not in VIEW_PRESETS:
        raise ValueError(f"unknown preset: {preset}")
    mapping = {t: default for t in TARGETS} | VIEW_PRESETS.get(preset, {}) | (overrides or {})
    unknown = {t: v for t, v in mapping.items() if v not in FEATURE_VIEWS}
    if unknown:
        raise ValueError(f"unknown feature views: {unknown}")
    return mapping
