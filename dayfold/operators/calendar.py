"""Dense calendar, key joins and same-day derived columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayfold.functions.scalar import base_calendar, bounded, column_or, ratio
from dayfold.schema import BUCKETS, DAY_KEYS, MODALITIES, RATIO_EPS


def dense_calendar(days: DataFrame) -> DataFrame:
    """Every day between the first and last one of each subject."""
    bounds = days.groupBy("subject_id").agg(
        F.min("lifelog_date").alias("lo"), F.max("lifelog_date").alias("hi")
    )
    return bounds.select("subject_id", F.explode(F.sequence("lo", "hi")).alias("lifelog_date"))


def fill_calendar(daily: DataFrame) -> DataFrame:
    """Insert the missing days of each subject with null features.

    Same rows as joining onto ``dense_calendar``, but each row emits the gap that follows it, so
    there is no second scan for the bounds and no join; the subject partitioning it needs is the
    one the history windows use next.
    """
    by_day = Window.partitionBy("subject_id").orderBy("lifelog_date")
    until = F.coalesce(F.date_sub(F.lead("lifelog_date").over(by_day), 1), F.col("lifelog_date"))
    spread = daily.withColumn("__days", F.sequence("lifelog_date", until))
    features = [c for c in daily.columns if c not in DAY_KEYS]
    spread = spread.select("subject_id", *features, F.posexplode("__days").alias("__pos", "lifelog_date"))
    return spread.select(
        *DAY_KEYS, *[F.when(F.col("__pos") == 0, F.col(c)).alias(c) for c in features]
    )


def calendar_left_join(calendar: DataFrame, merged: DataFrame) -> DataFrame:
    return calendar.join(merged, DAY_KEYS, "left")


def attach_to_keys(keys: DataFrame, enriched: DataFrame) -> DataFrame:
    """Key frame on the left, daily table on (subject, lifelog date)."""
    return keys.join(enriched, DAY_KEYS, "left")


def with_calendar_parts(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in base_calendar("lifelog_date").items()])


def _zero(df: DataFrame, name: str) -> Column:
    return column_or(df, name, 0.0)


def with_density(df: DataFrame, modalities: list[str] = MODALITIES) -> DataFrame:
    """Missing flags, zero-filled presence columns and density ratios, in one projection."""
    filled: dict[str, Column] = {}
    derived: dict[str, Column] = {}
    for m in modalities:
        rows, cover, seen = (f"d_{m}_{k}" for k in ("row_cnt", "coverage_ratio", "bucket_present_cnt"))
        for name in (rows, cover, seen):
            filled[name] = _zero(df, name)
        derived[f"miss_{m}_any"] = column_or(df, rows, None).isNull().cast("double")
        derived[f"d_{m}_bucket_util_share"] = filled[seen] / float(len(BUCKETS))
        derived[f"d_{m}_row_per_bucket"] = filled[rows] / (filled[seen] + 1.0)
        derived[f"d_{m}_row_per_hour"] = filled[rows] / (filled[cover] * 24.0 + 1.0)
    kept = [filled[c].alias(c) if c in filled else F.col(c) for c in df.columns]
    added = [c.alias(n) for n, c in (filled | derived).items() if n not in df.columns]
    return df.select(*kept, *added)


def with_modality_totals(df: DataFrame, modalities: list[str] = MODALITIES) -> DataFrame:
    """Row-wise reductions over all sensors; expects ``with_density`` columns."""
    size = float(len(modalities))

    def across(suffix: str) -> Column:
        return sum((F.col(f"d_{m}_{suffix}") for m in modalities), F.lit(0.0))

    missing = sum((F.col(f"miss_{m}_any") for m in modalities), F.lit(0.0))
    return df.select(
        "*",
        (size - missing).alias("d_modal_observed_cnt"),
        across("row_cnt").alias("d_modal_total_row_cnt"),
        (across("coverage_ratio") / size).alias("d_modal_mean_coverage"),
        (across("bucket_util_share") / size).alias("d_modal_mean_bucket_util"),
        missing.alias("d_modal_missing_cnt"),
    )


def _night_and_day(df: DataFrame, name: str) -> tuple[Column, Column]:
    bucket = lambda b: _zero(df, f"tb_{b}_{name}")
    return bucket("overnight") + bucket("evening"), bucket("morning") + bucket("afternoon")


def with_contrasts(df: DataFrame) -> DataFrame:
    """(overnight + evening) against (morning + afternoon)."""
    out: dict[str, Column] = {}
    for short, name in (
        ("screen", "mscreen_on_share"), ("charge", "mac_charge_share"), ("gps", "mgps_speed_mean"),
    ):
        night, day = _night_and_day(df, name)
        out[f"d_behavior_{short}_night_day_gap"] = night - day
        out[f"d_behavior_{short}_night_day_ratio"] = ratio(night + RATIO_EPS, day + RATIO_EPS)
    night, day = _night_and_day(df, "mlight_log_mean")
    out["d_behavior_light_night_day_gap"] = night - day
    night, day = _night_and_day(df, "wpedo_step_sum")
    out["d_behavior_steps_night_day_ratio"] = ratio(night + 1.0, day + 1.0)
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def with_interactions(df: DataFrame) -> DataFrame:
    """Eleven products and ratios between sensors of the same day."""
    z = lambda name: _zero(df, name)
    screen, charge = z("d_mscreen_on_min"), z("d_mac_charge_min")
    screen_share, charge_share = z("d_mscreen_on_share"), z("d_mac_charge_share")
    step_log = F.log1p(z("d_wpedo_step_sum"))
    extent_log = F.log1p(bounded(z("d_mgps_extent"), low=0.0))
    screen_night, _ = _night_and_day(df, "mscreen_on_share")
    charge_night, _ = _night_and_day(df, "mac_charge_share")
    light_night, _ = _night_and_day(df, "mlight_log_mean")
    out = {
        "x_screen_charge_share": screen_share * charge_share,
        "x_screen_charge_gap": screen - charge,
        "x_screen_per_step": ratio(screen, step_log + 1.0),
        "x_charge_per_screen": ratio(charge, screen + 1.0),
        "x_steps_extent_log": step_log * extent_log,
        "x_steps_hr": step_log * z("d_whr_mean"),
        "x_stationary_screen": z("d_mgps_stationary_share") * screen_share,
        "x_usage_screen_density": ratio(z("d_muse_unique_app_cnt"), screen + 1.0),
        "x_usage_speech": z("d_muse_sum_log_total_time_mean") * z("d_mamb_speech_top1_share"),
        "x_night_screen_charge": screen_night * charge_night,
        "x_night_screen_lowlight": ratio(screen_night, light_night + 1.0),
    }
    return df.select("*", *[c.alias(n) for n, c in out.items()])


def with_advanced_interactions(df: DataFrame) -> DataFrame:
    """Eight further cross-sensor columns; missing heart rate or entropy stays missing."""
    z = lambda name: _zero(df, name)
    raw = lambda name: column_or(df, name, None)
    wifi_log = F.log1p(z("d_mwifi_unique_bssid_cnt"))
    screen_night, _ = _night_and_day(df, "mscreen_on_share")
    steps_night, _ = _night_and_day(df, "wpedo_step_sum")
    hr_day = (raw("tb_morning_whr_mean") + raw("tb_afternoon_whr_mean")) / 2.0
    out = {
        "x_hr_per_step_log": ratio(raw("d_whr_mean"), F.log1p(z("d_wpedo_step_sum")) + 1.0),
        "x_gps_wifi_social": F.log1p(bounded(z("d_mgps_extent"), low=0.0)) * wifi_log,
        "x_ble_wifi_indoor": F.log1p(z("d_mble_unique_addr_cnt")) * wifi_log,
        "x_night_disruption": screen_night * F.log1p(steps_night),
        "x_activity_entropy_hr": raw("d_mact_entropy") * raw("d_whr_rest_q10"),
        "x_screen_session_density": ratio(z("d_mscreen_session_cnt"), z("d_mscreen_on_min") + 1.0),
        "x_speech_mobility": z("d_mamb_speech_top1_share") * F.log1p(z("d_mgps_speed_mean")),
        "x_hr_rest_day_gap": raw("d_whr_rest_q10") - hr_day,
    }
    return df.select("*", *[c.alias(n) for n, c in out.items()])
