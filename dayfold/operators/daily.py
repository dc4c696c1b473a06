"""Day summaries of the twelve sensor logs.

Every summary is a list of parts keyed by (subject_id, lifelog_date): one aggregation that combines
on the map side (on/off and activity logs reduce ten-minute slices instead, because they need the
order of rows), plus parts for ranks (quantiles) and distinct nested values. ``merge_parts`` folds parts into rows with one more exchange of already
reduced data; the full daily table merges the parts of all sensors at once.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayfold.functions import arrays as A
from dayfold.functions.scalar import contains_any, hour_bucket, log1p_floor, to_number
from dayfold.operators.quantiles import exact_quantiles
from dayfold.operators.runs import run_statistics, slice_hour, slice_summaries, time_slice, transition_count
from dayfold.schema import ACTIVITY_CODES, AMBIENCE_KEYWORDS, BUCKETS, DAY_KEYS

Parts = list[DataFrame]


def prepare_events(df: DataFrame) -> DataFrame:
    """Typed timestamp, day and six-hour bucket. No sort: order is asked for where it matters."""
    ts = F.col("timestamp")
    ntz = dict(df.dtypes)["timestamp"] == "timestamp_ntz"
    typed = df if ntz else df.withColumn("timestamp", ts.cast("timestamp"))
    return (
        typed.where(ts.isNotNull() & F.col("subject_id").isNotNull())
        .withColumn("lifelog_date", F.to_date(ts))
        .withColumn("hour_bucket", hour_bucket(ts))
    )


def presence(prefix: str) -> list[Column]:
    """Row count, share of hours seen and number of buckets seen.

    Hours and buckets are kept as bit sets, so the distinct counts stay algebraic.
    """
    hour = F.hour("timestamp")
    hours = F.bit_count(F.bit_or(_bit(hour)))
    buckets = F.bit_count(F.bit_or(_bit(F.floor(hour / 6))))
    return [
        F.count("*").cast("double").alias(f"d_{prefix}_row_cnt"),
        (hours / 24.0).alias(f"d_{prefix}_coverage_ratio"),
        buckets.cast("double").alias(f"d_{prefix}_bucket_present_cnt"),
    ]


def per_bucket(value: Column, reducer: Callable[[Column], Column], name: str) -> list[Column]:
    """The reducer inside each time bucket; an empty bucket gives null, also for sums."""
    return [
        reducer(F.when(F.col("hour_bucket") == bucket, value)).alias(f"tb_{bucket}_{name}")
        for bucket in BUCKETS
    ]


def share(condition: Column) -> Column:
    """Share of rows that satisfy the condition; a null condition counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def merge_parts(parts: Parts, keys: list[str] = DAY_KEYS) -> DataFrame:
    """Union the parts and give each key one row.

    A part has one row per key, so its columns travel as one struct and a row touches one
    aggregate per part, not one per column. A column that several parts carry (the zero of an
    empty day, the count of a full one) takes its largest value.
    """
    if len(parts) == 1:
        return parts[0]
    schemas = [p.schema for p in parts]
    owners: dict[str, list[int]] = {}
    for i, schema in enumerate(schemas):
        for field in schema:
            if field.name not in keys:
                owners.setdefault(field.name, []).append(i)
    packed = []
    for i, (part, schema) in enumerate(zip(parts, schemas)):
        names = [n for n in schema.names if n not in keys]
        if names:
            packed.append(part.select(*keys, F.struct(*names).alias(f"__{i}")))
        else:
            packed.append(part.select(*keys))
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), packed)
    structs = [c for c in stacked.columns if c not in keys]
    merged = stacked.repartition(*keys).groupBy(*keys).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in structs]
    )

    def value(name: str) -> Column:
        found = [F.col(f"__{i}")[name] for i in owners[name]]
        return found[0] if len(found) == 1 else F.greatest(*found)

    return merged.select(*keys, *[value(n).alias(n) for n in owners])


def _bit(number: Column) -> Column:
    return F.pow(F.lit(2.0), number).cast("int")


def _slice_presence() -> tuple[dict[str, Column], dict[str, Column]]:
    """Row count sum and the bit sets of hours and buckets, over slice summaries."""
    hour = slice_hour()
    return {"rows": F.col("rows")}, {"hours": _bit(hour), "buckets": _bit(F.floor(hour / 6))}


def _presence_columns(prefix: str) -> list[Column]:
    return [
        F.col("rows").cast("double").alias(f"d_{prefix}_row_cnt"),
        (F.bit_count("hours") / 24.0).alias(f"d_{prefix}_coverage_ratio"),
        F.bit_count("buckets").cast("double").alias(f"d_{prefix}_bucket_present_cnt"),
    ]


def _on_off_parts(df: DataFrame, column: str, prefix: str, names: dict[str, str]) -> Parts:
    """Totals, shares and runs of an on/off log from one pass over its rows."""
    rows = prepare_events(df.select("subject_id", "timestamp", column))
    active = (F.coalesce(F.col(column).cast("double"), F.lit(0.0)) > 0).cast("int")
    rows = rows.withColumn("active", active)
    slices = slice_summaries(
        rows, DAY_KEYS, F.col("active"), [F.col("timestamp"), F.col("active")], time_slice(F.col("timestamp")),
        {"on": F.col("run_value") * F.col("run_length")},
    )
    sums, bits = _slice_presence()
    sums["on"] = F.col("on")
    for i, bucket in enumerate(BUCKETS):
        inside = F.floor(slice_hour() / 6) == i
        sums |= {f"rows_{bucket}": F.when(inside, F.col("rows")), f"on_{bucket}": F.when(inside, F.col("on"))}
    days = run_statistics(slices, DAY_KEYS, names["episodes"], names["longest"], sums, bits)
    return [days.select(
        *DAY_KEYS, *_presence_columns(prefix),
        F.col("on").cast("double").alias(names["total"]),
        (F.col("on") / F.col("rows")).alias(names["share"]),
        names["episodes"], names["longest"],
        *[(F.col(f"on_{b}") / F.col(f"rows_{b}")).alias(f"tb_{b}_{names['bucket']}") for b in BUCKETS],
    )]


def charging_parts(df: DataFrame) -> Parts:
    return _on_off_parts(df, "m_charging", "mac", {
        "total": "d_mac_charge_min", "share": "d_mac_charge_share", "bucket": "mac_charge_share",
        "episodes": "d_mac_charge_episode_cnt", "longest": "d_mac_longest_charge_min",
    })


def screen_parts(df: DataFrame) -> Parts:
    return _on_off_parts(df, "m_screen_use", "mscreen", {
        "total": "d_mscreen_on_min", "share": "d_mscreen_on_share", "bucket": "mscreen_on_share",
        "episodes": "d_mscreen_session_cnt", "longest": "d_mscreen_longest_session_min",
    })


def activity_parts(df: DataFrame) -> Parts:
    rows = prepare_events(df.select("subject_id", "timestamp", "m_activity"))
    rows = rows.withColumn("code", F.coalesce(F.col("m_activity").cast("int"), F.lit(-1)))
    per_code = {
        f"code{c}": F.when(F.col("run_value") == c, F.col("run_length")).otherwise(0) for c in ACTIVITY_CODES
    }
    slices = slice_summaries(
        rows, DAY_KEYS, F.col("code"), [F.col("timestamp"), F.col("code")], time_slice(F.col("timestamp")), per_code
    )
    sums, bits = _slice_presence()
    sums |= {n: F.col(n) for n in per_code}
    days = transition_count(slices, DAY_KEYS, "d_mact_transition_cnt", sums, bits)
    days = days.select(
        *DAY_KEYS, *_presence_columns("mact"), "d_mact_transition_cnt",
        *[(F.col(f"code{c}") / F.col("rows")).alias(f"d_mact_code{c}_share") for c in ACTIVITY_CODES],
    )
    shares = F.array(*[F.col(f"d_mact_code{c}_share") for c in ACTIVITY_CODES])
    return [days.withColumn("d_mact_entropy", A.entropy(shares))]


def light_parts(df: DataFrame, column: str, prefix: str, with_buckets: bool) -> Parts:
    rows = prepare_events(df.select("subject_id", "timestamp", column))
    rows = rows.withColumn("v", F.coalesce(to_number(column), F.lit(0.0)))
    logged = log1p_floor("v")
    ranks = {f"d_{prefix}_log_p90": 0.9}
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence(prefix),
        F.avg(logged).alias(f"d_{prefix}_log_mean"),
        F.stddev_pop("v").alias(f"d_{prefix}_std"),
        share(F.col("v") <= 0).alias(f"d_{prefix}_zero_share"),
        *(per_bucket(logged, F.avg, f"{prefix}_log_mean") if with_buckets else []),
    )
    return [base, exact_quantiles(rows, DAY_KEYS, logged, ranks)]


def pedometer_parts(df: DataFrame) -> Parts:
    wanted = ["step", "distance", "speed", "burned_calories"]
    rows = prepare_events(df.select("subject_id", "timestamp", *wanted))
    rows = rows.select(
        *DAY_KEYS, "timestamp", "hour_bucket",
        *[F.coalesce(to_number(c), F.lit(0.0)).alias(c) for c in wanted],
    )
    active = (F.col("step") > 0) | (F.col("distance") > 0) | (F.col("speed") > 0)
    ranks = {"d_wpedo_speed_p90": 0.9}
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("wpedo"),
        F.sum("step").alias("d_wpedo_step_sum"),
        F.sum(active.cast("double")).alias("d_wpedo_active_min"),
        F.sum("distance").alias("d_wpedo_distance_sum"),
        F.avg(F.when(active, F.col("speed"))).alias("d_wpedo_speed_mean_active"),
        F.sum("burned_calories").alias("d_wpedo_calories_sum"),
        *per_bucket(F.col("step"), F.sum, "wpedo_step_sum"),
    )
    return [base, exact_quantiles(rows, DAY_KEYS, F.col("speed"), ranks)]


def heart_rate_parts(df: DataFrame) -> Parts:
    rows = prepare_events(df.select("subject_id", "timestamp", "heart_rate"))
    samples = A.numbers(A.or_empty(F.col("heart_rate"), "array<double>"))
    rows = rows.withColumn("samples", samples)
    rows = rows.select(
        *DAY_KEYS, "timestamp", "hour_bucket",
        *[c.alias(n) for n, c in A.heart_rate_stats(F.col("samples")).items()],
    )
    ranks = {"d_whr_rest_q10": 0.1}
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("whr"),
        F.avg("hr_mean").alias("d_whr_mean"),
        F.stddev_pop("hr_mean").alias("d_whr_std"),
        F.min("hr_min").alias("d_whr_min"),
        F.max("hr_max").alias("d_whr_max"),
        F.sum("hr_count").alias("d_whr_valid_sample_cnt"),
        *per_bucket(F.col("hr_mean"), F.avg, "whr_mean"),
    )
    return [base, exact_quantiles(rows, DAY_KEYS, F.col("hr_mean"), ranks)]


def gps_points(df: DataFrame) -> DataFrame:
    """One row per scan: point count, speed mean/max, latitude and longitude mean and range."""
    points = F.col("m_gps")
    staged = df.select(
        *[c for c in df.columns if c != "m_gps"],
        A.item_count(points).alias("point_cnt"),
        *[A.numbers(points, field).alias(f"__{field}") for field in ("speed", "latitude", "longitude")],
    )
    out = {"speed_mean": A.average(F.col("__speed")), "speed_max": F.array_max("__speed")}
    for short, field in (("lat", "__latitude"), ("lon", "__longitude")):
        out[f"{short}_mean"] = A.average(F.col(field))
        out[f"{short}_min"] = F.array_min(field)
        out[f"{short}_max"] = F.array_max(field)
    return staged.select(
        *[c for c in staged.columns if not c.startswith("__")], *[c.alias(n) for n, c in out.items()]
    )


def gps_parts(df: DataFrame) -> Parts:
    rows = gps_points(prepare_events(df.select("subject_id", "timestamp", "m_gps")))
    height = F.max("lat_max") - F.min("lat_min")
    width = F.max("lon_max") - F.min("lon_min")
    ranks = {"d_mgps_speed_p90": 0.9}
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("mgps"),
        F.avg("speed_mean").alias("d_mgps_speed_mean"),
        F.max("speed_max").alias("d_mgps_speed_max"),
        share(F.col("speed_mean") < 0.5).alias("d_mgps_stationary_share"),
        F.sum("point_cnt").alias("d_mgps_point_cnt"),
        F.sqrt(height * height + width * width).alias("d_mgps_extent"),
        *per_bucket(F.col("speed_mean"), F.avg, "mgps_speed_mean"),
    )
    return [base, exact_quantiles(rows, DAY_KEYS, F.col("speed_mean"), ranks)]


def _distinct_part(rows: DataFrame, items: str, outputs: dict[str, Column]) -> DataFrame:
    """Distinct non-empty nested values per day; a null value is not a device."""
    flat = rows.select(*DAY_KEYS, F.explode(items).alias("item"))
    flat = flat.select(*DAY_KEYS, *[F.nullif(v, F.lit("")).alias(n) for n, v in outputs.items()])
    return flat.groupBy(*DAY_KEYS).agg(*[F.count_distinct(n).cast("double").alias(n) for n in outputs])


def _zero_filled(names: list[str]) -> list[Column]:
    """Zeros for days whose scans are all empty; the distinct part overrides by max."""
    return [F.lit(0.0).alias(n) for n in names]


def _device_name(value: Column, null_is_text: bool) -> Column:
    """Trimmed identifier. In parity mode a null becomes the text None and counts once."""
    name = A.clean_text(value)
    return F.when(value.isNull(), F.lit("None")).otherwise(name) if null_is_text else name


def _scan_rows(df: DataFrame, column: str) -> DataFrame:
    rows = prepare_events(df.select("subject_id", "timestamp", column))
    rows = rows.withColumn("__rssi", A.numbers(F.col(column), "rssi"))
    return rows.select(
        *DAY_KEYS, "timestamp", "hour_bucket", column,
        A.item_count(F.col(column)).alias("items"),
        A.average(F.col("__rssi")).alias("rssi_mean"),
        F.array_max("__rssi").alias("rssi_max"),
    )


def wifi_parts(df: DataFrame, null_is_text: bool = False) -> Parts:
    rows = _scan_rows(df, "m_wifi")
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("mwifi"),
        F.count("*").cast("double").alias("d_mwifi_scan_cnt"),
        F.avg("items").alias("d_mwifi_ap_cnt_mean"),
        F.avg("rssi_mean").alias("d_mwifi_rssi_mean"),
        F.avg("rssi_max").alias("d_mwifi_max_rssi_mean"),
        *_zero_filled(["d_mwifi_unique_bssid_cnt"]),
    )
    bssid = _device_name(F.col("item.bssid"), null_is_text)
    return [base, _distinct_part(rows, "m_wifi", {"d_mwifi_unique_bssid_cnt": bssid})]


def ble_parts(df: DataFrame, null_is_text: bool = False) -> Parts:
    rows = _scan_rows(df, "m_ble")
    distinct = {
        "d_mble_unique_addr_cnt": _device_name(F.col("item.address"), null_is_text),
        "d_mble_class_cnt": _device_name(F.col("item.device_class"), null_is_text),
    }
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("mble"),
        F.count("*").cast("double").alias("d_mble_scan_cnt"),
        share(F.col("items") == 0).alias("d_mble_empty_scan_share"),
        F.avg("items").alias("d_mble_dev_cnt_mean"),
        F.avg("rssi_mean").alias("d_mble_rssi_mean"),
        F.avg("rssi_max").alias("d_mble_max_rssi_mean"),
        *_zero_filled(list(distinct)),
    )
    return [base, _distinct_part(rows, "m_ble", distinct)]


def usage_snapshots(df: DataFrame) -> DataFrame:
    """One row per snapshot: app count, log of summed and largest time, dominant app."""
    items = F.col("m_usage_stats")
    staged = df.withColumn("__times", A.numbers(items, "total_time"))
    filled = F.size("__times") > 0
    return staged.select(
        *[c for c in staged.columns if not c.startswith("__")],
        A.item_count(items).alias("apps"),
        F.when(filled, F.log1p(A.total(F.col("__times")))).alias("log_sum"),
        F.when(filled, F.log1p(F.array_max("__times"))).alias("log_max"),
        F.coalesce(A.dominant_app(items), F.lit("")).alias("top_app"),
    )


def usage_parts(df: DataFrame) -> Parts:
    rows = usage_snapshots(prepare_events(df.select("subject_id", "timestamp", "m_usage_stats")))
    ranks = {"d_muse_sum_log_total_time_p90": 0.9}
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("muse"),
        F.count("*").cast("double").alias("d_muse_snap_cnt"),
        F.avg("apps").alias("d_muse_app_cnt_mean"),
        F.avg("log_sum").alias("d_muse_sum_log_total_time_mean"),
        F.avg("log_max").alias("d_muse_max_log_total_time_mean"),
        *_zero_filled(["d_muse_unique_app_cnt"]),
    )
    per_app = rows.groupBy(*DAY_KEYS, "top_app").agg(F.count("*").alias("n"))
    top = per_app.groupBy(*DAY_KEYS).agg((F.max("n") / F.sum("n")).alias("d_muse_top1_app_share"))
    apps = _distinct_part(rows, "m_usage_stats", {"d_muse_unique_app_cnt": A.clean_app(F.col("item.app_name"))})
    return [base, top, apps, exact_quantiles(rows, DAY_KEYS, F.col("log_sum"), ranks)]


def ambience_tops(df: DataFrame) -> DataFrame:
    """One row per clip: label of the first pair, first parseable score, score entropy."""
    pairs = A.ambience_pairs(A.or_empty(F.col("m_ambience"), "array<array<string>>"))
    staged = df.withColumn("__pairs", pairs)
    staged = staged.withColumn(
        "__scores", F.filter(F.transform("__pairs", lambda p: to_number(p[1])), lambda x: x.isNotNull())
    )
    return staged.select(
        *[c for c in staged.columns if not c.startswith("__")],
        F.coalesce(F.try_element_at("__pairs", F.lit(1))[0], F.lit("")).alias("top1_label"),
        F.try_element_at("__scores", F.lit(1)).alias("top1_score"),
        A.entropy(F.col("__scores")).alias("entropy"),
    )


def ambience_parts(df: DataFrame) -> Parts:
    rows = ambience_tops(prepare_events(df.select("subject_id", "timestamp", "m_ambience")))
    base = rows.groupBy(*DAY_KEYS).agg(
        *presence("mamb"),
        F.avg("top1_score").alias("d_mamb_top1_conf_mean"),
        F.avg("entropy").alias("d_mamb_entropy_mean"),
        *[
            F.avg(contains_any("top1_label", words)).alias(f"d_mamb_{name}_top1_share")
            for name, words in AMBIENCE_KEYWORDS.items()
        ],
    )
    labels = rows.groupBy(*DAY_KEYS).agg(
        F.count_distinct("top1_label").cast("double").alias("d_mamb_unique_top1_cnt")
    )
    return [base, labels]


DAY_SUMMARIES: dict[str, Callable[..., Parts]] = {
    "mac": charging_parts,
    "mscreen": screen_parts,
    "mact": activity_parts,
    "mlight": partial(light_parts, column="m_light", prefix="mlight", with_buckets=True),
    "wlight": partial(light_parts, column="w_light", prefix="wlight", with_buckets=False),
    "wpedo": pedometer_parts,
    "whr": heart_rate_parts,
    "mgps": gps_parts,
    "mwifi": wifi_parts,
    "mble": ble_parts,
    "muse": usage_parts,
    "mamb": ambience_parts,
}


def day_summary(modality: str, df: DataFrame) -> DataFrame:
    """Day summary of one sensor log."""
    return merge_parts(DAY_SUMMARIES[modality](df))


def summary_parts(sensors: dict[str, DataFrame]) -> Parts:
    """Parts of all sensors."""
    return [part for m, df in sensors.items() for part in DAY_SUMMARIES[m](df)]
