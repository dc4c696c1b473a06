"""Day and night summaries with run, quantile and nested-array oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import DAYSPEC, columns, cte, query
from dayfold.functions import arrays as A
from dayfold.operators import daily as D
from dayfold.operators import night as N
from dayfold.operators import quantiles as Q
from dayfold.schema import ACTIVITY_CODES, BUCKETS, DAY_KEYS, NIGHT_ACTIVITY_CODES
from dayfold.sources import adapters as S
import catalog.inputs  # noqa: F401

NIGHTSPEC = "subject_id:s sleep_date:t"


def presence_sql(p: str) -> str:
    return (f"count(*) AS d_{p}_row_cnt, count(DISTINCT h) / 24.0::DOUBLE AS d_{p}_coverage_ratio, "
            f"count(DISTINCT bucket) AS d_{p}_bucket_present_cnt")


def presence_names(p: str) -> list[str]:
    return [f"d_{p}_row_cnt", f"d_{p}_coverage_ratio", f"d_{p}_bucket_present_cnt"]


def bucket_sql(fn: str, value: str, name: str) -> str:
    return ", ".join(f"{fn}({value}) FILTER (bucket = '{b}') AS tb_{b}_{name}" for b in BUCKETS)


def bucket_names(name: str) -> list[str]:
    return [f"tb_{b}_{name}" for b in BUCKETS]


def runs_sql(source: str, flag: str, keys: str, order: str, episodes: str, longest: str) -> str:
    """Gaps and islands over whole groups: the plain form of the sliced operator."""
    return f"""
SELECT {keys}, sum(CASE WHEN active = 1 THEN 1 ELSE 0 END) AS {episodes},
  max(CASE WHEN active = 1 THEN len ELSE 0 END) AS {longest}
FROM (SELECT {keys}, island, any_value(active) AS active, count(*) AS len FROM (
  SELECT *, sum(CASE WHEN active = prev THEN 0 ELSE 1 END) OVER (PARTITION BY {keys} ORDER BY {order}
    ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(active) OVER (PARTITION BY {keys} ORDER BY {order}) AS prev
        FROM (SELECT *, {flag} AS active FROM {source}) t0) t1) t2 GROUP BY {keys}, island) t3
GROUP BY {keys}"""


def on_off(name: str, source: str, column: str, prefix: str, total: str, share: str, episodes: str,
           longest: str, bucket: str, ops: str, parts) -> None:
    flag = f"CAST(coalesce({column}, 0) > 0 AS INTEGER)"
    names = [*presence_names(prefix), total, share, episodes, longest, *bucket_names(bucket)]
    query(name, ops, f"{DAYSPEC} {columns('d', names)}", source, f"""
SELECT b.subject_id, b.day AS lifelog_date, b.* EXCLUDE (subject_id, day), r.* EXCLUDE (subject_id, day)
FROM (SELECT subject_id, day, {presence_sql(prefix)}, sum({flag}) AS {total}, avg({flag}) AS {share},
        {bucket_sql('avg', flag, bucket)}
      FROM {source} GROUP BY subject_id, day) b
JOIN ({runs_sql(source, flag, 'subject_id, day', 'ts, active', episodes, longest)}) r
  ON b.subject_id = r.subject_id AND b.day = r.day""")(
        lambda spark, folder: D.merge_parts(parts(S.sensor_logs(spark, folder)[prefix])))


on_off("day_screen", "s_mscreen", "m_screen_use", "mscreen", "d_mscreen_on_min", "d_mscreen_on_share",
       "d_mscreen_session_cnt", "d_mscreen_longest_session_min", "mscreen_on_share",
       "AGG-4 AGG-1 AGG-2 WIN-1 PRJ-1 PRJ-2", D.screen_parts)
on_off("day_charging", "s_mac", "m_charging", "mac", "d_mac_charge_min", "d_mac_charge_share",
       "d_mac_charge_episode_cnt", "d_mac_longest_charge_min", "mac_charge_share",
       "AGG-3 AGG-1 AGG-2 WIN-1", D.charging_parts)

_code_names = [f"d_mact_code{c}_share" for c in ACTIVITY_CODES]
_code_sql = ", ".join(f"avg(CASE WHEN code = {c} THEN 1 ELSE 0 END) AS d_mact_code{c}_share" for c in ACTIVITY_CODES)
_mass = " + ".join(_code_names)
_terms = " + ".join(
    f"CASE WHEN {n} > 0 THEN -({n} / ({_mass})) * ln({n} / ({_mass})) ELSE 0 END" for n in _code_names)


@query("day_activity", "AGG-5 ARR-7 WIN-2 AGG-1",
       f"{DAYSPEC} {columns('d', [*presence_names('mact'), *_code_names, 'd_mact_entropy', 'd_mact_transition_cnt'])}",
       "s_mact", f"""
SELECT b.subject_id, b.day AS lifelog_date, b.* EXCLUDE (subject_id, day),
  CASE WHEN {_mass} <= 0 THEN 0 ELSE {_terms} END AS d_mact_entropy, t.d_mact_transition_cnt
FROM (SELECT subject_id, day, {presence_sql('mact')}, {_code_sql}
      FROM (SELECT *, coalesce(m_activity, -1) AS code FROM s_mact) s GROUP BY subject_id, day) b
JOIN (SELECT subject_id, day, sum(CASE WHEN code <> prev THEN 1 ELSE 0 END) AS d_mact_transition_cnt
      FROM (SELECT *, lag(code) OVER (PARTITION BY subject_id, day ORDER BY ts, code) AS prev
            FROM (SELECT *, coalesce(m_activity, -1) AS code FROM s_mact) s0) s1 GROUP BY subject_id, day) t
  ON b.subject_id = t.subject_id AND b.day = t.day""")
def day_activity(spark, folder):
    return D.day_summary("mact", S.sensor_logs(spark, folder)["mact"])


def light(name: str, source: str, column: str, prefix: str, buckets: bool) -> None:
    stats = [f"d_{prefix}_log_mean", f"d_{prefix}_log_p90", f"d_{prefix}_std", f"d_{prefix}_zero_share"]
    logged = "ln(1 + greatest(v, 0))"
    extra = ", " + bucket_sql("avg", logged, f"{prefix}_log_mean") if buckets else ""
    names = [*presence_names(prefix), *stats, *(bucket_names(f"{prefix}_log_mean") if buckets else [])]
    query(name, "AGG-6 AGG-14 PRJ-6", f"{DAYSPEC} {columns('d', names)}", source, f"""
SELECT subject_id, day AS lifelog_date, {presence_sql(prefix)}, avg({logged}) AS {stats[0]},
  quantile_cont({logged}, 0.9) AS {stats[1]}, stddev_pop(v) AS {stats[2]},
  avg(CASE WHEN v <= 0 THEN 1 ELSE 0 END) AS {stats[3]}{extra}
FROM (SELECT *, coalesce({column}, 0) AS v FROM {source}) s GROUP BY subject_id, day""")(
        lambda spark, folder: D.day_summary(prefix, S.sensor_logs(spark, folder)[prefix]))


light("day_phone_light", "s_mlight", "m_light", "mlight", True)
light("day_watch_light", "s_wlight", "w_light", "wlight", False)

_pedo = ["d_wpedo_step_sum", "d_wpedo_active_min", "d_wpedo_distance_sum", "d_wpedo_speed_mean_active",
         "d_wpedo_speed_p90", "d_wpedo_calories_sum"]


@query("day_pedometer", "AGG-7 AGG-2 AGG-14",
       f"{DAYSPEC} {columns('d', [*presence_names('wpedo'), *_pedo, *bucket_names('wpedo_step_sum')])}", "s_wpedo", f"""
SELECT subject_id, day AS lifelog_date, {presence_sql('wpedo')}, sum(st) AS d_wpedo_step_sum,
  sum(CASE WHEN st > 0 OR di > 0 OR sp > 0 THEN 1 ELSE 0 END) AS d_wpedo_active_min, sum(di) AS d_wpedo_distance_sum,
  avg(sp) FILTER (st > 0 OR di > 0 OR sp > 0) AS d_wpedo_speed_mean_active,
  quantile_cont(sp, 0.9) AS d_wpedo_speed_p90, sum(ca) AS d_wpedo_calories_sum,
  {bucket_sql('sum', 'st', 'wpedo_step_sum')}
FROM (SELECT *, coalesce(step, 0) AS st, coalesce(distance, 0) AS di, coalesce(speed, 0) AS sp,
        coalesce(burned_calories, 0) AS ca FROM s_wpedo) s GROUP BY subject_id, day""")
def day_pedometer(spark, folder):
    return D.day_summary("wpedo", S.sensor_logs(spark, folder)["wpedo"])


cte("hr_rows", "s_whr", """
SELECT r.*, s.hr_mean, s.hr_min, s.hr_max, s.hr_std, coalesce(s.hr_count, 0) AS hr_count FROM s_whr r LEFT JOIN (
  SELECT event_id, avg(x) AS hr_mean, min(x) AS hr_min, max(x) AS hr_max, stddev_pop(x) AS hr_std, count(*) AS hr_count
  FROM (SELECT event_id, unnest(heart_rate) AS x FROM s_whr) u WHERE NOT isnan(x) GROUP BY event_id) s
ON r.event_id = s.event_id""")
_hr = ["d_whr_mean", "d_whr_std", "d_whr_min", "d_whr_max", "d_whr_rest_q10", "d_whr_valid_sample_cnt"]


@query("day_heart_rate", "AGG-8 ARR-1 AGG-14",
       f"{DAYSPEC} {columns('d', [*presence_names('whr'), *_hr, *bucket_names('whr_mean')])}", "hr_rows", f"""
SELECT subject_id, day AS lifelog_date, {presence_sql('whr')}, avg(hr_mean) AS d_whr_mean,
  stddev_pop(hr_mean) AS d_whr_std, min(hr_min) AS d_whr_min, max(hr_max) AS d_whr_max,
  quantile_cont(hr_mean, 0.1) AS d_whr_rest_q10, sum(hr_count) AS d_whr_valid_sample_cnt,
  {bucket_sql('avg', 'hr_mean', 'whr_mean')}
FROM hr_rows GROUP BY subject_id, day""")
def day_heart_rate(spark, folder):
    return D.day_summary("whr", S.sensor_logs(spark, folder)["whr"])


@query("heart_rate_array", "ARR-1", "hr_mean:d hr_min:d hr_max:d hr_std:d hr_count:i rows:i", "hr_rows", """
SELECT hr_mean, hr_min, hr_max, hr_std, hr_count, count(*) AS rows
FROM (SELECT round(hr_mean, 4) AS hr_mean, round(hr_min, 4) AS hr_min, round(hr_max, 4) AS hr_max,
        round(hr_std, 4) AS hr_std, hr_count FROM hr_rows) s GROUP BY ALL""")
def heart_rate_array(spark, folder):
    df = S.sensor_logs(spark, folder)["whr"]
    samples = df.select(A.numbers(A.or_empty(F.col("heart_rate"), "array<double>")).alias("x"))
    stats = A.heart_rate_stats(F.col("x"))
    rows = samples.select(*[(F.round(c, 4) if n != "hr_count" else c).alias(n) for n, c in stats.items()])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))


cte("gps_rows", "s_mgps", """
SELECT r.*, coalesce(len(r.m_gps), 0) AS point_cnt, s.* EXCLUDE (event_id) FROM s_mgps r LEFT JOIN (
  SELECT event_id, avg(p.speed) AS speed_mean, max(p.speed) AS speed_max, min(p.latitude) AS lat_min,
    max(p.latitude) AS lat_max, min(p.longitude) AS lon_min, max(p.longitude) AS lon_max,
    avg(p.latitude) AS lat_mean, avg(p.longitude) AS lon_mean
  FROM (SELECT event_id, unnest(m_gps) AS p FROM s_mgps) u GROUP BY event_id) s ON r.event_id = s.event_id""")
_gps = ["d_mgps_speed_mean", "d_mgps_speed_p90", "d_mgps_speed_max", "d_mgps_stationary_share", "d_mgps_point_cnt",
        "d_mgps_extent"]


@query("day_gps", "AGG-9 ARR-2 AGG-14",
       f"{DAYSPEC} {columns('d', [*presence_names('mgps'), *_gps, *bucket_names('mgps_speed_mean')])}", "gps_rows", f"""
SELECT subject_id, day AS lifelog_date, {presence_sql('mgps')}, avg(speed_mean) AS d_mgps_speed_mean,
  quantile_cont(speed_mean, 0.9) AS d_mgps_speed_p90, max(speed_max) AS d_mgps_speed_max,
  avg(CASE WHEN speed_mean < 0.5 THEN 1 ELSE 0 END) AS d_mgps_stationary_share, sum(point_cnt) AS d_mgps_point_cnt,
  sqrt(pow(max(lat_max) - min(lat_min), 2) + pow(max(lon_max) - min(lon_min), 2)) AS d_mgps_extent,
  {bucket_sql('avg', 'speed_mean', 'mgps_speed_mean')}
FROM gps_rows GROUP BY subject_id, day""")
def day_gps(spark, folder):
    return D.day_summary("mgps", S.sensor_logs(spark, folder)["mgps"])


@query("gps_points", "ARR-2",
       f"{DAYSPEC} lat_mean:d lon_mean:d lat_span:d lon_span:d points:d", "gps_rows", """
SELECT subject_id, day AS lifelog_date, avg(lat_mean) AS lat_mean, avg(lon_mean) AS lon_mean,
  avg(lat_max - lat_min) AS lat_span, avg(lon_max - lon_min) AS lon_span, sum(point_cnt) AS points
FROM gps_rows GROUP BY subject_id, day""")
def gps_points(spark, folder):
    rows = D.gps_points(D.prepare_events(S.sensor_logs(spark, folder)["mgps"]))
    return rows.groupBy(*DAY_KEYS).agg(
        F.avg("lat_mean").alias("lat_mean"), F.avg("lon_mean").alias("lon_mean"),
        F.avg(F.col("lat_max") - F.col("lat_min")).alias("lat_span"),
        F.avg(F.col("lon_max") - F.col("lon_min")).alias("lon_span"), F.sum("point_cnt").alias("points"))


def _scan_sql(source: str, column: str) -> str:
    return f"""SELECT r.*, coalesce(len(r.{column}), 0) AS items, s.rssi_mean, s.rssi_max FROM {source} r LEFT JOIN (
  SELECT event_id, avg(p.rssi) AS rssi_mean, max(p.rssi) AS rssi_max
  FROM (SELECT event_id, unnest({column}) AS p FROM {source}) u GROUP BY event_id) s ON r.event_id = s.event_id"""


cte("wifi_rows", "s_mwifi", _scan_sql("s_mwifi", "m_wifi"))
cte("ble_rows", "s_mble", _scan_sql("s_mble", "m_ble"))
_wifi = ["d_mwifi_scan_cnt", "d_mwifi_ap_cnt_mean", "d_mwifi_unique_bssid_cnt", "d_mwifi_rssi_mean",
         "d_mwifi_max_rssi_mean"]


def _wifi_sql(name: str) -> str:
    return f"""
SELECT b.subject_id, b.day AS lifelog_date, b.* EXCLUDE (subject_id, day),
  coalesce(u.n, 0) AS d_mwifi_unique_bssid_cnt
FROM (SELECT subject_id, day, {presence_sql('mwifi')}, count(*) AS d_mwifi_scan_cnt, avg(items) AS d_mwifi_ap_cnt_mean,
        avg(rssi_mean) AS d_mwifi_rssi_mean, avg(rssi_max) AS d_mwifi_max_rssi_mean
      FROM wifi_rows GROUP BY subject_id, day) b
LEFT JOIN (SELECT subject_id, day, count(DISTINCT nullif({name}, '')) AS n
      FROM (SELECT subject_id, day, unnest(m_wifi) AS p FROM s_mwifi) x GROUP BY subject_id, day) u
  ON b.subject_id = u.subject_id AND b.day = u.day"""


_wifi_spec = f"{DAYSPEC} {columns('d', [*presence_names('mwifi'), *_wifi])}"


@query("day_wifi", "AGG-10 ARR-3", _wifi_spec, "wifi_rows", _wifi_sql("trim(p.bssid)"))
def day_wifi(spark, folder):
    return D.day_summary("mwifi", S.sensor_logs(spark, folder)["mwifi"])


@query("day_wifi_null_as_text", "AGG-10 ARR-3", _wifi_spec, "wifi_rows", _wifi_sql("coalesce(trim(p.bssid), 'None')"))
def day_wifi_null_as_text(spark, folder):
    return D.merge_parts(D.wifi_parts(S.sensor_logs(spark, folder)["mwifi"], null_is_text=True))


_ble = ["d_mble_scan_cnt", "d_mble_empty_scan_share", "d_mble_dev_cnt_mean", "d_mble_unique_addr_cnt",
        "d_mble_class_cnt", "d_mble_rssi_mean", "d_mble_max_rssi_mean"]


@query("day_bluetooth", "AGG-11 ARR-4", f"{DAYSPEC} {columns('d', [*presence_names('mble'), *_ble])}", "ble_rows", f"""
SELECT b.subject_id, b.day AS lifelog_date, b.* EXCLUDE (subject_id, day),
  coalesce(u.a, 0) AS d_mble_unique_addr_cnt, coalesce(u.c, 0) AS d_mble_class_cnt
FROM (SELECT subject_id, day, {presence_sql('mble')}, count(*) AS d_mble_scan_cnt,
        avg(CASE WHEN items = 0 THEN 1 ELSE 0 END) AS d_mble_empty_scan_share, avg(items) AS d_mble_dev_cnt_mean,
        avg(rssi_mean) AS d_mble_rssi_mean, avg(rssi_max) AS d_mble_max_rssi_mean
      FROM ble_rows GROUP BY subject_id, day) b
LEFT JOIN (SELECT subject_id, day, count(DISTINCT nullif(trim(p.address), '')) AS a,
        count(DISTINCT nullif(trim(p.device_class), '')) AS c
      FROM (SELECT subject_id, day, unnest(m_ble) AS p FROM s_mble) x GROUP BY subject_id, day) u
  ON b.subject_id = u.subject_id AND b.day = u.day""")
def day_bluetooth(spark, folder):
    return D.day_summary("mble", S.sensor_logs(spark, folder)["mble"])


cte("use_items", "s_muse", """
SELECT event_id, subject_id, day, pos, trim(m_usage_stats[pos].app_name) AS app, m_usage_stats[pos].total_time AS t
FROM (SELECT *, unnest(range(1, len(m_usage_stats) + 1)) AS pos FROM s_muse) u""")
cte("use_rows", "use_items", """
SELECT r.*, coalesce(len(r.m_usage_stats), 0) AS apps, s.log_sum, s.log_max, coalesce(s.top_app, '') AS top_app
FROM s_muse r LEFT JOIN (
  SELECT event_id, ln(1 + sum(t)) AS log_sum, ln(1 + max(t)) AS log_max,
    arg_min(app, pos) FILTER (t = m) AS top_app
  FROM (SELECT *, max(t) OVER (PARTITION BY event_id) AS m FROM use_items) i GROUP BY event_id) s
ON r.event_id = s.event_id""")
_use = ["d_muse_snap_cnt", "d_muse_app_cnt_mean", "d_muse_unique_app_cnt", "d_muse_top1_app_share",
        "d_muse_sum_log_total_time_mean", "d_muse_sum_log_total_time_p90", "d_muse_max_log_total_time_mean"]


@query("day_app_usage", "AGG-12 ARR-5", f"{DAYSPEC} {columns('d', [*presence_names('muse'), *_use])}", "use_rows", f"""
SELECT b.subject_id, b.day AS lifelog_date, b.* EXCLUDE (subject_id, day), coalesce(u.n, 0) AS d_muse_unique_app_cnt,
  t.top AS d_muse_top1_app_share
FROM (SELECT subject_id, day, {presence_sql('muse')}, count(*) AS d_muse_snap_cnt, avg(apps) AS d_muse_app_cnt_mean,
        avg(log_sum) AS d_muse_sum_log_total_time_mean, quantile_cont(log_sum, 0.9) AS d_muse_sum_log_total_time_p90,
        avg(log_max) AS d_muse_max_log_total_time_mean
      FROM use_rows GROUP BY subject_id, day) b
LEFT JOIN (SELECT subject_id, day, count(DISTINCT nullif(app, '')) AS n FROM use_items GROUP BY subject_id, day) u
  ON b.subject_id = u.subject_id AND b.day = u.day
JOIN (SELECT subject_id, day, max(n) / sum(n) AS top FROM (
        SELECT subject_id, day, top_app, count(*) AS n FROM use_rows GROUP BY subject_id, day, top_app) a
      GROUP BY subject_id, day) t ON b.subject_id = t.subject_id AND b.day = t.day""")
def day_app_usage(spark, folder):
    return D.day_summary("muse", S.sensor_logs(spark, folder)["muse"])


cte("amb_pairs", "s_mamb", """
SELECT event_id, pos, m_ambience[pos][1] AS label, TRY_CAST(m_ambience[pos][2] AS DOUBLE) AS score
FROM (SELECT *, unnest(range(1, len(m_ambience) + 1)) AS pos FROM s_mamb) u WHERE len(m_ambience[pos]) >= 2""")
cte("amb_rows", "amb_pairs", """
SELECT r.*, coalesce(s.top1_label, '') AS top1_label, s.top1_score,
  CASE WHEN s.n = 0 OR s.n IS NULL THEN NULL WHEN s.mass <= 0 THEN 0 ELSE s.ent END AS entropy
FROM s_mamb r LEFT JOIN (
  SELECT event_id, arg_min(label, pos) AS top1_label, arg_min(score, pos) FILTER (score IS NOT NULL) AS top1_score,
    count(score) AS n, any_value(mass) AS mass,
    sum(CASE WHEN score > 0 THEN -(score / mass) * ln(score / mass) ELSE 0 END) AS ent
  FROM (SELECT *, sum(score) OVER (PARTITION BY event_id) AS mass FROM amb_pairs) p GROUP BY event_id) s
ON r.event_id = s.event_id""")
_amb_flags = {
    "speech": "lower(top1_label) LIKE '%speech%' OR lower(top1_label) LIKE '%conversation%'",
    "music": "lower(top1_label) LIKE '%music%'",
    "vehicle": "regexp_matches(lower(top1_label), 'vehicle|engine|car|truck')",
    "silence": "lower(top1_label) LIKE '%silence%'",
    "indoor": "lower(top1_label) LIKE '%inside%'",
    "outdoor": "lower(top1_label) LIKE '%outside%'",
}
_amb = ["d_mamb_top1_conf_mean", "d_mamb_entropy_mean", "d_mamb_unique_top1_cnt",
        *[f"d_mamb_{n}_top1_share" for n in _amb_flags]]


@query("day_ambience", "AGG-13 ARR-6 ARR-7 PRJ-3 PRJ-11",
       f"{DAYSPEC} {columns('d', [*presence_names('mamb'), *_amb])}", "amb_rows", f"""
SELECT subject_id, day AS lifelog_date, {presence_sql('mamb')}, avg(top1_score) AS d_mamb_top1_conf_mean,
  avg(entropy) AS d_mamb_entropy_mean, count(DISTINCT top1_label) AS d_mamb_unique_top1_cnt,
  {", ".join(f"avg(CASE WHEN {c} THEN 1 ELSE 0 END) AS d_mamb_{n}_top1_share" for n, c in _amb_flags.items())}
FROM amb_rows GROUP BY subject_id, day""")
def day_ambience(spark, folder):
    return D.day_summary("mamb", S.sensor_logs(spark, folder)["mamb"])


# ---- quantiles over a hot group ------------------------------------------------

_q = {"q10": 0.1, "median": 0.5, "q90": 0.9}


@query("hot_group_quantiles", "AGG-14 AGG-15", "l_returnflag:s q10:d median:d q90:d", "", """
SELECT l_returnflag, quantile_cont(l_extendedprice, 0.1) AS q10, quantile_cont(l_extendedprice, 0.5) AS median,
  quantile_cont(l_extendedprice, 0.9) AS q90 FROM lineitem GROUP BY l_returnflag""")
def hot_group_quantiles(spark, folder):
    df = S.table(spark, folder, "lineitem")
    return Q.exact_quantiles(df, ["l_returnflag"], F.col("l_extendedprice"), _q)


# ---- nights --------------------------------------------------------------------

cte("night_samples", "s_whr", """
SELECT subject_id, day, ts, pos, heart_rate[pos] AS x
FROM (SELECT *, unnest(range(1, len(heart_rate) + 1)) AS pos FROM s_whr WHERE h < 9) u
WHERE heart_rate[pos] > 0 AND isfinite(heart_rate[pos])""")
_seven = ["mean", "std", "min", "max", "median", "q10", "q90"]


def seven_sql(value: str, prefix: str) -> str:
    return (f"avg({value}) AS {prefix}_mean, stddev_pop({value}) AS {prefix}_std, min({value}) AS {prefix}_min, "
            f"max({value}) AS {prefix}_max, quantile_cont({value}, 0.5) AS {prefix}_median, "
            f"quantile_cont({value}, 0.1) AS {prefix}_q10, quantile_cont({value}, 0.9) AS {prefix}_q90")


_nhr = ["s_hr_hour_coverage", "s_hr_rmssd", "s_hr_spike_share", *[f"s_hr_{s}" for s in _seven]]


@query("night_heart_rate", "ARR-8 AGG-15 PRJ-24", f"{NIGHTSPEC} s_hr_sample_cnt:i {columns('d', _nhr)}",
       "night_samples", f"""
SELECT b.subject_id, b.day AS sleep_date, coalesce(s.n, 0) AS s_hr_sample_cnt, b.cover AS s_hr_hour_coverage,
  s.* EXCLUDE (subject_id, day, n)
FROM (SELECT subject_id, day, count(DISTINCT h) / 9.0::DOUBLE AS cover FROM s_whr WHERE h < 9
      GROUP BY subject_id, day) b
LEFT JOIN (SELECT subject_id, day, count(*) AS n, {seven_sql('x', 's_hr')}, sqrt(avg(d * d)) AS s_hr_rmssd,
        avg(CASE WHEN d IS NULL THEN NULL WHEN abs(d) >= 10 THEN 1 ELSE 0 END) AS s_hr_spike_share
      FROM (SELECT *, x - lag(x) OVER (PARTITION BY subject_id, day ORDER BY ts, pos) AS d FROM night_samples) z
      GROUP BY subject_id, day) s ON b.subject_id = s.subject_id AND b.day = s.day""")
def night_heart_rate(spark, folder):
    return N.night_heart_rate(S.sensor_logs(spark, folder)["whr"])


_nped = ["s_pedo_step_sum", "s_pedo_distance_sum", "s_pedo_calories_sum", "s_pedo_speed_mean", "s_pedo_speed_p90",
         "s_pedo_zero_step_share"]


@query("night_pedometer", "AGG-16 PRJ-24",
       f"{NIGHTSPEC} s_pedo_row_cnt:i s_pedo_active_min:i {columns('d', _nped)}", "s_wpedo", """
SELECT subject_id, day AS sleep_date, count(*) AS s_pedo_row_cnt, count(*) FILTER (step > 0) AS s_pedo_active_min,
  coalesce(sum(step), 0) AS s_pedo_step_sum, coalesce(sum(distance), 0) AS s_pedo_distance_sum,
  coalesce(sum(burned_calories), 0) AS s_pedo_calories_sum, avg(speed) AS s_pedo_speed_mean,
  quantile_cont(speed, 0.9) AS s_pedo_speed_p90, avg(CASE WHEN step <= 0 THEN 1 ELSE 0 END) AS s_pedo_zero_step_share
FROM s_wpedo WHERE h < 9 GROUP BY subject_id, day""")
def night_pedometer(spark, folder):
    return N.night_pedometer(S.sensor_logs(spark, folder)["wpedo"])


_nact = ["s_act_active_ratio", "s_act_still_ratio", *[f"s_act_code{c}_share" for c in NIGHT_ACTIVITY_CODES]]


@query("night_activity", "AGG-17 PRJ-24", f"{NIGHTSPEC} s_act_row_cnt:i {columns('d', _nact)}", "s_mact", f"""
SELECT subject_id, day AS sleep_date, count(*) AS s_act_row_cnt,
  avg(CASE WHEN m_activity IN (3, 7, 8) THEN 1 ELSE 0 END) AS s_act_active_ratio,
  avg(CASE WHEN m_activity = 0 THEN 1 ELSE 0 END) AS s_act_still_ratio,
  {", ".join(f"avg(CASE WHEN m_activity = {c} THEN 1 ELSE 0 END) AS s_act_code{c}_share" for c in NIGHT_ACTIVITY_CODES)}
FROM s_mact WHERE h < 9 GROUP BY subject_id, day""")
def night_activity(spark, folder):
    return N.night_activity(S.sensor_logs(spark, folder)["mact"])


cte("night_screen_rows", "s_mscreen", """
SELECT *, CAST(coalesce(m_screen_use, 0) > 0 AS INTEGER) AS active0 FROM s_mscreen WHERE h < 9""")


@query("night_screen", "AGG-18 WIN-1 PRJ-24",
       f"{NIGHTSPEC} s_screen_row_cnt:i s_screen_on_min:i s_screen_on_share:d s_screen_session_cnt:i "
       "s_screen_longest_on_min:i", "night_screen_rows", f"""
SELECT b.subject_id, b.day AS sleep_date, b.* EXCLUDE (subject_id, day), r.* EXCLUDE (subject_id, day)
FROM (SELECT subject_id, day, count(*) AS s_screen_row_cnt, sum(active0) AS s_screen_on_min,
        avg(active0) AS s_screen_on_share FROM night_screen_rows GROUP BY subject_id, day) b
JOIN ({runs_sql('night_screen_rows', 'active0', 'subject_id, day', 'ts, active', 's_screen_session_cnt',
                's_screen_longest_on_min')}) r ON b.subject_id = r.subject_id AND b.day = r.day""")
def night_screen(spark, folder):
    return N.night_screen(S.sensor_logs(spark, folder)["mscreen"])


_nlight = ["s_light_zero_share", *[f"s_light_log_{s}" for s in _seven]]


@query("night_light", "AGG-19 AGG-15 PRJ-24", f"{NIGHTSPEC} s_light_row_cnt:i {columns('d', _nlight)}", "s_mlight", f"""
SELECT subject_id, day AS sleep_date, count(m_light) AS s_light_row_cnt,
  avg(CASE WHEN m_light IS NULL THEN NULL WHEN m_light <= 0 THEN 1 ELSE 0 END) AS s_light_zero_share,
  {seven_sql('ln(1 + greatest(m_light + 0, CASE WHEN m_light IS NULL THEN NULL ELSE 0 END))', 's_light_log')}
FROM s_mlight WHERE h < 9 GROUP BY subject_id, day""")
def night_light(spark, folder):
    return N.night_light(S.sensor_logs(spark, folder)["mlight"])


@query("order_runs_by_subject_day", "WIN-1 WIN-2", "l_suppkey:i day:t episodes:d longest:d", "", """
SELECT l_suppkey, day, sum(CASE WHEN active = 1 THEN 1 ELSE 0 END) AS episodes,
  max(CASE WHEN active = 1 THEN len ELSE 0 END) AS longest
FROM (SELECT l_suppkey, day, island, any_value(active) AS active, count(*) AS len FROM (
  SELECT *, sum(CASE WHEN active = prev THEN 0 ELSE 1 END) OVER (PARTITION BY l_suppkey, day ORDER BY o, active
    ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, lag(active) OVER (PARTITION BY l_suppkey, day ORDER BY o, active) AS prev
        FROM (SELECT l_suppkey, date_trunc('month', l_shipdate)::DATE AS day, l_orderkey * 10 + l_linenumber AS o,
                CAST(l_quantity > 25 AS INTEGER) AS active FROM lineitem) t0) t1) t2 GROUP BY ALL) t3
GROUP BY l_suppkey, day""")
def order_runs_by_subject_day(spark, folder):
    from dayfold.operators.runs import run_statistics, slice_summaries
    from dayfold.session import tasks_for

    df = S.table(spark, folder, "lineitem")
    rank = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint")
    rows = df.select(
        "l_suppkey", F.trunc("l_shipdate", "month").alias("day"), rank.alias("o"),
        (F.col("l_quantity") > 25).cast("int").alias("active"))
    piece = F.floor(F.col("o") / 20_000)
    keys = ["l_suppkey", "day"]
    tasks = tasks_for(df)
    slices = slice_summaries(rows, keys, F.col("active"), [F.col("o"), F.col("active")], piece, tasks=tasks)
    return run_statistics(slices, keys, "episodes", "longest", tasks=tasks)
