"""Oracle text of the logical inputs (the Spark side is dayfold.sources.adapters)."""

from __future__ import annotations

from catalog.base import cte
from dayfold.schema import KEYS, TARGETS

cte("ev", "", """
SELECT 'id' || CAST(user_id AS VARCHAR) AS subject_id, ts, event_id, event_type AS kind, value AS v,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS h,
  CASE WHEN hour(ts) < 6 THEN 'overnight' WHEN hour(ts) < 12 THEN 'morning'
       WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS bucket
FROM events""")


def sensor(name: str, kinds: str | None, payload: str) -> None:
    where = f"WHERE kind IN ({kinds})" if kinds else ""
    cte(name, "ev", f"SELECT subject_id, ts, day, h, bucket, event_id, {payload} FROM ev {where}")


sensor("s_mac", "'click','view','error'", "CASE WHEN k <> 0 THEN CAST(v > 40 AS INTEGER) END AS m_charging")
sensor("s_mscreen", "'click','purchase','signup'",
       "CASE WHEN k % 13 <> 0 THEN CAST(v > 20 AS INTEGER) END AS m_screen_use")
sensor("s_mact", None, "CASE WHEN k % 10 <> 9 THEN k % 10 END AS m_activity")
sensor("s_mlight", "'view','error'", "CASE WHEN k % 17 <> 0 THEN v - 10.0::DOUBLE END AS m_light")
sensor("s_wlight", "'signup'", "v AS w_light")
sensor("s_wpedo", "'purchase','click'", """
  CASE WHEN k % 9 = 0 THEN NULL WHEN k % 3 = 0 THEN 0 ELSE CAST(floor(v) AS INTEGER) END AS step,
  CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE v * 0.75::DOUBLE END AS distance,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 6 = 0 THEN 0.0::DOUBLE ELSE v / 13.0::DOUBLE END AS speed,
  v * 0.25::DOUBLE AS burned_calories""")
sensor("s_whr", "'signup','view'", """
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 7 = 0 THEN CAST([] AS DOUBLE[])
       ELSE [50.0::DOUBLE + v / 7.0::DOUBLE,
             CASE WHEN k % 5 = 0 THEN 'NaN'::DOUBLE ELSE 60.0::DOUBLE + k / 3.0::DOUBLE END,
             55.0::DOUBLE + v / 11.0::DOUBLE] END AS heart_rate""")
sensor("s_mgps", "'error','purchase','click'", """
  CASE WHEN k % 11 <> 0 THEN [
    {'speed': v / 130.0::DOUBLE, 'latitude': 37.0::DOUBLE + k / 300.0::DOUBLE,
     'longitude': 127.0::DOUBLE + v / 900.0::DOUBLE},
    {'speed': CASE WHEN k % 3 <> 0 THEN k / 70.0::DOUBLE END, 'latitude': 37.0::DOUBLE + v / 700.0::DOUBLE,
     'longitude': CASE WHEN k % 4 <> 0 THEN 127.0::DOUBLE + k / 900.0::DOUBLE END}] END AS m_gps""")
sensor("s_mwifi", "'view','click'", """
  CASE WHEN k % 10 <> 3 THEN [
    {'bssid': ' ap' || CAST(k % 7 AS VARCHAR) || ' ', 'rssi': -40.0::DOUBLE - v / 9.0::DOUBLE},
    {'bssid': CASE WHEN k % 6 = 0 THEN NULL WHEN k % 6 = 1 THEN '  ' ELSE 'ap' || CAST(k % 4 AS VARCHAR) END,
     'rssi': CASE WHEN k % 5 <> 0 THEN -50.0::DOUBLE - k / 7.0::DOUBLE END}] END AS m_wifi""")
sensor("s_mble", "'view','signup'", """
  CASE WHEN k % 6 <> 2 THEN [
    {'address': 'ad' || CAST(k % 9 AS VARCHAR), 'device_class': 'c' || CAST(k % 2 AS VARCHAR),
     'rssi': -60.0::DOUBLE - v / 17.0::DOUBLE},
    {'address': 'ad' || CAST(k % 5 AS VARCHAR), 'device_class': CASE WHEN k % 3 = 0 THEN '' ELSE 'c0' END,
     'rssi': CAST(NULL AS DOUBLE)}] END AS m_ble""")
sensor("s_muse", "'view','purchase'", """
  CASE WHEN k % 15 <> 4 THEN [
    {'app_name': 'app ' || CAST(k % 5 AS VARCHAR), 'total_time': v},
    {'app_name': ' app ' || CAST(k % 3 AS VARCHAR),
     'total_time': CASE WHEN k % 4 = 0 THEN v WHEN k % 9 = 0 THEN NULL ELSE k * 1.5::DOUBLE END}] END AS m_usage_stats""")
sensor("s_mamb", "'error','signup'", """
  CASE WHEN k % 12 <> 5 THEN [
    CASE WHEN k % 10 = 0 THEN ['Wind'] ELSE [
      ['Speech','Music','Card shuffling','Silence','Inside, small room','Outside, urban','Truck','Conversation'][k % 8 + 1],
      CASE WHEN k % 7 = 0 THEN 'n/a' ELSE CAST((k % 6) / 7.0::DOUBLE AS VARCHAR) END] END,
    ['Music', CAST((k % 9) / 13.0::DOUBLE AS VARCHAR)]] END AS m_ambience""")

# Labels: one row per user-day with seven targets and a split.
cte("days", "ev", """
SELECT subject_id, CAST(day + INTERVAL 1 DAY AS DATE) AS sleep_date, day AS lifelog_date,
  CAST(sum(v) > 100 AS INTEGER) AS "Q1", max(CAST(kind = 'purchase' AS INTEGER)) AS "Q2",
  CAST(count(*) FILTER (kind = 'click') > count(*) FILTER (kind = 'view') AS INTEGER) AS "Q3",
  max(CAST(h < 6 AS INTEGER)) AS "S1", max(CAST(v > 80 AS INTEGER)) AS "S2",
  CAST(count(*) >= 3 AS INTEGER) AS "S3", max(CAST(kind = 'error' AS INTEGER)) AS "S4"
FROM ev GROUP BY subject_id, day""")
cte("keyed", "days", """
SELECT subject_id, sleep_date, lifelog_date,
  CASE WHEN dayofmonth(lifelog_date) BETWEEN 11 AND 15 OR dayofmonth(lifelog_date) >= 26
       THEN 'test' ELSE 'train' END AS split, """ + ", ".join(f'"{t}" AS raw_{t}' for t in TARGETS) + """
FROM days""")
cte("keyed_labels", "keyed", "SELECT subject_id, sleep_date, lifelog_date, split, " + ", ".join(
    f"CASE WHEN split = 'train' THEN raw_{t} END AS \"{t}\"" for t in TARGETS) + " FROM keyed")
cte("long_labels", "keyed_labels", " UNION ALL ".join(
    f"SELECT subject_id, sleep_date, lifelog_date, split, '{t}' AS target, \"{t}\" AS y FROM keyed_labels"
    for t in TARGETS))
cte("doc_labels", "", """
SELECT l.doc_id, d.source, d.lang, d.n_chars, 'quality' AS target, l.quality AS y
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
UNION ALL
SELECT l.doc_id, d.source, d.lang, d.n_chars, 'toxic', l.toxic
FROM labels l JOIN documents d ON l.doc_id = d.doc_id""")
KEYLIST = ", ".join(KEYS)
