"""Column contracts and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: keys, targets, buckets ---------------------------------
KEYS = ["subject_id", "sleep_date", "lifelog_date"]
DAY_KEYS = ["subject_id", "lifelog_date"]
NIGHT_KEYS = ["subject_id", "sleep_date"]
TARGETS = ["Q1", "Q2", "Q3", "S1", "S2", "S3", "S4"]
BUCKETS = ["overnight", "morning", "afternoon", "evening"]  # six hours each, from midnight
ACTIVITY_CODES = [0, 1, 3, 4, 7, 8]
NIGHT_ACTIVITY_CODES = [0, 3, 4, 7, 8]
NIGHT_ACTIVE_CODES = [3, 7, 8]
NIGHT_END_HOUR = 9
MODALITIES = [
    "mac", "mscreen", "mact", "mlight", "wlight", "wpedo",
    "whr", "mgps", "mwifi", "mble", "muse", "mamb",
]

# ---- fixed values: numeric guards -----------------------------------------
PROB_EPS = 1e-6
PROB_LOW, PROB_HIGH = 0.02, 0.98
RATIO_EPS = 1e-3
SUBJECT_SMOOTHING = 5.0

# ---- fixed values: history anchors ----------------------------------------
HISTORY_ANCHORS = [
    "d_mscreen_on_min", "d_mac_charge_min", "d_wpedo_step_sum", "d_wpedo_active_min",
    "d_whr_mean", "d_whr_rest_q10", "d_mgps_speed_mean", "d_mgps_extent",
    "d_mwifi_unique_bssid_cnt", "d_mble_unique_addr_cnt", "d_muse_unique_app_cnt",
    "d_mamb_speech_top1_share", "d_mlight_log_mean", "d_wlight_log_mean",
    "d_modal_observed_cnt", "d_modal_mean_coverage",
    "d_behavior_screen_night_day_gap", "d_behavior_charge_night_day_gap",
    "d_behavior_steps_night_day_ratio", "x_screen_charge_share", "x_steps_extent_log",
    "x_stationary_screen", "x_usage_screen_density",
]
SIGNED_ANCHORS = ["d_behavior_screen_night_day_gap", "d_behavior_charge_night_day_gap"]  # differences of shares
HABIT_ANCHORS = [
    "d_mscreen_on_min", "d_wpedo_step_sum", "d_whr_mean", "d_mac_charge_min", "d_mgps_extent",
]

# ---- fixed values: ambience keywords --------------------------------------
AMBIENCE_KEYWORDS = {
    "speech": ["speech", "conversation"],
    "music": ["music"],
    "vehicle": ["vehicle", "engine", "car", "truck"],
    "silence": ["silence"],
    "indoor": ["inside"],
    "outdoor": ["outside"],
}

# ---- fixed values: feature views ------------------------------------------
FEATURE_VIEWS = ["public_core", "public_full", "public_notebook", "public_hist365", "public_hist411"]
VIEW_PRESETS = {
    "histmix_guarded_v1": {"Q2": "public_hist411", "Q3": "public_hist365", "S4": "public_hist411"},
    "histmix_guarded_v1_tuned": {"Q2": "public_hist411", "Q3": "public_hist365", "S4": "public_hist411"},
    "histmix_q2s4_v1": {"Q2": "public_hist411", "S4": "public_hist411"},
    "histmix_q2q3_v1": {"Q2": "public_hist411", "Q3": "public_hist365"},
    "histmix_q3s4_v1": {"Q3": "public_hist365", "S4": "public_hist411"},
    "histmix_aggressive_v1": {
        "Q2": "public_hist411", "Q3": "public_hist365", "S1": "public_hist411", "S4": "public_hist411",
    },
}
ADVANCED_PATTERNS = [
    "__accel_", "__roll_skew_", "__roll_kurt_", "__weekly_autocorr", "__trend_sign_",
    "__habit_score_", "__personal_zscore", "__expanding_rank", "x_hr_per_step_log",
    "x_gps_wifi_social", "x_ble_wifi_indoor", "x_night_disruption", "x_activity_entropy_hr",
    "x_screen_session_density", "x_speech_mobility", "x_hr_rest_day_gap", "x_global_anomaly_score",
]

# ---- fixed values: search grids -------------------------------------------
SMOOTHING_GRID = [0.5, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0]
HALF_LIFE_GRID = [None, 1.0, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 34.0]
ENCODING_WINDOWS = [3, 7, 14, 21]
NEIGHBOUR_RANKS = [1, 2, 3]
NEIGHBOUR_WINDOWS = [3, 7, 14]
TARGET_KERNELS = {  # target: (kind, horizon days, power or tau)
    "Q1": ("power", 7, 3.0),
    "Q2": ("power", 5, 2.0),
    "Q3": ("power", 3, 3.0),
    "S1": ("power", 3, 3.0),
    "S2": ("exp", 21, 45.0),
    "S3": ("exp", 90, 45.0),
    "S4": ("exp", 21, 45.0),
}
TARGETWISE_PRIOR_WEIGHTS = {
    "Q1": 0.27, "Q2": 0.26, "Q3": 0.18, "S1": 0.07, "S2": 0.43, "S3": 0.57, "S4": 0.0,
}
RUN_COLUMN_SUFFIXES = ["_public_lgb", "_xgb", "_lgb", "_catboost", "_prior_v2"]
FORBIDDEN_NAME_TOKENS = [
    "s4sym", "s4near", "s4up", "s4down", "qshead", "qsmicro", "qscal", "guard003", "guard005",
]

# ---- fixed values: input contracts -------------------------------------------------------
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("subject_id", T.StringType()),
        T.StructField("sleep_date", T.DateType()),
        T.StructField("lifelog_date", T.DateType()),
    ]
    + [T.StructField(t, T.IntegerType()) for t in TARGETS]
)

SENSOR_PAYLOADS = {
    "mac": "m_charging int",
    "mscreen": "m_screen_use int",
    "mact": "m_activity int",
    "mlight": "m_light double",
    "wlight": "w_light double",
    "wpedo": "step int, step_frequency double, running_step int, walking_step int, "
             "distance double, speed double, burned_calories double",
    "whr": "heart_rate array<double>",
    "mgps": "m_gps array<struct<speed:double,latitude:double,longitude:double>>",
    "mwifi": "m_wifi array<struct<bssid:string,rssi:double>>",
    "mble": "m_ble array<struct<address:string,device_class:string,rssi:double>>",
    "muse": "m_usage_stats array<struct<app_name:string,total_time:double>>",
    "mamb": "m_ambience array<array<string>>",
}
