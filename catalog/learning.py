"""Folds, priors, temporal neighbours, scores and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEYSPEC, columns, cte, dbl, query
from dayfold.operators import blend as B
from dayfold.operators import folds as V
from dayfold.operators import models as M
from dayfold.operators import neighbours as NB
from dayfold.operators import priors as R
from dayfold.operators import scoring as SC
from dayfold.operators import selection as SE
from dayfold.schema import HALF_LIFE_GRID, KEYS, NEIGHBOUR_RANKS, NEIGHBOUR_WINDOWS, SMOOTHING_GRID, TARGET_KERNELS, TARGETS
from dayfold.sources import adapters as S
import catalog.tables  # noqa: F401

ROWSPEC = f"{KEYSPEC} target:s"
ON = [*KEYS, "target"]


def keyed(spark, folder, split: str | None = None):
    df = S.labelled_keys(spark, folder)
    return df if split is None else df.where(F.col("split") == split)


def labels(spark, folder, split: str | None = None):
    return S.long_labels(keyed(spark, folder, split))


cte("train_keys", "keyed_labels", "SELECT * FROM keyed_labels WHERE split = 'train'")
cte("train_labels", "long_labels", "SELECT * FROM long_labels WHERE split = 'train'")
_pos = ("row_number() OVER (PARTITION BY subject_id ORDER BY lifelog_date) - 1 AS position, "
        "count(*) OVER (PARTITION BY subject_id) AS n")
cte("placed", "train_keys", f"SELECT *, {_pos} FROM train_keys")
MANIFEST = f"{KEYSPEC} split_scheme:s fold_id:i role:s"

# ---- folds ---------------------------------------------------------------------

cte("f_group", "train_keys", """
SELECT k.subject_id, k.sleep_date, k.lifelog_date, 'group' AS split_scheme,
  CASE WHEN step < 5 THEN step ELSE 9 - step END AS fold_id, 'valid' AS role
FROM train_keys k JOIN (SELECT subject_id, (row_number() OVER (ORDER BY n DESC, md5(subject_id)) - 1) % 10 AS step
  FROM (SELECT subject_id, count(*) AS n FROM train_keys GROUP BY subject_id) s) d USING (subject_id)""")
cte("f_time", "placed", f"""
SELECT subject_id, sleep_date, lifelog_date, 'group_time' AS split_scheme,
  CASE WHEN position >= floor(n * {dbl(0.8)}) THEN 2 WHEN position >= floor(n * {dbl(0.6)}) THEN 1 ELSE 0 END AS fold_id,
  'valid' AS role FROM placed WHERE position >= floor(n * {dbl(0.4)})""")


@query("whole_subject_folds", "CV-1", MANIFEST, "f_group", "SELECT * FROM f_group")
def whole_subject_folds(spark, folder):
    return V.group_folds(keyed(spark, folder, "train"))


@query("rolling_origin_folds", "CV-2 WIN-20", MANIFEST, "f_time", "SELECT * FROM f_time")
def rolling_origin_folds(spark, folder):
    return V.rolling_origin_folds(keyed(spark, folder, "train"))


@query("fold_manifest", "CV-8 SET-1", MANIFEST, "f_group f_time", "SELECT * FROM f_group UNION ALL SELECT * FROM f_time")
def fold_manifest(spark, folder):
    return V.fold_manifest(keyed(spark, folder, "train"))


@query("fold_report", "AUD-11", "split_scheme:s fold_id:i rows:i", "f_group f_time", """
SELECT split_scheme, fold_id, count(*) AS rows FROM (SELECT * FROM f_group UNION ALL SELECT * FROM f_time) m
GROUP BY split_scheme, fold_id""")
def fold_report(spark, folder):
    return V.fold_report(V.fold_manifest(keyed(spark, folder, "train")))


_cut = [f"floor(n * {dbl(1.0 - 0.2 * (3 - f))})" for f in range(3)] + ["n"]


@query("forward_folds", "CV-3", MANIFEST, "placed", f"""
SELECT subject_id, sleep_date, lifelog_date, 'forward' AS split_scheme, fold_id,
  CASE WHEN n < 4 OR position < lo THEN 'train' ELSE 'valid' END AS role
FROM (SELECT p.*, f.fold_id, CASE WHEN a < b THEN a ELSE n - 1 END AS lo, CASE WHEN a < b THEN b ELSE n END AS hi
  FROM (SELECT *, {", ".join(f"{c} AS c{i}" for i, c in enumerate(_cut))} FROM placed) p,
  LATERAL (SELECT 0 AS fold_id, c0 AS a, c1 AS b UNION ALL SELECT 1, c1, c2 UNION ALL SELECT 2, c2, c3) f) t
WHERE n < 4 OR position < hi""")
def forward_folds(spark, folder):
    return V.forward_folds(keyed(spark, folder, "train"))


@query("leave_one_subject_out", "CV-4", f"{KEYSPEC} split_scheme:s fold_id:s role:s", "train_keys", """
SELECT subject_id, sleep_date, lifelog_date, 'loso' AS split_scheme, subject_id AS fold_id, 'valid' AS role
FROM train_keys""")
def leave_one_subject_out(spark, folder):
    return V.leave_one_subject_out(keyed(spark, folder, "train"))


_digest = "md5(concat_ws('|', '42', subject_id, CAST(sleep_date AS VARCHAR), CAST(lifelog_date AS VARCHAR)))"
cte("f_within", "train_keys", f"""
SELECT subject_id, sleep_date, lifelog_date, 'subject_holdout' AS split_scheme,
  CASE WHEN i < (n % 5) * (n // 5 + 1) THEN i // (n // 5 + 1)
       ELSE n % 5 + (i - (n % 5) * (n // 5 + 1)) // (n // 5) END AS fold_id, 'valid' AS role
FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY {_digest}) - 1 AS i,
        count(*) OVER (PARTITION BY subject_id) AS n FROM train_keys) t""")


@query("within_subject_folds", "CV-5", MANIFEST, "f_within", "SELECT * FROM f_within")
def within_subject_folds(spark, folder):
    return V.within_subject_folds(keyed(spark, folder, "train"))


_seeds = (42, 7)
_digest2 = ("md5(concat_ws('|', CAST(seed AS VARCHAR), target, subject_id, CAST(sleep_date AS VARCHAR), "
            "CAST(lifelog_date AS VARCHAR)))")
cte("f_strat", "train_labels", f"""
SELECT subject_id, sleep_date, lifelog_date, target, seed, 'public_stratified' AS split_scheme,
  (row_number() OVER (PARTITION BY target, seed, y ORDER BY {_digest2}) - 1) % 5 AS fold_id, 'valid' AS role
FROM (SELECT *, unnest([42, 7]) AS seed FROM train_labels WHERE y IS NOT NULL) t""")


@query("stratified_folds", "CV-6", f"{ROWSPEC} seed:i split_scheme:s fold_id:i role:s", "f_strat",
       "SELECT * FROM f_strat")
def stratified_folds(spark, folder):
    return V.stratified_folds(labels(spark, folder), 5, _seeds)


@query("calibration_rows", "CV-7", f"{KEYSPEC} part:s", "placed", f"""
SELECT *, CASE WHEN position < greatest(floor(n * {dbl(0.8)}), 1) THEN 'fit' ELSE 'calib' END AS part FROM placed""")
def calibration_rows(spark, folder):
    return V.calibration_split(keyed(spark, folder, "train"))


@query("calibration_subjects", "CV-7", f"{KEYSPEC} part:s", "train_keys", """
SELECT *, CASE WHEN CAST('0x' || substr(md5('calib|' || subject_id), 1, 4) AS INTEGER) < 52428 THEN 'fit' ELSE 'calib'
  END AS part FROM train_keys""")
def calibration_subjects(spark, folder):
    return V.calibration_split(keyed(spark, folder, "train"), "group")


@query("scheme_folds", "CV-9", f"{ROWSPEC} seed:i fold_id:i", "f_within long_labels", """
SELECT l.subject_id, l.sleep_date, l.lifelog_date, l.target, 42 AS seed, f.fold_id
FROM long_labels l JOIN f_within f USING (subject_id, sleep_date, lifelog_date) WHERE l.y IS NOT NULL""")
def scheme_folds(spark, folder):
    return V.folds_for_scheme(labels(spark, folder, "train"), "subject_holdout", 5, (42,))


@query("fold_members", "JOIN-6", KEYSPEC, "f_time", "SELECT * FROM f_time WHERE fold_id = 1")
def fold_members(spark, folder):
    train = keyed(spark, folder, "train")
    return V.valid_rows(train, V.rolling_origin_folds(train), 1)


cte("outer_time", "train_keys f_time", """
SELECT t.subject_id, t.sleep_date, t.lifelog_date, s.fold_id FROM train_keys t JOIN (
  SELECT subject_id, fold_id, min(sleep_date) AS start FROM f_time GROUP BY subject_id, fold_id) s
  ON t.subject_id = s.subject_id AND t.sleep_date < s.start""")


@query("outer_train_rows", "JOIN-7", f"{KEYSPEC} fold_id:i", "outer_time", "SELECT * FROM outer_time")
def outer_train_rows(spark, folder):
    train = keyed(spark, folder, "train")
    return V.outer_train_rows(train, V.rolling_origin_folds(train), "group_time")


@query("outer_train_complement", "JOIN-7 SET-3", f"{KEYSPEC} fold_id:i", "train_keys f_group", """
SELECT t.subject_id, t.sleep_date, t.lifelog_date, f.fold_id
FROM train_keys t JOIN f_group g USING (subject_id, sleep_date, lifelog_date)
CROSS JOIN (SELECT DISTINCT fold_id FROM f_group) f WHERE f.fold_id <> g.fold_id""")
def outer_train_complement(spark, folder):
    train = keyed(spark, folder, "train")
    return V.outer_train_rows(train, V.group_folds(train), "group")


# ---- priors ------------------------------------------------------------------------

_clip = lambda e: f"greatest(least({e}, 0.999999), 0.000001)"
_busy = lambda e: f"greatest(least({e}, 0.98), 0.02)"
_ll = lambda y, p: f"-({y} * ln({_clip(p)}) + (1 - {y}) * ln(1 - {_clip(p)}))"
cte("doc_means", "doc_labels", "SELECT target, avg(y) AS g FROM doc_labels GROUP BY target")
cte("doc_sums", "doc_labels", "SELECT source, target, sum(y) AS s, count(y) AS n FROM doc_labels GROUP BY source, target")


@query("source_prior", "PRI-1", "source:s target:s prior:d", "doc_means doc_sums", """
SELECT source, target, (s + 5 * g) / (n + 5) AS prior FROM doc_sums JOIN doc_means USING (target)""")
def source_prior(spark, folder):
    return R.subject_priors(S.document_labels(spark, folder), subject="source")


@query("source_prior_without_row", "PRI-2", "doc_id:i target:s y:i p:d", "doc_labels doc_means doc_sums", f"""
SELECT doc_id, target, y, {_clip('(s - y + 5 * g) / greatest(n - 1 + 5, 5)')} AS p
FROM doc_labels JOIN doc_sums USING (source, target) JOIN doc_means USING (target)""")
def source_prior_without_row(spark, folder):
    return R.leave_one_out_prior(S.document_labels(spark, folder), subject="source")


@query("prior_lookup", "JOIN-5", "doc_id:i target:s p:d", "doc_labels", f"""
WITH tr AS (SELECT * FROM doc_labels WHERE source <> 'src0'),
m AS (SELECT target, avg(y) AS g FROM tr GROUP BY target),
pr AS (SELECT source, target, (sum(y) + 5 * any_value(g)) / (count(y) + 5) AS prior
       FROM tr JOIN m USING (target) GROUP BY source, target)
SELECT d.doc_id, d.target, {_clip('coalesce(prior, g)')} AS p
FROM doc_labels d JOIN m USING (target) LEFT JOIN pr USING (source, target)""")
def prior_lookup(spark, folder):
    every = S.document_labels(spark, folder)
    known = every.where(F.col("source") != "src0")  # one subject stays unseen
    return R.lookup_prior(every, R.subject_priors(known, subject="source"), SC.global_means(known), "source")


cte("aged", "train_labels", """
SELECT *, row_number() OVER (PARTITION BY subject_id, target ORDER BY lifelog_date DESC) - 1 AS age FROM train_labels""")
cte("means", "train_labels", "SELECT target, avg(y) AS g FROM train_labels GROUP BY target")


@query("half_life_prior", "PRI-3 WIN-21", "subject_id:s target:s prior:d", "aged means", """
SELECT subject_id, target, (sum(y * pow(0.5, age / 3.0)) + 5 * any_value(g)) / (sum(pow(0.5, age / 3.0)) + 5) AS prior
FROM aged JOIN means USING (target) GROUP BY subject_id, target""")
def half_life_prior(spark, folder):
    return R.half_life_priors(labels(spark, folder, "train"), 5.0, 3.0)


def outer_and_valid(spark, folder):
    train = keyed(spark, folder, "train")
    manifest = V.rolling_origin_folds(train)
    outer = S.long_labels(V.outer_train_rows(train, manifest, "group_time"))
    valid = S.long_labels(train.join(manifest.select(*KEYS, "fold_id"), KEYS))
    return outer, valid


cte("outer_labels", "outer_time train_labels", """
SELECT l.*, o.fold_id, row_number() OVER (PARTITION BY o.fold_id, l.subject_id, l.target ORDER BY l.lifelog_date DESC) - 1
  AS age FROM outer_time o JOIN train_labels l USING (subject_id, sleep_date, lifelog_date)""")
cte("valid_labels", "f_time train_labels",
    "SELECT l.*, f.fold_id FROM f_time f JOIN train_labels l USING (subject_id, sleep_date, lifelog_date)")
cte("outer_means", "outer_labels", "SELECT fold_id, target, avg(y) AS g FROM outer_labels GROUP BY fold_id, target")
_configs = ", ".join(
    f"({9 * i + j}, {m}, {'NULL' if h is None else h})" for i, m in enumerate(SMOOTHING_GRID) for j, h in enumerate(HALF_LIFE_GRID))
cte("prior_grid", "outer_labels outer_means valid_labels", f"""
SELECT v.target, c.config, c.m AS smoothing_m, c.h AS half_life,
  avg({_ll('v.y', '(coalesce(p.wy, 0) + c.m * g.g) / (coalesce(p.w, 0) + c.m)')}) AS score
FROM valid_labels v JOIN outer_means g USING (fold_id, target)
CROSS JOIN (VALUES {_configs}) c(config, m, h)
LEFT JOIN (SELECT fold_id, subject_id, target, c.config, sum(y * w) AS wy, sum(w) AS w FROM (
    SELECT o.*, c.config, CASE WHEN c.h IS NULL THEN 1 ELSE pow(0.5, o.age / CAST(c.h AS DOUBLE)) END AS w
    FROM outer_labels o CROSS JOIN (VALUES {_configs}) c(config, m, h)) c GROUP BY ALL) p
  ON v.fold_id = p.fold_id AND v.subject_id = p.subject_id AND v.target = p.target AND c.config = p.config
GROUP BY ALL""")


@query("prior_grid", "PRI-4 JOIN-12", "target:s config:i smoothing_m:d half_life:d score:d", "prior_grid",
       "SELECT * FROM prior_grid")
def prior_grid(spark, folder):
    return R.prior_grid_scores(*outer_and_valid(spark, folder))


@query("best_prior_setting", "TOP-5 PRI-4", "target:s config:i score:d", "prior_grid", """
SELECT target, config, score FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, config) AS r
  FROM prior_grid) t WHERE r = 1""")
def best_prior_setting(spark, folder):
    return SE.best_settings(R.prior_grid_scores(*outer_and_valid(spark, folder)))


@query("prior_against_dummy", "PRI-5", "target:s prior_score:d dummy_score:d", "valid_labels outer_labels outer_means", f"""
SELECT v.target, avg({_ll('v.y', '(coalesce(s, 0) + 5 * g) / (coalesce(n, 0) + 5)')}) AS prior_score,
  avg({_ll('v.y', 'g')}) AS dummy_score
FROM valid_labels v JOIN outer_means USING (fold_id, target) LEFT JOIN (
  SELECT fold_id, subject_id, target, sum(y) AS s, count(y) AS n FROM outer_labels GROUP BY ALL) p
  USING (fold_id, subject_id, target) GROUP BY v.target""")
def prior_against_dummy(spark, folder):
    return R.evaluate_prior(*outer_and_valid(spark, folder))


# ---- temporal neighbours ----------------------------------------------------------------


@query("neighbour_days", "JOIN-8", f"{KEYSPEC} gap:i", "train_keys keyed_labels", """
SELECT k.subject_id, k.sleep_date, k.lifelog_date, date_diff('day', k.lifelog_date, t.lifelog_date) AS gap
FROM keyed_labels k JOIN train_keys t ON k.subject_id = t.subject_id
  AND abs(date_diff('day', k.lifelog_date, t.lifelog_date)) BETWEEN 1 AND 7""")
def neighbour_days(spark, folder):
    return NB.neighbour_pairs(keyed(spark, folder), keyed(spark, folder, "train"), 7, keep_same_day=False)


def _temporal_sql(samples: str, kernel: str, days: int, same_day: bool, targets: str | None = None) -> str:
    where = f"WHERE s.target IN ({targets})" if targets else ""
    gap = "abs(date_diff('day', s.lifelog_date, r.lifelog_date))"
    return f"""
SELECT s.subject_id, s.sleep_date, s.lifelog_date, s.target,
  {_busy(f"0.9 * coalesce(sum(r.y * {kernel.format(d=gap)}) / sum({kernel.format(d=gap)}), any_value(coalesce(u.m, g.g))) "
         "+ 0.05 * any_value(coalesce(u.m, g.g)) + 0.05 * any_value(g.g)")} AS p
FROM {samples} s JOIN means g USING (target)
LEFT JOIN (SELECT subject_id, target, avg(y) AS m FROM train_labels GROUP BY ALL) u USING (subject_id, target)
LEFT JOIN train_labels r ON s.subject_id = r.subject_id AND s.target = r.target
  AND {gap} <= {days} {"" if same_day else f"AND {gap} > 0"}
{where} GROUP BY s.subject_id, s.sleep_date, s.lifelog_date, s.target"""


cte("test_labels", "long_labels", "SELECT * FROM long_labels WHERE split = 'test'")
_power2 = "(1 / pow({d} + 1, 2))"


@query("temporal_prior_labelled", "PRI-7 JOIN-8", f"{ROWSPEC} p:d", "train_labels means",
       _temporal_sql("train_labels", _power2, 7, False))
def temporal_prior_labelled(spark, folder):
    train = labels(spark, folder, "train")
    return NB.temporal_prior(train, train, {NB.ALL: ("power", 7, 2.0)}, exclude_same_day=True)


@query("temporal_prior_unlabelled", "PRI-7 JOIN-8", f"{ROWSPEC} p:d", "train_labels test_labels means",
       _temporal_sql("test_labels", _power2, 7, True))
def temporal_prior_unlabelled(spark, folder):
    return NB.temporal_prior(
        labels(spark, folder, "test"), labels(spark, folder, "train"), {NB.ALL: ("power", 7, 2.0)}, exclude_same_day=False)


def _kernel_text(kind: str, value: float) -> str:
    return f"(1 / pow({{d}} + 1, {value}))" if kind == "power" else f"exp(-{{d}} / CAST({value} AS DOUBLE))"


_groups: dict[tuple, list[str]] = {}
for _t, _setting in TARGET_KERNELS.items():
    _groups.setdefault(_setting, []).append(_t)
_targetwise = " UNION ALL ".join(
    _temporal_sql("test_labels", _kernel_text(kind, value), days, True, ", ".join(f"'{t}'" for t in ts))
    for (kind, days, value), ts in _groups.items())
cte("targetwise_test", "train_labels test_labels means", _targetwise)


@query("targetwise_kernels", "PRI-8", f"{ROWSPEC} p:d", "targetwise_test", "SELECT * FROM targetwise_test")
def targetwise_kernels(spark, folder):
    return NB.targetwise_temporal_prior(labels(spark, folder, "test"), labels(spark, folder, "train"), False)


def _power_sql(samples: str, reference: str, days: int, power: float, sw: float, future: float, by: str = "") -> str:
    """Two-tier power prior by a plain self join; own keys never count."""
    gap = "date_diff('day', s.lifelog_date, r.lifelog_date)"
    on = "".join(f" AND s.{b} = r.{b}" for b in by.split())
    keys = "".join(f"s.{b}, " for b in by.split())
    plain = "".join(f"{b}, " for b in by.split())
    w = f"((CASE WHEN {gap} > 0 THEN {future} ELSE 1 END) / pow(abs({gap}) + 1, {power}))"
    near = f"abs({gap}) <= {days}"
    return f"""
SELECT {plain}subject_id, sleep_date, lifelog_date, target,
  {_busy(f"CASE WHEN n = 0 THEN g ELSE {0.95 - sw} * coalesce(near, far, g) + {sw} * m + 0.05 * g END")} AS p
FROM (SELECT {keys}s.subject_id, s.sleep_date, s.lifelog_date, s.target, count(r.y) AS n, avg(r.y) AS m,
    any_value(g.g) AS g, sum(r.y * {w}) FILTER ({near}) / nullif(sum({w}) FILTER ({near}), 0) AS near,
    sum(r.y * {w}) / nullif(sum({w}) FILTER (r.y IS NOT NULL), 0) AS far
  FROM {samples} s JOIN (SELECT {plain}target, avg(y) AS g FROM {reference} GROUP BY ALL) g USING ({plain}target)
  LEFT JOIN {reference} r ON s.subject_id = r.subject_id AND s.target = r.target{on}
    AND (s.sleep_date <> r.sleep_date OR s.lifelog_date <> r.lifelog_date)
  GROUP BY {keys}s.subject_id, s.sleep_date, s.lifelog_date, s.target) t"""


@query("power_prior", "PRI-6 JOIN-8", f"{ROWSPEC} p:d", "train_labels long_labels",
       _power_sql("long_labels", "train_labels", 3, 1.25, 0.15, 0.5))
def power_prior(spark, folder):
    return NB.power_prior(labels(spark, folder), labels(spark, folder, "train"), 3, 1.25, 0.15, 0.5)


@query("fold_safe_prior", "PRI-10", f"{ROWSPEC} p:d", "train_labels f_strat", f"""
WITH own AS (SELECT l.*, f.seed, f.fold_id AS fold FROM train_labels l
  JOIN f_strat f USING (subject_id, sleep_date, lifelog_date, target)),
ref AS (SELECT o.* EXCLUDE (fold), t.i AS fold FROM own o CROSS JOIN (SELECT unnest(range(5)) AS i) t WHERE t.i <> o.fold),
pp AS ({_power_sql('own', 'ref', 14, 1.25, 0.15, 1.0, 'seed fold')})
SELECT subject_id, sleep_date, lifelog_date, target, avg(p) AS p FROM pp GROUP BY ALL""")
def fold_safe_prior(spark, folder):
    train = labels(spark, folder, "train")
    return NB.fold_safe_prior(train, V.stratified_folds(train, 5, _seeds), 14, 1.25, 0.15)


def _nearest_sql(samples: str, own: bool) -> str:
    gap = "abs(date_diff('day', s.lifelog_date, r.lifelog_date))"
    return f"""SELECT s.subject_id, s.sleep_date, s.lifelog_date, min({gap}) AS nearest_days FROM {samples} s
LEFT JOIN train_keys r ON s.subject_id = r.subject_id {"AND s.lifelog_date <> r.lifelog_date" if own else ""}
GROUP BY s.subject_id, s.sleep_date, s.lifelog_date"""


@query("nearest_label_days", "JOIN-10", f"{KEYSPEC} nearest_days:d", "train_keys keyed_labels",
       _nearest_sql("(SELECT * FROM keyed_labels WHERE split = 'test')", False))
def nearest_label_days(spark, folder):
    return NB.nearest_label_days(keyed(spark, folder, "test"), keyed(spark, folder, "train"), exclude_own_day=False)


@query("nearest_other_label_days", "JOIN-10", f"{KEYSPEC} nearest_days:d", "train_keys", _nearest_sql("train_keys", True))
def nearest_other_label_days(spark, folder):
    train = keyed(spark, folder, "train")
    return NB.nearest_label_days(train, train, exclude_own_day=True)


_th = [c.removeprefix("th_Q1_") for c in NB.history_columns("Q1")]
_gap = "date_diff('day', s.lifelog_date, r.lifelog_date)"
_th_sql = ", ".join(
    [f"list_extract(pv, {r}).y AS prev{r}_value, list_extract(pv, {r}).d AS prev{r}_days, "
     f"list_extract(nx, {r}).y AS next{r}_value, list_extract(nx, {r}).d AS next{r}_days" for r in NEIGHBOUR_RANKS])
_th_agg = ", ".join(
    f"avg(r.y) FILTER ({_gap} BETWEEN {lo} AND {hi}) AS {side}{d}_mean, "
    f"CASE WHEN count(r.y) > 0 THEN count(r.y) FILTER ({_gap} BETWEEN {lo} AND {hi}) END AS {side}{d}_count"
    for d in NEIGHBOUR_WINDOWS for side, lo, hi in (("past", -d, -1), ("future", 1, d)))


@query("target_history", "PRI-9 JOIN-9", f"{ROWSPEC} {columns('d', _th)}", "long_labels train_labels", f"""
SELECT *, {_th_sql}, nr.y AS nearest_value, abs(nr.d) AS nearest_days, CAST(nr.d > 0 AS INTEGER) AS nearest_is_future,
  CASE WHEN len(pv) > 0 AND len(nx) > 0 THEN CAST(pv[1].y = nx[1].y AS INTEGER) END AS prev_next_same
FROM (SELECT s.subject_id, s.sleep_date, s.lifelog_date, s.target, avg(r.y) AS prior_mean,
    nullif(count(r.y), 0) AS prior_count, {_th_agg},
    list({{'y': r.y, 'd': -{_gap}}} ORDER BY r.lifelog_date DESC) FILTER ({_gap} < 0) AS pv,
    list({{'y': r.y, 'd': {_gap}}} ORDER BY r.lifelog_date) FILTER ({_gap} > 0) AS nx,
    first({{'y': r.y, 'd': {_gap}}} ORDER BY abs({_gap}), r.lifelog_date) FILTER (r.y IS NOT NULL AND {_gap} <> 0) AS nr
  FROM long_labels s LEFT JOIN train_labels r ON s.subject_id = r.subject_id AND s.target = r.target
  GROUP BY s.subject_id, s.sleep_date, s.lifelog_date, s.target) t""")
def target_history(spark, folder):
    return NB.target_history(labels(spark, folder), labels(spark, folder, "train"))


@query("target_history_wide", "PRI-9", f"{KEYSPEC} th_Q1_prior_mean:d th_S4_nearest_days:d th_Q2_prev1_value:d",
       "q_target_history", """
SELECT subject_id, sleep_date, lifelog_date, max(prior_mean) FILTER (target = 'Q1') AS "th_Q1_prior_mean",
  max(nearest_days) FILTER (target = 'S4') AS "th_S4_nearest_days",
  max(prev1_value) FILTER (target = 'Q2') AS "th_Q2_prev1_value"
FROM q_target_history GROUP BY subject_id, sleep_date, lifelog_date""")
def target_history_wide(spark, folder):
    return NB.wide_target_history(target_history(spark, folder), TARGETS)


# ---- predictions of three simple runs --------------------------------------------------

# core: leave-one-out subject prior (m = 5); slow: the same with m = 20; recent: past seven-row mean.
cte("subject_totals", "train_labels", "SELECT subject_id, target, sum(y) AS s, count(y) AS n FROM train_labels GROUP BY ALL")


def _loo(m: int) -> str:
    train = f"(s - y + {m} * g) / (n - 1 + {m})"
    test = f"(coalesce(s, 0) + {m} * g) / (coalesce(n, 0) + {m})"
    return _clip(f"CASE WHEN split = 'train' THEN {train} ELSE {test} END")


cte("preds", "long_labels subject_totals means", f"""
SELECT r.run, t.subject_id, t.sleep_date, t.lifelog_date, t.split, t.target, t.y,
  CASE r.run WHEN 'core' THEN {_loo(5)} WHEN 'slow' THEN {_loo(20)} ELSE {_clip('0.1 * g + 0.9 * coalesce(w, g)')} END AS p
FROM (SELECT l.*, s, n, g, avg(l.y) OVER (PARTITION BY l.subject_id, l.target ORDER BY l.lifelog_date
        ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS w
      FROM long_labels l JOIN means USING (target) LEFT JOIN subject_totals USING (subject_id, target)) t
CROSS JOIN (SELECT unnest(['core', 'slow', 'recent']) AS run) r""")


def predictions(spark, folder):
    """Three runs over all keys: (run, keys, split, target, y, p)."""
    from pyspark.sql import Window

    from dayfold.functions.scalar import probability

    every = labels(spark, folder)
    train = every.where("split = 'train'")
    sums = R.subject_sums(train)
    rows = every.join(sums, ["subject_id", "target"], "left").join(F.broadcast(SC.global_means(train)), "target")
    w = Window.partitionBy("subject_id", "target").orderBy("lifelog_date").rowsBetween(-7, -1)
    rows = rows.withColumn("w", F.avg("y").over(w))
    g, own = F.col("global_mean"), F.coalesce("y", F.lit(0))
    count = F.coalesce("y_cnt", F.lit(0)) - F.col("y").isNotNull().cast("int")
    prior = lambda m: probability(R.smoothed(F.coalesce("y_sum", F.lit(0.0)) - own, count, g, float(m)))
    recent = probability(0.1 * g + 0.9 * F.coalesce("w", "global_mean"))
    runs = F.explode(F.array(*[
        F.struct(F.lit(n).alias("run"), p.alias("p"))
        for n, p in (("core", prior(5)), ("slow", prior(20)), ("recent", recent))]))
    return rows.select(*KEYS, "split", "target", "y", runs.alias("r")).select(
        "r.run", *KEYS, "split", "target", "y", "r.p")


def pair(spark, folder, a: str = "core", b: str = "recent", split: str | None = "train"):
    df = predictions(spark, folder)
    df = df if split is None else df.where(F.col("split") == split)
    wide = B.runs_side_by_side(df.where(F.col("run").isin(a, b)), [a, b])
    return wide.withColumnsRenamed({a: "a", b: "b"})


cte("pairs", "preds", """
SELECT subject_id, sleep_date, lifelog_date, split, target, any_value(y) AS y, max(p) FILTER (run = 'core') AS a,
  max(p) FILTER (run = 'recent') AS b, max(p) FILTER (run = 'slow') AS c FROM preds
GROUP BY subject_id, sleep_date, lifelog_date, split, target""")


@query("three_runs", "SNK-10 SET-1", f"run:s {ROWSPEC} split:s y:d p:d", "preds", "SELECT * FROM preds")
def three_runs(spark, folder):
    return predictions(spark, folder)


# ---- scores ---------------------------------------------------------------------------------

cte("scores", "preds", f"""
SELECT run, target, avg({_ll('y', 'p')}) AS score FROM preds WHERE split = 'train' GROUP BY run, target""")


def train_scores(spark, folder):
    return SC.target_scores(predictions(spark, folder).where("split = 'train'"))


@query("target_log_loss", "AGG-21", "run:s target:s score:d", "scores", "SELECT * FROM scores")
def target_log_loss(spark, folder):
    return train_scores(spark, folder)


@query("macro_log_loss", "AGG-21", "run:s mean:d std:d", "scores",
       "SELECT run, avg(score) AS mean, stddev_pop(score) AS std FROM scores GROUP BY run")
def macro_log_loss(spark, folder):
    return SC.macro_scores(train_scores(spark, folder))


@query("dummy_predictions", "AGG-20", "target:s rows:i p:d score:d", "train_labels means", f"""
SELECT target, count(*) AS rows, any_value(g) AS p, avg({_ll('y', 'g')}) AS score
FROM train_labels JOIN means USING (target) GROUP BY target""")
def dummy_predictions(spark, folder):
    return SC.dummy_predictions(labels(spark, folder, "train")).groupBy("target").agg(
        F.count("*").alias("rows"), F.max("p").alias("p"), SC.log_loss().alias("score"))


@query("stability_table", "AGG-22 CV-9", "target:s fold:i seed:i logloss:d mean:d std:d", "preds f_strat", f"""
SELECT *, avg(logloss) OVER (PARTITION BY target) AS mean, stddev_pop(logloss) OVER (PARTITION BY target) AS std
FROM (SELECT target, fold_id AS fold, seed, avg({_ll('y', 'p')}) AS logloss
      FROM preds JOIN f_strat USING (subject_id, sleep_date, lifelog_date, target) WHERE run = 'core' GROUP BY ALL) t""")
def stability_table(spark, folder):
    folds = V.folds_for_scheme(labels(spark, folder), "public_stratified", 5, _seeds)
    return SC.stability_table(predictions(spark, folder).where("run = 'core'"), folds)


@query("run_drift", "AGG-23 JOIN-11", "target:s mean_abs:d max_abs:d ok:i", "pairs", """
SELECT target, avg(abs(a - b)) AS mean_abs, max(abs(a - b)) AS max_abs,
  CAST(avg(abs(a - b)) <= 0.25 AND max(abs(a - b)) <= 0.9 AS INTEGER) AS ok
FROM pairs WHERE split = 'test' GROUP BY target""")
def run_drift(spark, folder):
    df = predictions(spark, folder).where("split = 'test'")
    return SC.drift(SC.paired(df.where("run = 'core'"), df.where("run = 'recent'")), 0.25, 0.9)


@query("score_line", "AGG-25", "target:s slope:d intercept:d projection:d", "scores", """
SELECT target, regr_slope(score, x) AS slope, regr_intercept(score, x) AS intercept,
  regr_slope(score, x) * 6.5 + regr_intercept(score, x) AS projection
FROM (SELECT *, CASE run WHEN 'core' THEN 0.0::DOUBLE WHEN 'slow' THEN 1.5 ELSE 4.0 END AS x FROM scores) s
GROUP BY target""")
def score_line(spark, folder):
    x = F.when(F.col("run") == "core", 0.0).when(F.col("run") == "slow", 1.5).otherwise(4.0)
    return SC.linear_trend(train_scores(spark, folder).withColumn("x", x), ["target"], "x", "score", 6.5)


@query("score_parabola", "AGG-25", "target:s a:d b:d c:d estimate:d", "scores", """
SELECT target, a, b, y0 AS c, a * 4 + b * 2 + y0 AS estimate FROM (
  SELECT target, y0, ((y2 - y0) / 0.75 + (y1 - y0)) / 1.75 AS a,
    ((y2 - y0) / 0.75 + (y1 - y0)) / 1.75 - (y1 - y0) AS b
  FROM (SELECT target, max(score) FILTER (run = 'slow') AS y1, max(score) FILTER (run = 'core') AS y0,
          max(score) FILTER (run = 'recent') AS y2 FROM scores GROUP BY target) s) t""")
def score_parabola(spark, folder):
    x = F.when(F.col("run") == "core", 0.0).when(F.col("run") == "slow", -1.0).otherwise(0.75)
    return SC.quadratic_trend(train_scores(spark, folder).withColumn("x", x), ["target"], "x", "score", 2.0)


@query("model_comparison", "AGG-26", "run:s mean:d std:d improvement:d", "scores", """
SELECT run, avg(score) AS mean, stddev_pop(score) AS std,
  (SELECT avg(score) FROM scores WHERE run = 'slow') - avg(score) AS improvement FROM scores GROUP BY run""")
def model_comparison(spark, folder):
    return SC.compare_runs(predictions(spark, folder).where("split = 'train'"), "slow")


@query("prediction_statistics", "AUD-12", "run:s target:s mean:d std:d min:d max:d", "preds", """
SELECT run, target, avg(p) AS mean, stddev_pop(p) AS std, min(p) AS min, max(p) AS max FROM preds GROUP BY run, target""")
def prediction_statistics(spark, folder):
    return SC.prediction_statistics(predictions(spark, folder), ["run", "target"])


@query("seen_subject_rate", "AUD-12", "seen_rate:d", "keyed_labels", """
SELECT avg(CASE WHEN subject_id IN (SELECT subject_id FROM keyed_labels WHERE split = 'train') THEN 1 ELSE 0 END)
  AS seen_rate FROM keyed_labels WHERE split = 'test'""")
def seen_subject_rate(spark, folder):
    return SC.seen_subject_rate(keyed(spark, folder, "test"), keyed(spark, folder, "train"))


@query("rank_auc", "ML-10", "run:s target:s auc:d", "preds", """
SELECT run, target, (sum(CASE WHEN y = 1 THEN r END) - max(np) * (max(np) + 1) / 2.0) / (max(np) * (count(*) - max(np)))
  AS auc
FROM (SELECT *, rank() OVER (PARTITION BY run, target ORDER BY p) + (count(*) OVER (PARTITION BY run, target, p) - 1) / 2.0
        AS r, sum(y) OVER (PARTITION BY run, target) AS np FROM preds WHERE split = 'train') t GROUP BY run, target""")
def rank_auc(spark, folder):
    return M.rank_auc(predictions(spark, folder), ["run", "target"])


# ---- feature scores ----------------------------------------------------------------------------

_features = ["amount", "peak", "d_all_row_cnt", "d_all_coverage_ratio"]
_target_columns = ", ".join(f'"{t}"' for t in TARGETS)
cte("long_features", "train_keys amounts", " UNION ALL ".join(
    f"SELECT '{f}' AS feature, {f} AS x, target, y FROM (SELECT *, unnest({TARGETS}) AS target, "
    f"unnest([{_target_columns}]) AS y FROM train_keys JOIN amounts USING (subject_id, lifelog_date)) t{i}"
    for i, f in enumerate(_features)))
cte("corrs", "long_features", """
SELECT target, feature, CASE WHEN count(*) < 3 THEN 0 ELSE coalesce(abs(corr(x, y)), 0) END AS score
FROM long_features WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY target, feature""")


def feature_rows(spark, folder):
    table = catalog.tables.C.attach_to_keys(keyed(spark, folder, "train"), catalog.tables.amounts(spark, folder))
    return SE.long_features(table, TARGETS, _features).unpivot(["feature", "x"], TARGETS, "target", "y")


@query("feature_correlation", "AGG-24", "target:s feature:s score:d", "corrs", "SELECT * FROM corrs")
def feature_correlation(spark, folder):
    return SE.absolute_correlations(feature_rows(spark, folder), ["target", "feature"])


@query("embedding_correlation", "AGG-24 TOP-2", "feature:i score:d", "", """
SELECT feature, abs(corr(x, y)) AS score FROM (
  SELECT unnest(range(64)) AS feature, CAST(unnest(embedding) AS DOUBLE) AS x,
    CASE WHEN label = 0 THEN 1 ELSE 0 END AS y FROM embeddings) t GROUP BY feature""")
def embedding_correlation(spark, folder):
    rows = S.table(spark, folder, "embeddings").select(
        (F.col("label") == 0).cast("int").alias("y"), F.posexplode("embedding").alias("feature", "x"))
    return SE.absolute_correlations(rows.withColumn("x", F.col("x").cast("double")))


@query("chosen_features", "TOP-2 AGG-24", "target:s feature:s place:i", "corrs", """
SELECT target, feature, row_number() OVER (PARTITION BY target ORDER BY place) AS place FROM (
  SELECT target, feature, min(place) AS place FROM (
    SELECT target, feature, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score DESC, feature)
      AS r FROM corrs WHERE score > 0) c WHERE r <= 2
    UNION ALL SELECT DISTINCT target, unnest(['d_is_weekend', 'd_month', 'peak', 'subject_prior_feature']),
      unnest([3, 4, 5, 6]) FROM corrs) u GROUP BY target, feature) m""")
def chosen_features(spark, folder):
    scores = SE.absolute_correlations(feature_rows(spark, folder), ["target", "feature"])
    return SE.select_features(scores, 2, ["peak", "d_month", "d_is_weekend"], "subject_prior_feature")


# gains per seed: scores on five digest slices of the rows stand in for model importances
cte("gains", "train_keys amounts", f"""
SELECT target, feature, seed, abs(corr(x, y)) AS gain FROM (
  SELECT CAST('0x' || substr(md5(concat_ws('|', subject_id, CAST(lifelog_date AS VARCHAR))), 1, 2) AS INTEGER) % 5 AS seed,
    unnest([{", ".join(f"'{f}'" for f in _features)}]) AS feature, unnest([{", ".join(_features)}]) AS x, target, y
  FROM (SELECT *, unnest({TARGETS}) AS target, unnest([{_target_columns}]) AS y
        FROM train_keys JOIN amounts USING (subject_id, lifelog_date)) k) t
WHERE x IS NOT NULL GROUP BY target, feature, seed""")


def gains(spark, folder):
    table = catalog.tables.C.attach_to_keys(keyed(spark, folder, "train"), catalog.tables.amounts(spark, folder))
    digest = F.md5(F.concat_ws("|", "subject_id", F.col("lifelog_date").cast("string")))
    table = table.withColumn("seed", F.conv(F.substring(digest, 1, 2), 16, 10).cast("int") % 5)
    long = SE.long_features(table, [*TARGETS, "seed"], _features).unpivot(["feature", "x", "seed"], TARGETS, "target", "y")
    scores = SE.absolute_correlations(long, ["target", "feature", "seed"])
    return scores.withColumnRenamed("score", "gain")


_stats = """SELECT target, feature, avg(gain) AS mean_gain, stddev_samp(gain) / (avg(gain) + 1e-9) AS cv_gain
FROM gains GROUP BY target, feature"""
_stable = """
SELECT *, row_number() OVER (PARTITION BY target ORDER BY mean_gain DESC, feature) AS place FROM (
  SELECT s.* FROM st s JOIN (SELECT target, quantile_cont(mean_gain, 0.5) AS med FROM st GROUP BY target) m USING (target)
  WHERE (coalesce(cv_gain, 0) <= {cv} OR mean_gain {op} med) {extra}) k"""


@query("stable_features", "TOP-3", "target:s feature:s mean_gain:d place:i", "gains",
       f"WITH st AS ({_stats}) SELECT * FROM ({_stable.format(cv=0.2, op='>=', extra='')}) z WHERE place <= 3")
def stable_features(spark, folder):
    return SE.stable_features(gains(spark, folder), 3, cv_limit=0.2)


@query("stable_usable_features", "TOP-3", "target:s feature:s mean_gain:d place:i", "gains train_keys amounts", f"""
WITH st AS ({_stats}), us AS (
  SELECT feature, avg(CASE WHEN x IS NULL THEN 1 ELSE 0 END) AS miss, var_samp(coalesce(x, med)) AS va FROM (
    SELECT *, quantile_cont(x, 0.5) OVER (PARTITION BY feature) AS med FROM (
      SELECT unnest([{", ".join(f"'{f}'" for f in _features)}]) AS feature, unnest([{", ".join(_features)}]) AS x
      FROM train_keys JOIN amounts USING (subject_id, lifelog_date)) a) b GROUP BY feature)
SELECT * FROM ({_stable.format(cv=0.2, op='>', extra="AND feature IN (SELECT feature FROM us WHERE miss < 0.5 AND va > 0.01)")}) z""")
def stable_usable_features(spark, folder):
    table = catalog.tables.C.attach_to_keys(keyed(spark, folder, "train"), catalog.tables.amounts(spark, folder))
    usable = SE.usable_features(SE.long_features(table, [], _features), 0.5, 0.01)
    return SE.stable_features(gains(spark, folder), None, 0.2, strict_median=True, usable=usable)


@query("top_importances", "TOP-4", "target:s feature:s mean_gain:d place:i", "gains", """
SELECT * FROM (SELECT target, feature, avg(gain) AS mean_gain, row_number() OVER (
    PARTITION BY target ORDER BY avg(gain) DESC, feature) AS place
  FROM gains WHERE feature IN ('amount', 'peak', 'd_all_row_cnt') GROUP BY target, feature) t WHERE place <= 2""")
def top_importances(spark, folder):
    return SE.top_importances(gains(spark, folder), ["amount", "peak", "d_all_row_cnt"], 2)


@query("best_subset_size", "TOP-6", "target:s best_k:s best_n:i full_oof:d best_oof:d delta:d", "scores", """
SELECT b.target, CASE b.run WHEN 'core' THEN 'all' WHEN 'slow' THEN '20' ELSE '7' END AS best_k,
  CASE b.run WHEN 'core' THEN 5 WHEN 'slow' THEN 20 ELSE 7 END AS best_n, f.score AS full_oof, b.score AS best_oof,
  f.score - b.score AS delta
FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, run) AS r FROM scores) b
JOIN (SELECT * FROM scores WHERE run = 'core') f USING (target) WHERE r = 1""")
def best_subset_size(spark, folder):
    run = F.col("run")
    name = F.when(run == "core", "all").when(run == "slow", "20").otherwise("7")
    size = F.when(run == "core", 5).when(run == "slow", 20).otherwise(7)
    results = train_scores(spark, folder).select(
        "target", name.alias("k"), size.alias("n"), run.alias("k_order"), F.col("score").alias("oof"))
    return SE.best_subset_size(results)


@query("candidate_ranking", "TOP-7", "rank:i candidate:s oof_mean:d notes:s", "scores", """
SELECT CASE run WHEN 'recent' THEN 1 ELSE 2 END AS rank, run AS candidate, avg(score) AS oof_mean,
  CASE run WHEN 'recent' THEN 'past week' ELSE 'subject prior' END AS notes
FROM scores WHERE run IN ('recent', 'core') GROUP BY run""")
def candidate_ranking(spark, folder):
    macro = SC.macro_scores(train_scores(spark, folder))
    return SE.candidate_ranking(macro, {"recent": (1, "past week"), "core": (2, "subject prior")})
