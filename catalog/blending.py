"""Blends, searches, calibration, guards, audits, sinks and registry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import KEYSPEC, columns, cte, dbl, query
from catalog.learning import ON, ROWSPEC, _busy, _clip, _ll, keyed, labels, pair, predictions, train_scores
from dayfold.operators import audit as AU
from dayfold.operators import blend as B
from dayfold.operators import guards as G
from dayfold.operators import neighbours as NB
from dayfold.operators import scoring as SC
from dayfold.operators.daily import DAY_SUMMARIES
from dayfold.plans import candidate as CP
from dayfold.schema import KEYS, LABEL_SCHEMA, TARGETS, TARGETWISE_PRIOR_WEIGHTS
from dayfold.session import cut_lineage, scratch_path
from dayfold.sources import adapters as S
from dayfold.sources import readers as RD
from dayfold.sources import sinks as K

PAIRSPEC = f"{ROWSPEC} p:d"
cte("train_pairs", "pairs", "SELECT * FROM pairs WHERE split = 'train'")
cte("test_pairs", "pairs", "SELECT * FROM pairs WHERE split = 'test'")


def by_target_sql(values: dict[str, float], default: str) -> str:
    cases = " ".join(f"WHEN '{t}' THEN {dbl(v)}" for t, v in values.items())
    return f"(CASE target {cases} ELSE {default} END)"


# ---- plain blends ---------------------------------------------------------------

_w = {"Q1": 0.27, "S2": 0.43, "S4": 1.5}


@query("mixed_runs", "BLD-1 BLD-15 SNK-11", PAIRSPEC, "test_pairs",
       f"SELECT *, (1 - w) * a + w * b AS p FROM (SELECT *, {by_target_sql(_w, '0')} AS w FROM test_pairs) t")
def mixed_runs(spark, folder):
    return B.mix_runs(pair(spark, folder, split="test"), _w)


@query("guarded_swap", "BLD-2", PAIRSPEC, "test_pairs",
       "SELECT *, CASE WHEN target IN ('S2', 'S4') THEN b ELSE a END AS p FROM test_pairs")
def guarded_swap(spark, folder):
    return B.swap_targets(pair(spark, folder, split="test"), ["S2", "S4"])


@query("guarded_blend", "BLD-2", PAIRSPEC, "test_pairs",
       "SELECT *, CASE WHEN target IN ('S2', 'S4') THEN -0.3 * a + 1.3 * b ELSE a END AS p FROM test_pairs")
def guarded_blend(spark, folder):
    return B.swap_targets(pair(spark, folder, split="test"), ["S2", "S4"], 1.3)


_soft = B.softblend_weights(0.9, 0.6, 1.0, "core", "recent", "slow")
_soft_cases = " ".join(f"WHEN target = '{t}' AND run = '{r}' THEN {dbl(w)}" for t, m in _soft.items() for r, w in m.items())


@query("softblend", "BLD-3 PRJ-4", f"{ROWSPEC} y:d p:d", "preds", f"""
SELECT subject_id, sleep_date, lifelog_date, target, any_value(y) AS y, {_busy(f'sum(p * CASE {_soft_cases} ELSE 0 END)')} AS p
FROM preds WHERE split = 'train' GROUP BY ALL""")
def softblend(spark, folder):
    df = predictions(spark, folder).where("split = 'train'")
    return B.weighted_runs(df, B.weight_rows(df, _soft))


_second = {t: {"core": 1.0} for t in TARGETS} | {"S2": {"core": 0.88, "slow": 0.12}, "S3": {"core": 0.94, "slow": 0.06}}


@query("second_stage_mix", "BLD-4", f"{ROWSPEC} p:d", "test_pairs", f"""
SELECT *, {_busy("CASE target WHEN 'S2' THEN 0.88 * a + 0.12 * c WHEN 'S3' THEN 0.94 * a + 0.06 * c ELSE a END")} AS p
FROM test_pairs""")
def second_stage_mix(spark, folder):
    df = predictions(spark, folder).where("split = 'test'")
    return B.weighted_runs(df, B.weight_rows(df, _second))


_kway = {t: {"core": 0.5, "slow": 0.2, "recent": 0.3} for t in TARGETS}


@query("weighted_blend_scores", "BLD-5 AGG-21", "target:s score:d", "train_pairs", f"""
SELECT target, avg({_ll('y', '(0.5 * a + 0.2 * c + 0.3 * b)')}) AS score FROM train_pairs GROUP BY target""")
def weighted_blend_scores(spark, folder):
    df = predictions(spark, folder).where("split = 'train'")
    blended = B.weighted_runs(df, B.weight_rows(df, _kway), clip=False)
    return SC.target_scores(blended.withColumn("run", F.lit("blend"))).drop("run")


_runs = ["core", "slow", "recent"]
_simplex = [(1 / 3, 1 / 3, 1 / 3), *B.simplex_grid(3), *B.random_simplex(3, 20, 42)]


def _values(rows) -> str:
    return ", ".join(f"({i}, {', '.join(dbl(float(x)) for x in r)})" for i, r in enumerate(rows))


@query("weight_search", "BLD-6 JOIN-12", "target:s config:i score:d w0:d w1:d w2:d", "train_pairs", f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, config) AS r FROM (
  SELECT target, config, w0, w1, w2, avg({_ll('y', '(w0 * a + w1 * c + w2 * b)')}) AS score
  FROM train_pairs CROSS JOIN (VALUES {_values(_simplex)}) g(config, w0, w1, w2) GROUP BY ALL) s) t WHERE r = 1""")
def weight_search(spark, folder):
    wide = B.runs_side_by_side(predictions(spark, folder).where("split = 'train'"), _runs)
    return B.weight_search(wide, _runs, [*B.simplex_grid(3), *B.random_simplex(3, 20, 42)])


def _grid_sql(weights: list[float], p: str) -> str:
    listed = ", ".join(f"({i}, {dbl(w)})" for i, w in enumerate(weights))
    return (f"SELECT target, config, weight, avg({_ll('y', p)}) AS score FROM train_pairs "
            f"CROSS JOIN (VALUES {listed}) g(config, weight) GROUP BY ALL")


def _best(grid: str) -> str:
    return (f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, config) AS r "
            f"FROM ({grid}) s) t WHERE r = 1")


_base = f"SELECT target, avg({_ll('y', 'a')}) AS la, avg({_ll('y', 'b')}) AS lb FROM train_pairs GROUP BY target"


@query("two_run_weights", "BLD-8 JOIN-12", "target:s weight:d score:d base_score:d", "train_pairs", f"""
SELECT target, CASE WHEN score < la THEN weight ELSE 1 END AS weight, least(score, la) AS score, la AS base_score
FROM ({_best(_grid_sql(B.even_grid(0.0, 1.0, 201), '(weight * a + (1 - weight) * b)'))}) g JOIN ({_base}) b USING (target)""")
def two_run_weights(spark, folder):
    return B.two_run_search(pair(spark, folder))


@query("capped_weights", "BLD-8", "target:s weight:d score:d base_score:d", "train_pairs", f"""
SELECT target, CASE WHEN score < la THEN weight ELSE 0 END AS weight, least(score, la) AS score, la AS base_score
FROM ({_best(_grid_sql([w for w in B.even_grid(0.0, 0.9, 46) if w <= 0.35], _busy('(1 - weight) * a + weight * b')))}) g
JOIN ({_base}) b USING (target)""")
def capped_weights(spark, folder):
    return B.capped_search(pair(spark, folder), 0.35)


@query("prior_alpha", "BLD-7", "target:s alpha:d score:d prior_score:d", "train_pairs", f"""
SELECT target, CASE WHEN score > la - 0.01 THEN 0 ELSE weight END AS alpha,
  CASE WHEN score > la - 0.01 THEN la ELSE score END AS score, la AS prior_score
FROM ({_best(_grid_sql(B.even_grid(0.0, 1.0, 21), '(weight * b + (1 - weight) * a)'))}) g JOIN ({_base}) b USING (target)""")
def prior_alpha(spark, folder):
    return B.prior_alpha(pair(spark, folder, "recent", "core"), 0.01)  # model: recent, prior: core


_small = [0.0, 0.05, 0.1, 0.15, 0.2]


@query("small_grid_weights", "BLD-9", "target:s weight:d score:d gain:d", "train_pairs", f"""
SELECT target, CASE WHEN keep THEN weight ELSE 0 END AS weight, CASE WHEN keep THEN score ELSE la END AS score,
  CASE WHEN keep THEN la - score ELSE 0 END AS gain
FROM (SELECT *, score < la AND la - score >= 0.000025 AND target NOT IN ('S4') AS keep
  FROM ({_best(_grid_sql(_small, _busy('(1 - weight) * a + weight * b')))}) g JOIN ({_base}) b USING (target)) t""")
def small_grid_weights(spark, folder):
    return B.small_grid_choice(pair(spark, folder), _small, ["S4"])


@query("drift_capped_weights", "BLD-10 AGG-23", "target:s weight:d score:d delta:d test_drift:d reason:s",
       "train_pairs test_pairs", f"""
WITH dr AS (SELECT target, avg(abs(b - a)) AS full_drift FROM test_pairs GROUP BY target),
gr AS ({_grid_sql(B.even_grid(0.0, 1.0, 1001), '((1 - weight) * a + weight * b)')}), ba AS ({_base}),
bs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, config) AS r
  FROM gr JOIN dr USING (target) JOIN ba USING (target)
  WHERE weight <= least(1, 0.005 / full_drift) + 1e-12 AND score - la < -1e-12 AND target <> 'S4') t WHERE r = 1)
SELECT dr.target, coalesce(bs.weight, 0) AS weight, coalesce(bs.score, ba.la) AS score,
  coalesce(bs.score - ba.la, 0) AS delta, coalesce(bs.weight, 0) * dr.full_drift AS test_drift,
  CASE WHEN dr.target = 'S4' THEN 'frozen' WHEN dr.full_drift = 0 THEN 'no test effect'
       WHEN bs.weight IS NULL THEN 'no improving drift-safe weight' ELSE 'selected' END AS reason
FROM dr JOIN ba USING (target) LEFT JOIN bs USING (target)""")
def drift_capped_weights(spark, folder):
    return B.drift_capped_search(pair(spark, folder), pair(spark, folder, split="test"), ["S4"])


# ---- extrapolation ------------------------------------------------------------------


@query("anti_blend", "BLD-11", PAIRSPEC, "test_pairs",
       "SELECT *, CASE WHEN target = 'S4' THEN a ELSE a - 0.75 * (b - a) END AS p FROM test_pairs")
def anti_blend(spark, folder):
    return B.anti_blend(pair(spark, folder, split="test"), 0.75, ["S4"])


for _mode, _step in (("symmetric", "(b - a)"), ("up", "greatest(b - a, 0)"), ("down", "least(b - a, 0)")):
    query(f"beta_{_mode}", "BLD-12", PAIRSPEC, "test_pairs",
          f"SELECT *, CASE WHEN target = 'S4' THEN {_busy('a + 6.5 * ' + _step)} ELSE a END AS p FROM test_pairs")(
        lambda spark, folder, mode=_mode: B.beta_step(pair(spark, folder, split="test"), 6.5, ["S4"], mode))


@query("gated_beta", "BLD-13 JOIN-10", PAIRSPEC, "test_pairs q_nearest_label_days", f"""
SELECT t.*, CASE WHEN target = 'S4' THEN {_busy('a + (CASE WHEN nearest_days <= 2 THEN 9.5 ELSE 6.5 END) * (b - a)')}
  ELSE a END AS p
FROM test_pairs t LEFT JOIN q_nearest_label_days USING (subject_id, sleep_date, lifelog_date)""")
def gated_beta(spark, folder):
    nearest = NB.nearest_label_days(keyed(spark, folder, "test"), keyed(spark, folder, "train"), exclude_own_day=False)
    return B.gated_beta(pair(spark, folder, split="test"), nearest, ["S4"], 6.5, 9.5, 2)


_alpha = {"Q1": 1.4, "Q3": 0.5, "S2": 2.0}


@query("target_push", "BLD-14", PAIRSPEC, "test_pairs", f"""
SELECT *, CASE WHEN alpha IS NULL THEN a ELSE {_busy('a + alpha * (b - a)')} END AS p
FROM (SELECT *, {by_target_sql(_alpha, 'NULL')} AS alpha FROM test_pairs) t""")
def target_push(spark, folder):
    return B.push(pair(spark, folder, split="test"), _alpha)


_prior_w = by_target_sql(TARGETWISE_PRIOR_WEIGHTS, "0")
cte("temporal_test", "preds targetwise_test", f"""
SELECT s.*, t.p AS prior_p, {_busy(f'(1 - {_prior_w}) * s.p + {_prior_w} * t.p')} AS blend_p
FROM preds s JOIN targetwise_test t USING (subject_id, sleep_date, lifelog_date, target)
WHERE s.run = 'core' AND s.split = 'test'""")


@query("temporal_candidate", "BLD-15 PRI-8", f"{ROWSPEC} a:d b:d p:d", "temporal_test",
       "SELECT subject_id, sleep_date, lifelog_date, target, p AS a, prior_p AS b, blend_p AS p FROM temporal_test")
def temporal_candidate(spark, folder):
    base = predictions(spark, folder).where("run = 'core'")
    return CP.temporal_candidate(base, labels(spark, folder, "train"))[1]


# ---- calibration ---------------------------------------------------------------------

_temper = lambda p, t, b: _busy(
    f"1 / (1 + exp(-({t} * ln({_clip(p)} / (1 - {_clip(p)})) + {b})))")
_cal_grid = ", ".join(f"({i}, {dbl(g['temp'])}, {dbl(g['bias'])})" for i, g in enumerate(B.calibration_grid()))
cte("cal_best", "train_pairs", f"""
SELECT target, CASE WHEN score < la THEN temp ELSE 1 END AS temp, CASE WHEN score < la THEN bias ELSE 0 END AS bias,
  least(score, la) AS score
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY score, config) AS r FROM (
    SELECT target, config, temp, bias, avg({_ll('y', _temper('a', 'temp', 'bias'))}) AS score
    FROM train_pairs CROSS JOIN (VALUES {_cal_grid}) g(config, temp, bias) GROUP BY ALL) s) t WHERE r = 1) g
JOIN ({_base}) b USING (target)""")


def anchor(spark, folder, split: str):
    return predictions(spark, folder).where((F.col("run") == "core") & (F.col("split") == split))


@query("calibration_search", "BLD-16 PRJ-5 JOIN-12", "target:s temp:d bias:d score:d", "cal_best",
       "SELECT * FROM cal_best")
def calibration_search(spark, folder):
    return B.calibration_search(anchor(spark, folder, "train"))


# fixed parameters stand for a stored calibration summary
_params = {t: (0.9 + 0.02 * i, 0.01 * i - 0.03) for i, t in enumerate(TARGETS)}
_tight = {"Q3": (0.8, 0.1), "S1": (1.1, -0.1)}
cte("cal_params", "", "SELECT * FROM (VALUES " + ", ".join(
    f"('{t}', {dbl(a)}, {dbl(b)})" for t, (a, b) in _params.items()) + ") v(target, temp, bias)")


def stored_params(df):
    rows = [(t, float(a), float(b)) for t, (a, b) in _params.items()]
    return df.sparkSession.createDataFrame(rows, "target string, temp double, bias double")


@query("calibrated_partly", "BLD-17 PRJ-5", PAIRSPEC, "test_pairs cal_params", f"""
SELECT *, {_busy(f"0.4 * a + 0.6 * {_temper('a', 'temp', 'bias')}")} AS p FROM test_pairs JOIN cal_params USING (target)""")
def calibrated_partly(spark, folder):
    rows = anchor(spark, folder, "test")
    return B.apply_calibration(rows, stored_params(rows), 0.6)


@query("calibrated_with_overrides", "BLD-17", PAIRSPEC, "test_pairs cal_params", f"""
SELECT *, {_temper('a', 't', 'b2')} AS p FROM (SELECT *,
  CASE target WHEN 'Q3' THEN 0.8 WHEN 'S1' THEN 1.1 ELSE temp END AS t,
  CASE target WHEN 'Q3' THEN 0.1 WHEN 'S1' THEN -0.1 ELSE bias END AS b2
  FROM test_pairs JOIN cal_params USING (target)) x""")
def calibrated_with_overrides(spark, folder):
    rows = anchor(spark, folder, "test")
    return B.apply_calibration(rows, B.override_params(stored_params(rows), _tight))


@query("calibrated_between", "BLD-17", PAIRSPEC, "test_pairs cal_params", f"""
SELECT *, {_temper('a', 't', 'b2')} AS p FROM (SELECT *,
  temp + 1.5 * (CASE target WHEN 'Q3' THEN 0.8 - temp WHEN 'S1' THEN 1.1 - temp ELSE 0 END) AS t,
  bias + 1.5 * (CASE target WHEN 'Q3' THEN 0.1 - bias WHEN 'S1' THEN -0.1 - bias ELSE 0 END) AS b2
  FROM test_pairs JOIN cal_params USING (target)) x""")
def calibrated_between(spark, folder):
    rows = anchor(spark, folder, "test")
    return B.apply_calibration(rows, B.interpolate_params(stored_params(rows), _tight, 1.5))


# ---- guards and selection ---------------------------------------------------------------

cte("effects", "train_pairs test_pairs", f"""
SELECT target, lb - la AS delta, drift FROM ({_base}) b
JOIN (SELECT target, avg(abs(b - a)) AS drift FROM test_pairs GROUP BY target) d USING (target)""")
_verdict = """
SELECT '{name}' AS candidate, improved, worst_loss, worst_drift, CAST(f = '' AS INTEGER) AS approved, f AS failures
FROM (SELECT *, concat_ws('; ', {named} CASE WHEN improved < 2 THEN 'too few improved targets' END,
    CASE WHEN worst_loss > {loss} THEN 'target loss too large' END,
    CASE WHEN worst_drift > {drift} THEN 'test drift too large' END,
    CASE WHEN worst_drift <= 1e-12 THEN 'no test effect' END {weights}) AS f
  FROM (SELECT count(*) FILTER (target <> 'S4' AND delta < 0) AS improved, greatest(max(delta), 0) AS worst_loss,
          max(drift) AS worst_drift FROM {effects}) e) t"""
_guardspec = "candidate:s improved:i worst_loss:d worst_drift:d approved:i failures:s"


@query("guard_rejected", "BLD-18 AGG-21 AGG-23", _guardspec, "effects", _verdict.format(
    name="qshead_v1", named="'forbidden name',", loss="0.00005", drift="0.005", weights=", 'all weights zero'",
    effects="effects"))
def guard_rejected(spark, folder):
    effects = G.target_effects(pair(spark, folder), pair(spark, folder, split="test"))
    return G.guard_candidate(effects, "qshead_v1", weights=G.numeric_leaves({"w": {"Q1": 0.0, "Q2": [0]}}))


@query("guard_wide_limits", "BLD-18", _guardspec, "effects", _verdict.format(
    name="weekly", named="", loss="2.0", drift="0.9", weights="", effects="effects"))
def guard_wide_limits(spark, folder):
    effects = G.target_effects(pair(spark, folder), pair(spark, folder, split="test"))
    return G.guard_candidate(effects, "weekly", [0.3], max_loss=2.0, max_drift=0.9)


cte("options", "train_pairs test_pairs", f"""
SELECT o.target, o.candidate, o.score, CASE WHEN d.mean_abs <= 0.02 AND d.max_abs <= 0.08 THEN 1 ELSE 0 END AS drift_ok, o.base_score
FROM (SELECT target, 'b10' AS candidate, avg({_ll('y', '(0.9 * a + 0.1 * b)')}) AS score, avg({_ll('y', 'a')}) AS base_score
      FROM train_pairs GROUP BY target
      UNION ALL SELECT target, 'c50', avg({_ll('y', '(0.5 * a + 0.5 * c)')}), avg({_ll('y', 'a')}) FROM train_pairs GROUP BY target) o
JOIN (SELECT target, 'b10' AS candidate, avg(abs(0.1 * (b - a))) AS mean_abs, max(abs(0.1 * (b - a))) AS max_abs
      FROM test_pairs GROUP BY target
      UNION ALL SELECT target, 'c50', avg(abs(0.5 * (c - a))), max(abs(0.5 * (c - a))) FROM test_pairs GROUP BY target) d
  USING (target, candidate)""")


def options(spark, folder):
    def one(name: str, run: str, weight: float):
        weights = {t: weight for t in TARGETS}
        blended = B.mix_runs(pair(spark, folder, "core", run), weights)
        moved = B.mix_runs(pair(spark, folder, "core", run, "test"), weights)
        scores = blended.groupBy("target").agg(SC.log_loss().alias("score"))
        limits = SC.drift(moved, 0.02, 0.08, ("a", "p")).select("target", F.col("ok").alias("drift_ok"))
        return scores.join(limits, "target").withColumn("candidate", F.lit(name))

    base = anchor(spark, folder, "train").groupBy("target").agg(SC.log_loss().alias("score"))
    return one("b10", "recent", 0.1).unionByName(one("c50", "slow", 0.5)), base


def _choice(feasible: str) -> str:
    return f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY tier, score, candidate) AS r FROM (
  SELECT target, candidate, score, drift_ok, 0 AS tier, base_score FROM options WHERE {feasible}
  UNION ALL SELECT DISTINCT target, 'baseline', base_score, 1, 1, base_score FROM options) u) t WHERE r = 1"""


_primary = "score <= base_score + CASE WHEN target IN ('Q1', 'Q2') THEN 0 ELSE 0.001 END"
_choicespec = "target:s candidate:s score:d drift_ok:i"


@query("selected_candidates", "BLD-19", _choicespec, "options", _choice(_primary))
def selected_candidates(spark, folder):
    candidates, base = options(spark, folder)
    return G.select_per_target(candidates, base, ["Q1", "Q2"], 0.001)


@query("selected_with_fallback", "BLD-19", f"{_choicespec} used_safe:i", "options", f"""
WITH pr AS ({_choice(_primary)}), sf AS ({_choice('score <= base_score - 0.0002 AND drift_ok = 1')}),
v AS (SELECT CAST(avg(score) > avg(base_score) + 0.0001 OR max(CAST(candidate <> 'baseline' AND drift_ok <> 1 AS INTEGER)) = 1
      AS INTEGER) AS failed FROM pr)
SELECT pr.target, pr.candidate, pr.score, pr.drift_ok, failed AS used_safe FROM pr, v WHERE failed = 0
UNION ALL SELECT sf.target, sf.candidate, sf.score, sf.drift_ok, failed FROM sf, v WHERE failed = 1""")
def selected_with_fallback(spark, folder):
    candidates, base = map(cut_lineage, options(spark, folder))  # a few rows a target; both selections and the verdict read them
    primary = G.select_per_target(candidates, base, ["Q1", "Q2"], 0.001)
    safe = G.select_per_target(candidates, base, [], 0.0, min_gain=0.0002)
    return G.with_global_fallback(primary, safe, base, 0.0001)


_stored = {t: {"core": 0.5, "gone": 0.2, "recent": 0.3 if t != "Q2" else 0.0} for t in TARGETS} | {
    "S4": {"core": 0.0, "gone": 1.0, "recent": 0.0}}
cte("renormed", "", "SELECT target, run, CASE WHEN sum(w) OVER (PARTITION BY target) > 0 THEN "
    "w / sum(w) OVER (PARTITION BY target) ELSE 1.0 / count(*) OVER (PARTITION BY target) END AS weight FROM (VALUES "
    + ", ".join(f"('{t}', '{r}', {dbl(w)})" for t, m in _stored.items() for r, w in m.items() if r != "gone")
    + ") v(target, run, w)")


def renormed(df):
    return B.available_weights(B.weight_rows(df, _stored), ["core", "recent"])


@query("renormalised_blend", "BLD-20 BLD-5", PAIRSPEC, "preds renormed", f"""
SELECT subject_id, sleep_date, lifelog_date, target, {_busy('sum(weight * p)')} AS p
FROM preds JOIN renormed USING (target, run) WHERE split = 'test' GROUP BY ALL""")
def renormalised_blend(spark, folder):
    df = predictions(spark, folder).where("split = 'test'")
    return B.weighted_runs(df, renormed(df))


@query("weight_report", "BLD-21", "target:s core:d recent:d rows:i", "preds renormed", """
SELECT target, max(weight) FILTER (run = 'core') AS core, max(weight) FILTER (run = 'recent') AS recent, any_value(n) AS rows
FROM renormed JOIN (SELECT target, count(*) AS n FROM preds WHERE run = 'core' GROUP BY target) USING (target) GROUP BY target""")
def weight_report(spark, folder):
    df = predictions(spark, folder)
    counts = df.where("run = 'core'").groupBy("target").agg(F.count("*").alias("rows"))
    return B.weight_report(renormed(df), ["core", "recent"]).join(counts, "target")


@query("targetwise_assembly", "BLD-22 PRJ-23", f"{ROWSPEC} run:s p:d", "preds", """
SELECT * FROM preds WHERE split = 'test' AND run = CASE WHEN target IN ('Q2', 'S4') THEN 'recent'
  WHEN target = 'Q3' THEN 'slow' ELSE 'core' END""")
def targetwise_assembly(spark, folder):
    from dayfold.operators.encode import target_views

    runs = {"public_core": "core", "public_hist411": "recent", "public_hist365": "slow"}
    df = predictions(spark, folder).where("split = 'test'")
    return B.assemble_by_view(df, target_views(preset="histmix_guarded_v1"), runs)


# ---- audits --------------------------------------------------------------------------------


@query("label_profile", "AUD-1", f"row_cnt:i subjects:i sleep_dates:i lifelog_dates:i {columns('d', ['rate_' + t for t in TARGETS])}",
       "train_keys", "SELECT count(*) AS row_cnt, count(DISTINCT subject_id) AS subjects, "
       "count(DISTINCT sleep_date) AS sleep_dates, count(DISTINCT lifelog_date) AS lifelog_dates, "
       + ", ".join(f'avg("{t}") AS "rate_{t}"' for t in TARGETS) + " FROM train_keys")
def label_profile(spark, folder):
    return AU.label_profile(keyed(spark, folder, "train"))


@query("order_delay_histogram", "AUD-1", "delta_days:i row_cnt:i", "", """
SELECT date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delta_days, count(*) AS row_cnt
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def order_delay_histogram(spark, folder):
    pairs = S.table(spark, folder, "lineitem").join(
        S.table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return AU.day_delta_histogram(pairs.select(
        F.to_date("l_shipdate").alias("sleep_date"), F.to_date("o_orderdate").alias("lifelog_date")))


_profiles = {m: f"s_{m}" for m in DAY_SUMMARIES}  # all twelve logs
_profile_sql = " UNION ALL ".join(
    f"SELECT '{m}' AS modality, sum(n) AS row_cnt, count(DISTINCT subject_id) AS subjects, "
    f"strftime(min(day), '%Y-%m-%d') AS day_min, strftime(max(day), '%Y-%m-%d') AS day_max, avg(n) AS daily_mean "
    f"FROM (SELECT subject_id, day, count(*) AS n FROM {s} GROUP BY ALL) t" for m, s in _profiles.items())
_profilespec = "modality:s row_cnt:i subjects:i day_min:s day_max:s daily_mean:d"


@query("modality_profiles", "AUD-2", _profilespec, " ".join(_profiles.values()), _profile_sql)
def modality_profiles(spark, folder):
    logs = S.sensor_logs(spark, folder)
    parts = [AU.modality_profile(logs[m], m) for m in _profiles]
    return reduce(DataFrame.unionByName, parts)


@query("schema_contract", "AUD-3", f"{_profilespec} key_rows:i train_rows:i test_rows:i",
       " ".join([*_profiles.values(), "keyed_labels"]), f"""
SELECT p.*, k.* FROM ({_profile_sql}) p, (SELECT count(*) AS key_rows, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'test') AS test_rows FROM keyed_labels) k""")
def schema_contract(spark, folder):
    logs = S.sensor_logs(spark, folder)
    return AU.contract(keyed(spark, folder), {m: logs[m] for m in _profiles})


@query("date_rule_violations", "AUD-3", KEYSPEC, "keyed_labels",
       "SELECT * FROM keyed_labels WHERE date_diff('day', lifelog_date, sleep_date) <> 1")
def date_rule_violations(spark, folder):
    return AU.date_rule_violations(keyed(spark, folder))


@query("compact_text", "AUD-4", "doc_id:i sample:s", "", """
SELECT doc_id, CASE WHEN length(text) > 220 THEN substr(text, 1, 217) || '...' ELSE text END AS sample FROM documents""")
def compact_text(spark, folder):
    from dayfold.functions.scalar import compact_text as cut

    return S.table(spark, folder, "documents").select("doc_id", cut("text").alias("sample"))


@query("sensor_samples", "AUD-2 AUD-4", "subject_id:s timestamp:s heart_rate:s")
def sensor_samples(spark, folder):
    return AU.sample_rows(S.sensor_logs(spark, folder)["whr"])


@query("input_check", "AUD-5", "row_cnt:i missing_columns:s ok:i", "train_keys", """
SELECT count(*) AS row_cnt, 'Q9' AS missing_columns, 0 AS ok FROM train_keys""")
def input_check(spark, folder):
    return AU.input_check(keyed(spark, folder, "train"), 450, [*TARGETS, "Q9"])


@query("range_check", "AUD-6", "run:s target:s row_cnt:i bad_cnt:i low:d high:d ok:i", "preds", """
SELECT run, target, count(*) AS row_cnt, 0 AS bad_cnt, min(p) AS low, max(p) AS high,
  CAST(min(p) >= 0.02 - 1e-12 AND max(p) <= 0.98 + 1e-12 AS INTEGER) AS ok FROM preds GROUP BY run, target""")
def range_check(spark, folder):
    return AU.range_check(predictions(spark, folder), 0.02, 0.98, ["run", "target"])


@query("misaligned_rows", "AUD-7", f"{ROWSPEC} y:d side:s", "long_labels", """
SELECT subject_id, sleep_date, lifelog_date, target, CASE WHEN flip THEN 1 - y ELSE y END AS y, side FROM (
  SELECT *, target = 'Q2' AND subject_id = 'id7' AS flip, unnest(['left', 'right']) AS side FROM long_labels
  WHERE split = 'train') t WHERE (flip AND side = 'right')
UNION ALL SELECT subject_id, sleep_date, lifelog_date, target, y, 'left' FROM long_labels
WHERE split = 'train' AND target = 'Q2' AND subject_id = 'id7'""")
def misaligned_rows(spark, folder):
    left = labels(spark, folder, "train")
    flip = (F.col("target") == "Q2") & (F.col("subject_id") == "id7")
    right = left.withColumn("y", F.when(flip, 1 - F.col("y")).otherwise(F.col("y")))
    return AU.misaligned_rows(left, right, [*ON, "y"])


@query("output_comparison", "AUD-8", "unmatched:i max_abs_diff:d null_mismatch:i ok:i", "test_pairs", """
SELECT count(*) FILTER (subject_id = 'id3') AS unmatched, max(abs(a - c)) FILTER (subject_id <> 'id3') AS max_abs_diff,
  0 AS null_mismatch, 0 AS ok FROM test_pairs""")
def output_comparison(spark, folder):
    df = predictions(spark, folder).where("split = 'test'")
    return AU.compare_outputs(df.where("run = 'core'"), df.where("run = 'slow' AND subject_id <> 'id3'"), 1e-10)


@query("validation_scheme", "AUD-9", "validation_scheme:s", "f_group f_time", """
SELECT string_agg(split_scheme, '+' ORDER BY split_scheme) AS validation_scheme FROM (
  SELECT DISTINCT split_scheme FROM (SELECT * FROM f_group UNION ALL SELECT * FROM f_time) m) d""")
def validation_scheme(spark, folder):
    from dayfold.operators.folds import fold_manifest

    return AU.validation_scheme(fold_manifest(keyed(spark, folder, "train")))


@query("table_report", "AUD-10 PRJ-20", "row_cnt:i column_cnt:i numeric_cnt:i train_rows:i test_rows:i", "keyed_labels", """
SELECT count(*) AS row_cnt, 11 AS column_cnt, 7 AS numeric_cnt, count(*) FILTER (split = 'train') AS train_rows,
  count(*) FILTER (split = 'test') AS test_rows FROM keyed_labels""")
def table_report(spark, folder):
    return AU.table_report(keyed(spark, folder))


# ---- sources and sinks: written to the shared folder and read back -----------------------------


@query("label_csv_scan", "SRC-1", f"{KEYSPEC} split:s {columns('i', TARGETS)}", "train_keys", "SELECT * FROM train_keys")
def label_csv_scan(spark, folder):
    path = scratch_path(spark, "labels")
    K.write_csv(keyed(spark, folder, "train").select(*KEYS, *TARGETS), path)
    return RD.read_labels(spark, path)


@query("template_csv_scan", "SRC-2", f"{KEYSPEC} split:s known:i", "keyed_labels",
       "SELECT *, 0 AS known FROM keyed_labels WHERE split = 'test'")
def template_csv_scan(spark, folder):
    path = scratch_path(spark, "template")
    days = S.day_labels(spark, folder).where(S.is_test_day())
    K.write_csv(days.select(*KEYS, *TARGETS), path)  # whatever targets the file has are dropped
    known = sum((F.col(t).isNotNull().cast("int") for t in TARGETS), F.lit(0))
    return RD.read_template(spark, path).withColumn("known", known)


@query("sensor_scan", "SRC-3 PRJ-19", "subject_id:s timestamp:s samples:i missing:i", "s_whr", """
SELECT subject_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, coalesce(len(heart_rate), -1) AS samples,
  coalesce(len(list_filter(heart_rate, lambda x: isnan(x))), -1) AS missing FROM s_whr""")
def sensor_scan(spark, folder):
    path = scratch_path(spark, "heart")
    K.write_table(S.sensor_logs(spark, folder)["whr"], path)
    df = RD.read_sensor(spark, path)
    missing = F.size(F.filter("heart_rate", lambda x: x.isNull()))
    return df.select("subject_id", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
                     F.coalesce(F.size("heart_rate"), F.lit(-1)).alias("samples"),
                     F.coalesce(missing, F.lit(-1)).alias("missing"))


@query("modality_discovery", "SRC-4", "files:i row_cnt:i", "", """
SELECT 1 AS files, count(*) AS row_cnt FROM events""")
def modality_discovery(spark, folder):
    df = RD.read_modalities(spark, f"{folder}/events.parquet")
    return df.agg(F.count_distinct("file").alias("files"), F.count("*").alias("row_cnt"))


@query("key_frame", "SRC-5 SET-1 SET-2", f"{KEYSPEC} split:s y:d", "days", """
SELECT subject_id, sleep_date, lifelog_date, CASE WHEN t THEN 'test' ELSE 'train' END AS split,
  CASE WHEN NOT t THEN "Q1" END AS y
FROM (SELECT *, dayofmonth(lifelog_date) BETWEEN 10 AND 15 OR dayofmonth(lifelog_date) >= 26 AS t FROM days) d""")
def key_frame(spark, folder):
    days = S.day_labels(spark, folder)
    train = days.where(~S.is_test_day()).withColumn("split", F.lit("train"))
    tenth = F.dayofmonth("lifelog_date") == 10  # keys present in both splits
    test = days.where(S.is_test_day() | tenth).select(
        *KEYS, *[F.lit(None).cast("int").alias(t) for t in TARGETS], F.lit("test").alias("split"))
    return RD.key_frame(train, test).withColumn("y", F.col("Q1"))


@query("split_counts", "AUD-3 PRJ-24", "split:s row_cnt:i", "keyed_labels",
       "SELECT split, count(*) AS row_cnt FROM keyed_labels GROUP BY split")
def split_counts(spark, folder):
    return AU.split_counts(keyed(spark, folder))


_wide_sql = "SELECT subject_id, sleep_date, lifelog_date, " + ", ".join(
    f"max(a) FILTER (target = '{t}') AS \"{t}\"" for t in TARGETS) + " FROM test_pairs GROUP BY ALL"
cte("wide_test", "test_pairs", _wide_sql)


@query("prediction_csv", "SNK-2 PRJ-4 JOIN-11", f"{KEYSPEC} {columns('d', TARGETS)}", "wide_test",
       "SELECT subject_id, sleep_date, lifelog_date, " + ", ".join(f'{_busy(chr(34) + t + chr(34))} AS "{t}"' for t in TARGETS)
       + " FROM wide_test")
def prediction_csv(spark, folder):
    path = scratch_path(spark, "predictions")
    out = K.clipped_output(K.wide_predictions(anchor(spark, folder, "test")))
    K.write_csv(out, path)
    return spark.read.schema(out.schema).option("header", True).csv(path)


@query("fixed_decimal_csv", "SNK-3", f"subject_id:s sleep_date:s lifelog_date:s {columns('d', TARGETS)} width:i", "wide_test", f"""
SELECT subject_id, strftime(sleep_date, '%Y-%m-%d') AS sleep_date, strftime(lifelog_date, '%Y-%m-%d') AS lifelog_date,
  {", ".join(f'"{t}"' for t in TARGETS)}, 84 AS width FROM wide_test""")
def fixed_decimal_csv(spark, folder):
    out = K.fixed_decimal_output(K.wide_predictions(anchor(spark, folder, "test")))
    width = sum((F.length(t) for t in TARGETS), F.lit(0))  # twelve characters each
    return out.withColumn("width", width).withColumns({t: F.col(t).cast("double") for t in TARGETS})


@query("write_policies", "SNK-4 AUD-8", "first_write:i second_write:i refused:i row_cnt:i", "wide_test",
       "SELECT 1 AS first_write, 0 AS second_write, 1 AS refused, count(*) AS row_cnt FROM wide_test")
def write_policies(spark, folder):
    path = scratch_path(spark, "once")
    wide = K.clipped_output(K.wide_predictions(anchor(spark, folder, "test")))
    first, second = K.write_csv_idempotent(wide, path), K.write_csv_idempotent(wide, path)
    try:
        K.write_csv_idempotent(wide.withColumn("Q1", F.col("Q1") / 2), path)
        refused = 0
    except ValueError:
        refused = 1
    stored = spark.read.option("header", True).csv(path)
    return stored.agg(F.count("*").alias("row_cnt")).select(
        "row_cnt", F.lit(int(first)).alias("first_write"), F.lit(int(second)).alias("second_write"),
        F.lit(refused).alias("refused"))


@query("table_sink", "SNK-1 SNK-10", f"run:s {ROWSPEC} split:s p:d", "preds",
       "SELECT * FROM preds WHERE run = 'slow' AND split = 'test'")
def table_sink(spark, folder):
    path = scratch_path(spark, "runs")
    K.write_table(predictions(spark, folder), path, ["run", "split"])
    return RD.load_run(spark.read.parquet(path), "slow", "test")


@query("run_summary", "SNK-5", "name:s scheme:s mean:d score_q1:d stages:i notes:i", "scores", """
SELECT 'core' AS name, 'loo' AS scheme, avg(score) AS mean, max(score) FILTER (target = 'Q1') AS score_q1, 1 AS stages,
  2 AS notes FROM scores WHERE run = 'core'""")
def run_summary(spark, folder):
    path = scratch_path(spark, "summary")
    scores = {r["target"]: r["score"] for r in train_scores(spark, folder).where("run = 'core'").collect()}  # 7 rows
    mean = sum(scores.values()) / len(scores)
    K.write_run_summary(K.run_summary(spark, {
        "name": "core", "model_family": "prior", "feature_view": "none", "split_scheme": "loo", "mean_log_loss": mean,
        "std_log_loss": 0.0, "target_scores": scores, "calibration": "none", "improvement_over_dummy": 0.0,
        "accepted": True, "paper_relevance": "", "score_breakdown": {"raw": scores}, "notes": ["a", "b"]}), path)
    back = spark.read.schema(K.RUN_SUMMARY_SCHEMA).json(path)
    return back.select("name", F.col("split_scheme").alias("scheme"), F.col("mean_log_loss").alias("mean"),
                       F.col("target_scores")["Q1"].alias("score_q1"), F.size("score_breakdown").alias("stages"),
                       F.size("notes").alias("notes"))


@query("run_log_append", "SNK-6", "run:s entries:i mean:d", "scores",
       "SELECT run, 2 AS entries, avg(score) AS mean FROM scores GROUP BY run")
def run_log_append(spark, folder):
    path = scratch_path(spark, "log")
    macro = SC.macro_scores(train_scores(spark, folder))
    K.append_log(macro, path)
    K.append_log(macro, path)
    return spark.read.schema(macro.schema).parquet(path).groupBy("run").agg(
        F.count("*").alias("entries"), F.avg("mean").alias("mean"))


@query("run_log_upsert", "SNK-7", "experiment_name:s mean:d", "scores", """
SELECT run AS experiment_name, avg(score) + CASE WHEN run = 'core' THEN 1 ELSE 0 END AS mean FROM scores GROUP BY run""")
def run_log_upsert(spark, folder):
    path = scratch_path(spark, "upsert")
    macro = SC.macro_scores(train_scores(spark, folder)).select(F.col("run").alias("experiment_name"), "mean")
    K.upsert_log(spark, path, macro.where("experiment_name <> 'slow'"))
    K.upsert_log(spark, path, macro.where("experiment_name <> 'recent'"))
    K.upsert_log(spark, path, macro.where("experiment_name = 'core'").withColumn("mean", F.col("mean") + 1))
    return K.read_log(spark, path)


@query("prediction_bundle", "SNK-8 SNK-11", f"{KEYSPEC} split_scheme:s model_family:s {columns('i', TARGETS)} "
       + columns("d", [f"{t}_lgb" for t in TARGETS]), "train_pairs",
       "SELECT subject_id, sleep_date, lifelog_date, 'loo' AS split_scheme, 'prior' AS model_family, "
       + ", ".join(f"max(y) FILTER (target = '{t}') AS \"{t}\", max(a) FILTER (target = '{t}') AS \"{t}_lgb\"" for t in TARGETS)
       + " FROM train_pairs GROUP BY subject_id, sleep_date, lifelog_date")
def prediction_bundle(spark, folder):
    return K.prediction_bundle(anchor(spark, folder, "train"), "loo", "prior", "lgb")


@query("prediction_columns", "SNK-11", f"{KEYSPEC} {columns('d', TARGETS)}", "train_pairs",
       "SELECT subject_id, sleep_date, lifelog_date, " + ", ".join(
           f"max(a) FILTER (target = '{t}') AS \"{t}\"" for t in TARGETS)
       + " FROM train_pairs GROUP BY subject_id, sleep_date, lifelog_date")
def prediction_columns(spark, folder):
    return RD.prediction_columns(prediction_bundle(spark, folder))


@query("run_reuse", "SNK-9", "run:s folds:i view:s mean:d", "scores", """
SELECT run, CASE run WHEN 'slow' THEN 3 ELSE 5 END AS folds, CASE run WHEN 'recent' THEN 'hist' END AS view,
  avg(score) AS mean FROM scores WHERE run = 'core' GROUP BY run""")
def run_reuse(spark, folder):
    run = F.col("run")
    registry = SC.macro_scores(train_scores(spark, folder)).select(
        "run", F.when(run == "slow", 3).otherwise(5).alias("folds"), F.when(run == "recent", "hist").alias("view"), "mean")
    request = spark.createDataFrame([(5, None)], "folds int, view string")
    return K.matching_runs(registry, request, ["folds", "view"])
