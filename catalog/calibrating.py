"""Calibration and ordered statistics of all targets and folds, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import columns, cte, query
from catalog.learning import ROWSPEC, _seeds, labels, predictions
from dayfold.operators import calibration as CA
from dayfold.operators import folds as V
from dayfold.operators import ordered as O
from dayfold.schema import KEYS

FOLDS = 5
STEPS = CA.NEWTON_STEPS
_clip = "least(greatest({0}, CAST('1e-6' AS DOUBLE)), CAST('0.999999' AS DOUBLE))"
_key = "subject_id, sleep_date, lifelog_date"


def rounded(rows):
    """Nine places, so that scores that are equal but for the order of a sum are one score on both sides."""
    return rows.withColumn("p", F.round("p", 9))


def folded(spark, folder, run: str):
    """Training predictions of a run with the stratified fold of each row."""
    folds = V.stratified_folds(labels(spark, folder, "train"), FOLDS, _seeds[:1]).select(*KEYS, "target", "fold_id")
    rows = predictions(spark, folder).where((F.col("run") == run) & (F.col("split") == "train"))
    return rounded(rows).join(folds, [*KEYS, "target"])


cte("fold_of", "f_strat", f"SELECT {_key}, target, fold_id FROM f_strat WHERE seed = {_seeds[0]}")
for _run in ("core", "recent"):
    cte(f"folded_{_run}", "preds fold_of", f"""
SELECT {_key}, target, y, fold_id, {_clip.format('round(p, 9)')} AS p FROM preds JOIN fold_of USING ({_key}, target)
WHERE run = '{_run}' AND split = 'train' AND y IS NOT NULL""")
    cte(f"held_{_run}", f"folded_{_run}", f"""
SELECT target, held, p, count(*) AS n, sum(y) AS s
FROM folded_{_run} JOIN (SELECT unnest(range({FOLDS})) AS held) h ON held <> fold_id GROUP BY target, held, p""")

# The fit at a score is the largest over starts of the smallest over ends of the means of what lies between.
cte("iso_placed", "held_core", """
SELECT *, row_number() OVER w AS i, sum(n) OVER w AS cn, sum(s) OVER w AS cs FROM held_core
WINDOW w AS (PARTITION BY target, held ORDER BY p)""")
cte("iso_means", "iso_placed", """
SELECT a.target, a.held, a.i AS a, b.i AS b, (b.cs - a.cs + a.s)::DOUBLE / (b.cn - a.cn + a.n) AS m
FROM iso_placed a JOIN iso_placed b ON a.target = b.target AND a.held = b.held AND a.i <= b.i""")
cte("iso_fit", "iso_means iso_placed", """
SELECT p.target, p.held, p.p, f.v FROM (
  SELECT target, held, b AS i, max(least_after) AS v FROM (
    SELECT *, min(m) OVER (PARTITION BY target, held, a ORDER BY b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS least_after
    FROM iso_means) t GROUP BY target, held, b) f
JOIN iso_placed p USING (target, held, i)
JOIN (SELECT target, held FROM held_core GROUP BY target, held HAVING sum(n) >= 10 AND sum(s) > 0 AND sum(s) < sum(n)) g USING (target, held)""")


@query("isotonic_by_fold", "ML-6", f"{ROWSPEC} fold_id:i y:d p:d", "folded_core iso_fit", f"""
SELECT {_key}, target, fold_id, y, {_clip.format('''CASE WHEN below IS NULL AND above IS NULL THEN p
  WHEN below IS NULL THEN above_v WHEN above IS NULL OR above = below THEN below_v
  ELSE below_v + (p - below) / (above - below) * (above_v - below_v) END''')} AS p
FROM (SELECT r.*, lo.p AS below, lo.v AS below_v, hi.p AS above, hi.v AS above_v
  FROM folded_core r
  ASOF LEFT JOIN iso_fit lo ON lo.target = r.target AND lo.held = r.fold_id AND r.p >= lo.p
  ASOF LEFT JOIN iso_fit hi ON hi.target = r.target AND hi.held = r.fold_id AND r.p <= hi.p) t""")
def isotonic_by_fold(spark, folder):
    """Seven targets, five folds, each calibrated by the isotonic fit on the other folds."""
    return CA.isotonic_out_of_fold(folded(spark, folder, "core"), list(range(FOLDS)))


def newton_sql(counts: str, by: str, name: str) -> str:
    """Defines one CTE for each Newton step; returns the name of the last."""
    cte(f"{name}_z", counts, f"SELECT {by}, ln(p / (1 - p)) AS z, n, s FROM {counts}")
    cte(f"{name}_0", f"{name}_z", f"""
SELECT {by}, CAST(0 AS DOUBLE) AS slope, ln(sum(s)::DOUBLE / (sum(n) - sum(s))) AS off FROM {name}_z GROUP BY {by} HAVING sum(s) > 0 AND sum(s) < sum(n)""")
    for k in range(STEPS):
        cte(f"{name}_{k + 1}", f"{name}_z {name}_{k}", f"""
SELECT {by}, slope - (h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01) AS slope, off - (h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01) AS off
FROM (SELECT {by}, slope, off, sum(n * q - s) AS g0, sum((n * q - s) * z) + slope AS g1, sum(n * q * (1 - q)) AS h00,
        sum(n * q * (1 - q) * z) AS h01, sum(n * q * (1 - q) * z * z) + 1 AS h11
      FROM (SELECT *, 1 / (1 + exp(-(slope * z + off))) AS q FROM {name}_z JOIN {name}_{k} USING ({by})) t GROUP BY {by}, slope, off) u""")
    return f"{name}_{STEPS}"


_platt = "CASE WHEN slope IS NULL THEN p ELSE 1 / (1 + exp(-(slope * ln(p / (1 - p)) + off))) END"
cte("recent_counts", "preds", f"""
SELECT target, {_clip.format('round(p, 9)')} AS p, count(*) AS n, sum(y) AS s FROM preds WHERE run = 'recent' AND split = 'train' AND y IS NOT NULL GROUP BY ALL""")
_last = newton_sql("recent_counts", "target", "newton")


@query("platt_calibration", "ML-5", f"{ROWSPEC} p:d", f"preds {_last}", f"""
SELECT {_key}, target, {_clip.format(_platt)} AS p
FROM (SELECT * REPLACE ({_clip.format('round(p, 9)')} AS p) FROM preds WHERE run = 'recent' AND split = 'test') r LEFT JOIN {_last} USING (target)""")
def platt_calibration(spark, folder):
    """Seven targets: fitted on the training rows, applied to the test rows."""
    rows = rounded(predictions(spark, folder).where("run = 'recent'"))
    fits = CA.platt_fits(CA.score_counts(rows.where("split = 'train'"), ["target"]), ["target"])
    return CA.apply_platt_fits(rows.where("split = 'test'"), fits, ["target"])


_last_held = newton_sql("held_recent", "target, held", "held_newton")


@query("platt_by_fold", "ML-5", f"{ROWSPEC} fold_id:i y:d p:d", f"folded_recent {_last_held}", f"""
SELECT {_key}, r.target, fold_id, y, {_clip.format(_platt)} AS p
FROM folded_recent r LEFT JOIN {_last_held} f ON f.target = r.target AND f.held = r.fold_id""")
def platt_by_fold(spark, folder):
    """Seven targets, five folds, each calibrated by the regression on the other folds."""
    return CA.platt_out_of_fold(folded(spark, folder, "recent"), list(range(FOLDS)))


# ---- ordered target statistics ------------------------------------------------------

_held = range(FOLDS)
_perms = O.PERMUTATIONS
cte("ordered_rows", "train_labels fold_of", f"""
SELECT l.subject_id, l.sleep_date, l.lifelog_date, l.target, l.y, f.fold_id FROM train_labels l JOIN fold_of f USING ({_key}, target) WHERE l.y IS NOT NULL""")
cte("ordered_means", "ordered_rows", f"""
SELECT target, held, avg(y) AS mean FROM ordered_rows JOIN (SELECT unnest(range({FOLDS})) AS held) h ON held <> fold_id GROUP BY target, held""")
_before = "OVER (PARTITION BY subject_id, target, perm ORDER BY digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
cte("ordered_sums", "ordered_rows", f"""
SELECT *, {', '.join(f'coalesce(sum(CAST(fold_id <> {h} AS INTEGER)) {_before}, 0) AS n{h}, coalesce(sum(CASE WHEN fold_id <> {h} THEN y ELSE 0 END) {_before}, 0) AS s{h}' for h in _held)}
FROM (SELECT *, md5(concat_ws('|', CAST(perm AS VARCHAR), target, subject_id, CAST(sleep_date AS VARCHAR), CAST(lifelog_date AS VARCHAR))) AS digest
      FROM (SELECT *, unnest(range({_perms})) AS perm FROM ordered_rows) q) t""")
cte("ordered_own", "ordered_rows ordered_means", f"""
SELECT r.target, r.subject_id, m.held, (sum(CASE WHEN r.fold_id <> m.held THEN r.y ELSE 0 END) + m.mean) / (count(*) FILTER (r.fold_id <> m.held) + 1) AS own
FROM ordered_rows r JOIN ordered_means m USING (target) GROUP BY r.target, r.subject_id, m.held, m.mean""")


@query("ordered_subject_statistics", "ML-7 PRI-2", f"{ROWSPEC} fold_id:i {columns('d', [f'held_{h}' for h in _held])}",
       "ordered_sums ordered_means ordered_own", f"""
SELECT {_key}, target, fold_id, {', '.join(f'max(CASE WHEN held = {h} THEN v END) AS held_{h}' for h in _held)}
FROM (SELECT {_key}, s.target, fold_id, m.held,
        CASE WHEN fold_id = m.held THEN max(o.own) ELSE avg((CASE m.held {' '.join(f'WHEN {h} THEN s{h}' for h in _held)} END + m.mean)
          / (CASE m.held {' '.join(f'WHEN {h} THEN n{h}' for h in _held)} END + 1)) END AS v
      FROM ordered_sums s JOIN ordered_means m USING (target) JOIN ordered_own o USING (target, subject_id, held)
      GROUP BY {_key}, s.target, fold_id, m.held) t
GROUP BY {_key}, target, fold_id""")
def ordered_subject_statistics(spark, folder):
    """The subject as an ordered target statistic for every target and held-out fold."""
    train = labels(spark, folder, "train")
    folds = V.stratified_folds(train, FOLDS, _seeds[:1]).select(*KEYS, "target", "fold_id")
    return O.ordered_statistics(train.join(folds.hint("merge"), [*KEYS, "target"]), FOLDS)  # as many folds as labels: not to be broadcast
