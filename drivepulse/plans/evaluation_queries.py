"""Classifier evaluation and resampling over the prediction view."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, VEHICLES
from drivepulse.functions.scalars import half_up
from drivepulse.operators import evaluation as ev
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import mix_sql, query
from drivepulse.plans.views import PACK_METRICS, PANEL, PRED, panel, pred, table

REPLICATES = ev.REPLICATES


def model(spark, sf, name):
    return pred(spark, sf).withColumn("predicted_label", F.col(f"pred_{name}"))


def both(spark, sf):
    """Rows of both models, told apart by ``config``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("config"), F.col(f"pred_{n}").alias("predicted_label")) for n in "ab"])
    return pred(spark, sf).withColumn("_p", F.explode(pairs)).select("*", "_p.*").drop("_p")


MODEL_A = PRED + ", p AS (SELECT *, pred_a AS predicted_label FROM pred)"
BOTH = PRED + """, p AS (SELECT *, 'a' AS config, pred_a AS predicted_label FROM pred
  UNION ALL SELECT *, 'b', pred_b FROM pred)"""
_DIM = "(SELECT unnest(['NORMAL','ECC10','ECC20','DEMAG','REDUC']) AS label)"


def _scores_sql(keys: str, name: str = "scores") -> str:
    """CTEs ``cells`` and ``scores``: per key and class tp, fp, fn, precision, recall, f1, support."""
    k = f"{keys}, " if keys else ""
    dims = f"(SELECT DISTINCT {keys} FROM p), {_DIM} d" if keys else f"{_DIM} d"
    on = " AND ".join(f"c.{x.strip()} = g.{x.strip()}" for x in keys.split(",")) if keys else "TRUE"
    return f""",
cells_{name} AS (SELECT {k}true_label, predicted_label, count(*) AS n FROM p GROUP BY ALL),
grid_{name} AS (SELECT {k}d.label FROM {dims}),
{name} AS (
  SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS precision,
         CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS recall,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1, tp + fn AS support
  FROM (SELECT {', '.join('g.' + x.strip() for x in keys.split(',')) + ', ' if keys else ''}g.label,
          CAST(coalesce(sum(CASE WHEN c.true_label = g.label AND c.predicted_label = g.label THEN c.n END), 0) AS DOUBLE) AS tp,
          CAST(coalesce(sum(CASE WHEN c.true_label <> g.label AND c.predicted_label = g.label THEN c.n END), 0) AS DOUBLE) AS fp,
          CAST(coalesce(sum(CASE WHEN c.true_label = g.label AND c.predicted_label <> g.label THEN c.n END), 0) AS DOUBLE) AS fn
        FROM grid_{name} g LEFT JOIN cells_{name} c ON {on} GROUP BY ALL))"""


@query(
    "accuracy",
    "WITH " + MODEL_A + f" SELECT vehicle, fold, count(*) AS n, {r('avg(CAST(true_label = predicted_label AS DOUBLE))', 6)} AS accuracy FROM p GROUP BY 1, 2",
)
def q_accuracy(spark, sf):
    return ev.accuracy(model(spark, sf, "a"), ["vehicle", "fold"]).withColumn("accuracy", half_up(F.col("accuracy"), 6))


_REPORT_COLS = ("precision", "recall", "f1")


@query(
    "classification_report",
    "WITH " + MODEL_A + _scores_sql("vehicle") + f""",
avgs AS (SELECT vehicle, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(support) AS n, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
  sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr, sum(f1 * support) / sum(support) AS wf FROM scores GROUP BY 1),
report AS (
  SELECT vehicle, label, precision, recall, f1, support FROM scores
  UNION ALL SELECT vehicle, 'accuracy', tp / n, tp / n, tp / n, n FROM avgs
  UNION ALL SELECT vehicle, 'micro avg', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), n FROM avgs
  UNION ALL SELECT vehicle, 'macro avg', mp, mr, mf, n FROM avgs
  UNION ALL SELECT vehicle, 'weighted avg', wp, wr, wf, n FROM avgs)
SELECT vehicle, label, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM report""",
)
def q_report(spark, sf):
    rep = ev.classification_report(model(spark, sf, "a"), ["vehicle"])
    return rep.withColumns({c: half_up(F.col(c), 6) for c in _REPORT_COLS})


@query(
    "report_absent_class",
    "WITH " + PRED + ", p AS (SELECT *, pred_a AS predicted_label FROM pred WHERE true_label <> 'ECC20' AND pred_a <> 'ECC20')"
    + _scores_sql("") + f""" SELECT label, {r('precision', 6)} AS precision, {r('recall', 6)} AS recall, {r('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM scores""",
)
def q_absent(spark, sf):
    """A class that is neither present nor predicted still gets a zero row."""
    p = model(spark, sf, "a").filter((F.col("true_label") != "ECC20") & (F.col("predicted_label") != "ECC20"))
    out = ev.class_scores(p).drop("tp", "fp", "fn")
    return out.withColumns({c: half_up(F.col(c), 6) for c in _REPORT_COLS})


@query(
    "confusion_matrix",
    "WITH " + MODEL_A + " SELECT vehicle, true_label, "
    + ", ".join(f"count(*) FILTER (WHERE predicted_label = '{c}') AS \"{c}\"" for c in CLASSES) + " FROM p GROUP BY 1, 2",
)
def q_confusion(spark, sf):
    return ev.confusion_matrix(model(spark, sf, "a"), ["vehicle"])


@query(
    "fold_summary",
    "WITH " + MODEL_A + _scores_sql("vehicle, fold", "byfold") + _scores_sql("vehicle", "whole") + f""",
f AS (SELECT vehicle, fold, avg(f1) AS f1 FROM byfold GROUP BY 1, 2),
a AS (SELECT vehicle, fold, avg(CAST(true_label = predicted_label AS DOUBLE)) AS acc FROM p GROUP BY 1, 2),
s AS (SELECT vehicle, avg(f1) AS m, stddev_pop(f1) AS sd, avg(acc) AS am, stddev_pop(acc) AS asd FROM f JOIN a USING (vehicle, fold) GROUP BY 1),
w AS (SELECT vehicle, avg(f1) AS c FROM whole GROUP BY 1)
SELECT vehicle, {r('m', 6)} AS f1_mean, {r('sd', 6)} AS f1_std, {r('am', 6)} AS acc_mean, {r('asd', 6)} AS acc_std, {r('c', 6)} AS f1_cumulative
FROM s JOIN w USING (vehicle)""",
)
def q_folds(spark, sf):
    out = ev.fold_summary(model(spark, sf, "a"), ["vehicle"])
    return out.withColumns({c: half_up(F.col(c), 6) for c in out.columns if c != "vehicle"})


_DIRECTED = """, d AS (SELECT config, vehicle,
  sum(CASE WHEN true_label = 'DEMAG' AND predicted_label = 'DEMAG' THEN 1e0 ELSE 0e0 END) / sum(CASE WHEN true_label = 'DEMAG' THEN 1e0 ELSE 0e0 END) AS recall,
  count(*) FILTER (WHERE true_label = 'DEMAG' AND predicted_label = 'REDUC') AS a_to_b, count(*) FILTER (WHERE true_label = 'REDUC' AND predicted_label = 'DEMAG') AS b_to_a
  FROM p GROUP BY 1, 2)"""


@query(
    "directed_confusion",
    "WITH " + BOTH + _DIRECTED + f" SELECT config, vehicle, {r('recall', 6)} AS recall, a_to_b, b_to_a, a_to_b + b_to_a AS both_ways FROM d",
)
def q_directed(spark, sf):
    cells = ev.confusion_cells(both(spark, sf), ["config", "vehicle"])
    out = ev.directed_confusion(cells, ["config", "vehicle"], "DEMAG", "REDUC")
    return out.withColumn("recall", half_up(F.col("recall"), 6))


@query(
    "error_reduction",
    "WITH " + BOTH + """, d AS (SELECT config, count(*) FILTER (WHERE true_label = 'DEMAG' AND predicted_label = 'REDUC') AS ab,
  count(*) FILTER (WHERE true_label = 'REDUC' AND predicted_label = 'DEMAG') AS ba FROM p GROUP BY 1),
e AS (SELECT max(CASE WHEN config = 'a' THEN ab END) AS a1, max(CASE WHEN config = 'b' THEN ab END) AS a2,
   max(CASE WHEN config = 'a' THEN ba END) AS b1, max(CASE WHEN config = 'b' THEN ba END) AS b2 FROM d)"""
    + f""" SELECT {r('CASE WHEN a1 = 0 THEN 0e0 ELSE (a1 - a2) * 100e0 / a1 END', 4)} AS a_to_b_reduction,
 {r('CASE WHEN b1 = 0 THEN 0e0 ELSE (b1 - b2) * 100e0 / b1 END', 4)} AS b_to_a_reduction,
 {r('CASE WHEN a1 + b1 = 0 THEN 0e0 ELSE (a1 + b1 - a2 - b2) * 100e0 / (a1 + b1) END', 4)} AS both_ways_reduction FROM e""",
)
def q_reduction(spark, sf):
    cells = ev.confusion_cells(both(spark, sf), ["config"])
    counts = ev.directed_confusion(cells, ["config"], "DEMAG", "REDUC")
    out = ev.error_reduction(counts, "config", "a", "b")
    return out.select(*[half_up(F.col(c), 4).alias(c) for c in out.columns])


@query(
    "ablation",
    "WITH " + BOTH + _scores_sql("config, vehicle") + f""",
m AS (SELECT config, vehicle, avg(f1) AS f FROM scores GROUP BY 1, 2),
w AS (SELECT config, max(CASE WHEN vehicle = 'IONIQ' THEN f END) AS a, max(CASE WHEN vehicle = 'KONA' THEN f END) AS b, max(CASE WHEN vehicle = 'NIRO' THEN f END) AS c FROM m GROUP BY 1)
SELECT config, {r('a', 6)} AS "IONIQ", {r('b', 6)} AS "KONA", {r('c', 6)} AS "NIRO", {r('(a + b + c) / 3e0', 6)} AS mean FROM w""",
)
def q_ablation(spark, sf):
    out = ev.ablation_table(ev.macro_f1(both(spark, sf), ["config", "vehicle"]), VEHICLES)
    return out.withColumns({c: half_up(F.col(c), 6) for c in (*VEHICLES, "mean")})


def paired(spark, sf, keys=("session",)):
    return ev.paired_counts(model(spark, sf, "b"), model(spark, sf, "a"), keys=list(keys))


PAIRED = PRED + """, sess AS (SELECT session, count(*) AS n, count(*) FILTER (WHERE pred_b = true_label AND pred_a <> true_label) AS n10,
  count(*) FILTER (WHERE pred_b <> true_label AND pred_a = true_label) AS n01 FROM pred GROUP BY 1)"""


@query("paired_sessions", "WITH " + PAIRED + " SELECT session, n, n10, n01 FROM sess")
def q_paired(spark, sf):
    return paired(spark, sf)


@query(
    "effect_size",
    "WITH " + PAIRED + f""", t AS (SELECT sum(n)::BIGINT AS n, sum(n10)::BIGINT AS n10, sum(n01)::BIGINT AS n01 FROM sess)
SELECT n, n10, n01, {r('(n10 - n01) / n', 8)} AS delta,
  {r('greatest(abs(n10 - n01) - 1, 0) * greatest(abs(n10 - n01) - 1, 0) / (n10 + n01)', 6)} AS mcnemar FROM t""",
)
def q_effect(spark, sf):
    out = ev.effect_size(paired(spark, sf, ()))
    return out.withColumn("delta", half_up(F.col("delta"), 8)).withColumn("mcnemar", half_up(F.col("mcnemar"), 6))


REPS = f"""
reps AS MATERIALIZED (SELECT range AS replicate, {mix_sql('xor(range, 42)')} AS r FROM range({REPLICATES}))"""
DRAWS = PAIRED + "," + REPS + f""",
ordered AS MATERIALIZED (SELECT n10 - n01 AS d, n, row_number() OVER (ORDER BY n10 - n01, n) - 1 AS place, count(*) OVER () AS total FROM sess),
draws AS (SELECT replicate, ({mix_sql('xor(r, place)')} * total) >> 32 AS t FROM reps, ordered),
deltas AS (SELECT replicate, sum(d) / sum(n) AS delta FROM draws JOIN ordered ON t = place GROUP BY 1)"""
# A session's place is a bit of a word; a profile's bits of a word are a mask.
FLIPS = PAIRED + "," + REPS + f""",
spans AS (SELECT d, upto - c AS low, upto AS high FROM (
  SELECT d, c, CAST(sum(c) OVER (ORDER BY d, n) AS BIGINT) AS upto FROM (SELECT n10 - n01 AS d, n, count(*) AS c FROM sess GROUP BY 1, 2))),
masks AS MATERIALIZED (
  SELECT d, w, (CAST(1 AS BIGINT) << least(32, high - 32 * w)) - (CAST(1 AS BIGINT) << greatest(0, low - 32 * w)) AS mask
  FROM (SELECT d, low, high, unnest(range(low // 32, (high - 1) // 32 + 1)) AS w FROM spans)),
deltas AS (
  SELECT replicate, sum(d * (2 * bit_count({mix_sql('xor(r, w)')} & mask) - bit_count(mask))) / (SELECT sum(n) FROM sess) AS delta
  FROM reps, masks GROUP BY 1)"""


@query("bootstrap_deltas", "WITH " + DRAWS + f" SELECT replicate, {r('delta', 8)} AS delta FROM deltas")
def q_bootstrap(spark, sf):
    out = ev.bootstrap_draws(paired(spark, sf), REPLICATES)
    return out.withColumn("delta", half_up(F.col("delta"), 8))


@query(
    "bootstrap_interval",
    "WITH " + DRAWS + f""", q AS (SELECT quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi, quantile_cont(delta, 0.05) AS one FROM deltas)
SELECT {r('lo', 7)} AS ci_low, {r('hi', 7)} AS ci_high, {r('one', 7)} AS one_sided_low, one > -0.01e0 AS non_inferior FROM q""",
)
def q_interval(spark, sf):
    out = ev.bootstrap_interval(ev.bootstrap_draws(paired(spark, sf), REPLICATES), 0.01)
    return out.withColumns({c: half_up(F.col(c), 7) for c in ("ci_low", "ci_high", "one_sided_low")})


@query("bootstrap_multinomial")
def q_multinomial(spark, sf):
    return ev.bootstrap_interval(ev.bootstrap_multinomial(paired(spark, sf), REPLICATES), 0.01)


PERMUTED = "WITH " + FLIPS + f""", o AS (SELECT sum(n10 - n01) / sum(n) AS observed FROM sess)
SELECT {r('max(observed)', 8)} AS observed, {r('avg(CAST(abs(delta) >= abs(observed) - 1e-12 AS DOUBLE))', 6)} AS p_value FROM deltas, o"""


@query("permutation_test", PERMUTED)
def q_permutation(spark, sf):
    out = ev.permutation_p(ev.permutation_deltas(paired(spark, sf), REPLICATES))
    return out.select(half_up(F.col("observed"), 8).alias("observed"), half_up(F.col("p_value"), 6).alias("p_value"))


@query("permutation_binomial")
def q_binomial(spark, sf):
    return ev.permutation_p(ev.permutation_binomial(paired(spark, sf), REPLICATES))


@query(
    "design_effect",
    "WITH " + PRED + f""",
s AS (SELECT session, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE pred_a = true_label) AS DOUBLE) AS s FROM pred GROUP BY 1),
t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(s) AS ss, sum(s * s / n) AS b, sum(n * n) AS n2 FROM s),
m AS (SELECT *, (b - s * s / n) / (k - 1) AS msb, (ss - b) / (n - k) AS msw, (n - n2 / n) / (k - 1) AS m0 FROM t),
i AS (SELECT *, (msb - msw) / (msb + (m0 - 1) * msw) AS icc, n / k AS ms FROM m),
e AS (SELECT *, 1e0 + (ms - 1) * greatest(icc, 0e0) AS de FROM i)
SELECT {r('ms', 6)} AS mean_size, {r('icc', 6)} AS icc, {r('de', 6)} AS design_effect, {r('n / de', 3)} AS effective_n FROM e""",
)
def q_design(spark, sf):
    ok = (F.col("true_label") == F.col("predicted_label")).cast("double")
    sizes = model(spark, sf, "a").groupBy("session").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(ok).alias("s"), F.sum(ok * ok).alias("ss")
    )
    out = ev.design_effect(sizes)
    digits = {"mean_size": 6, "icc": 6, "design_effect": 6, "effective_n": 3}
    return out.select(*[half_up(F.col(c), d).alias(c) for c, d in digits.items()])


@query(
    "latency_summary",
    f"""WITH lat AS (SELECT l_linenumber AS batch, l_extendedprice / 100 AS ms FROM lineitem),
q AS (SELECT batch, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.95) AS p95, quantile_cont(ms, 0.99) AS p99, max(ms) AS mx, count(*) AS n FROM lat GROUP BY 1)
SELECT batch, {r('p50', 5)} AS p50, {r('p95', 5)} AS p95, {r('p99', 5)} AS p99, {r('mx', 5)} AS max, n, {r('p50 / batch', 5)} AS p50_per_item,
  {r('10000e0 / (p50 / batch)', 4)} AS budget_ratio FROM q""",
)
def q_latency(spark, sf):
    log = table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("batch"), (F.col("l_extendedprice") / 100).alias("ms"))
    out = ev.latency_summary(log, ["batch"], batch="batch")
    digits = {"p50": 5, "p95": 5, "p99": 5, "max": 5, "p50_per_item": 5, "budget_ratio": 4}
    return out.withColumns({c: half_up(F.col(c), d) for c, d in digits.items()})


@query(
    "stage_shares",
    f"""WITH s AS (SELECT l_returnflag AS stage, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT stage, {r('v / sum(v) OVER ()', 8)} AS share FROM s""",
)
def q_stages(spark, sf):
    s = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.sum("l_extendedprice").alias("v"))
    return s.select("stage", half_up(F.col("v") / s.agg(F.sum("v")).scalar(), 8).alias("share"))


@query("status_counts", "WITH " + PACK_METRICS + " SELECT pack_type, classification, count(*) AS n FROM metrics GROUP BY 1, 2")
def q_status_counts(spark, sf):
    from drivepulse.plans.health_queries import packs

    return packs(spark, sf).groupBy("pack_type", "classification").agg(F.count(F.lit(1)).alias("n"))


@query(
    "balanced_weights",
    "WITH " + PANEL + f", c AS (SELECT cls, count(*) AS n_c FROM panel GROUP BY 1) SELECT cls, n_c, {r('(SELECT sum(n_c) FROM c) / ((SELECT count(*) FROM c) * n_c)', 8)} AS weight FROM c",
)
def q_weights(spark, sf):
    return ev.balanced_weights(panel(spark, sf)).withColumn("weight", half_up(F.col("weight"), 8))


@query(
    "group_inventory",
    "WITH " + PRED + " SELECT vehicle, count(*) AS n_samples, count(DISTINCT session) AS n_groups, "
    + ", ".join(f"count(DISTINCT CASE WHEN true_label = '{c}' THEN session END) AS \"{c}\"" for c in CLASSES)
    + " FROM pred GROUP BY 1",
)
def q_inventory(spark, sf):
    return ev.group_inventory(pred(spark, sf), "vehicle", "session", "true_label")
