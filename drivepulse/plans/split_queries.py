"""Splits, audits and sampling over the panel and prediction views."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES
from drivepulse.functions.scalars import half_up
from drivepulse.operators import splits as sp
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import hash_sql, query
from drivepulse.plans.views import PANEL, PRED, panel, pred


def groups(spark, sf):
    return sp.group_labels(panel(spark, sf), group="grp", label="fault_class", by=["sensor"], order="vec_id")


def holdout(spark, sf, **kw):
    return sp.group_holdout(groups(spark, sf), by="sensor", group="grp", label="fault_class", **kw)


TRIALS = PANEL + f""",
grps AS (SELECT sensor, grp, arg_min(fault_class, vec_id) AS fault_class FROM panel GROUP BY 1, 2),
tried AS (SELECT sensor, grp, fault_class, seed, {hash_sql('seed', 'grp')} AS h,
   count(*) OVER (PARTITION BY sensor, seed) AS n FROM grps, (SELECT CAST(unnest(range(42, 52)) AS INTEGER) AS seed)),
sided AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY sensor, seed ORDER BY h, grp) - 1 < ceil(n * 0.2e0) THEN 'val' ELSE 'train' END AS side FROM tried),
report AS (SELECT sensor, seed, count(*) FILTER (WHERE side = 'train') AS n_train_groups, count(*) FILTER (WHERE side = 'val') AS n_val_groups,
   count(DISTINCT CASE WHEN side = 'train' THEN fault_class END) AS n_train_classes,
   count(DISTINCT CASE WHEN side = 'val' THEN fault_class END) AS n_val_classes FROM sided GROUP BY 1, 2),
chosen AS (SELECT sensor, min(seed) AS seed FROM report WHERE n_train_classes = 5 AND n_val_classes >= 1 GROUP BY 1),
split AS (SELECT s.* FROM sided s JOIN chosen c ON s.sensor = c.sensor AND s.seed = c.seed)"""


@query(
    "split_trials",
    "WITH " + TRIALS + " SELECT *, n_train_classes = 5 AND n_val_classes >= 1 AS accepted FROM report",
)
def q_trials(spark, sf):
    tried = sp.holdout_trials(groups(spark, sf), by="sensor", group="grp", label="fault_class")
    return sp.trial_report(tried, by="sensor", label="fault_class")


@query("group_holdout", "WITH " + TRIALS + " SELECT sensor, seed, grp, fault_class, side FROM split")
def q_holdout(spark, sf):
    return holdout(spark, sf)


@query(
    "split_class_sets",
    "WITH " + TRIALS + """, sets AS (SELECT sensor, list_sort(list(DISTINCT fault_class) FILTER (WHERE side = 'train')) AS t,
   list_sort(list(DISTINCT fault_class) FILTER (WHERE side = 'val')) AS v FROM split GROUP BY 1)
SELECT sensor, array_to_string(t, ',') AS train_classes, array_to_string(v, ',') AS val_classes, len(t) = 5 AS train_complete,
  array_to_string(list_filter(['DEMAG','ECC10','ECC20','NORMAL','REDUC'], lambda c: NOT list_contains(v, c)), ',') AS val_missing FROM sets""",
)
def q_class_sets(spark, sf):
    return sp.class_sets(holdout(spark, sf), by="sensor", label="fault_class")


@query(
    "split_leak_check",
    "WITH " + TRIALS + """ SELECT sensor, count(DISTINCT grp) AS n_groups, count(DISTINCT grp) FILTER (WHERE side = 'val') AS n_val,
  CAST(0 AS BIGINT) AS n_shared FROM split GROUP BY 1""",
)
def q_leak(spark, sf):
    s = holdout(spark, sf)
    shared = sp.shared_groups(s, by="sensor", group="grp").groupBy("sensor").agg(F.count(F.lit(1)).alias("_s"))
    base = s.groupBy("sensor").agg(
        F.countDistinct("grp").alias("n_groups"), F.countDistinct(F.when(F.col("side") == "val", F.col("grp"))).alias("n_val")
    )
    return base.join(shared, "sensor", "left").select("sensor", "n_groups", "n_val", F.coalesce("_s", F.lit(0)).alias("n_shared"))


@query(
    "split_fingerprint",
    "WITH " + TRIALS + """, leaf AS (SELECT sensor, sha256(CAST(grp AS VARCHAR)) AS h FROM split WHERE side = 'val'),
word AS (SELECT sensor, count(*) AS members, concat_ws(',', count(*), """
    + ", ".join(f"sum(('0x'||substr(h, {1 + 15 * i}, 15))::BIGINT)" for i in range(4))
    + """) AS parts FROM leaf GROUP BY 1)
SELECT sensor, members, sha256(parts) AS sha256 FROM word""",
)
def q_fingerprint(spark, sf):
    from drivepulse.sources.sinks import fingerprint

    val = holdout(spark, sf).filter(F.col("side") == "val")
    return fingerprint(val, ["sensor"], F.col("grp"))


@query(
    "membership_filter",
    "WITH " + TRIALS + """ SELECT p.vec_id, p.sensor, p.grp FROM panel p WHERE EXISTS (SELECT 1 FROM split s WHERE s.sensor = p.sensor AND s.grp = p.grp AND s.side = 'val')""",
)
def q_membership(spark, sf):
    val = holdout(spark, sf).filter(F.col("side") == "val").select("sensor", "grp")
    return panel(spark, sf).select("vec_id", "sensor", "grp").join(val, ["sensor", "grp"], "left_semi")


@query(
    "first_per_group",
    "WITH " + PANEL + " SELECT sensor, grp, arg_min(fault_class, vec_id) AS fault_class FROM panel GROUP BY 1, 2",
)
def q_first(spark, sf):
    return groups(spark, sf)


FOLDS = PRED + f""",
g AS (SELECT session, min(true_label) AS true_label, count(*) AS size FROM pred GROUP BY 1),
k AS (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY -size, {hash_sql('session')}, session) - 1 AS r FROM g),
folds AS (SELECT session, true_label, size, CAST(CASE WHEN (r // 3) % 2 = 0 THEN r % 3 ELSE 2 - r % 3 END AS INTEGER) AS fold FROM k)"""


@query("stratified_folds", "WITH " + FOLDS + " SELECT * FROM folds")
def q_folds(spark, sf):
    return sp.stratified_folds(pred(spark, sf), group="session", label="true_label")


def _leading_sql(n):
    return f"({n} - {n} % CAST(pow(2, greatest(length(bin({n})) - 5, 0)) AS BIGINT))"


def _cost_sql(f):
    """Growth of the squared class shares of fold f, summed in order of the classes; absent ones add nothing."""
    terms = [f"CAST(r.v[{c}] * (2 * s.held[{5 * f + c}] + r.v[{c}]) AS DOUBLE) / w.w[{c}]" for c in range(1, 6)]
    return f"{{'cost': {' + '.join(terms)}, 'n': s.n[{f + 1}], 'turn': ({f} + s.block) % 3, 'fold': {f}}}"


BALANCED = "WITH RECURSIVE " + PRED + f""",
vec AS (SELECT session, count(*) AS size, {', '.join(f"count(*) FILTER (WHERE true_label = '{c}') AS n{i}" for i, c in enumerate(CLASSES))},
   {hash_sql('session')} AS h FROM pred GROUP BY session),
prof AS (SELECT *, {', '.join(f"{_leading_sql(f'n{i}')} AS p{i}" for i in range(5))} FROM vec),
placed AS (SELECT *, row_number() OVER (PARTITION BY p0, p1, p2, p3, p4 ORDER BY h, session) - 1 AS r,
   count(*) OVER (PARTITION BY p0, p1, p2, p3, p4) AS m FROM prof),
rest AS (SELECT session, size, [n0, n1, n2, n3, n4] AS v, (i // 10000) AS block, i % 10000 AS i FROM (
   SELECT *, row_number() OVER (ORDER BY -length(bin(size)), h, session) - 1 AS i FROM placed WHERE r >= m - m % 3)),
weights AS (SELECT block, [{', '.join(f"CAST(greatest(sum(v[{c}]), 1) AS DOUBLE) * CAST(greatest(sum(v[{c}]), 1) AS DOUBLE)" for c in range(1, 6))}] AS w
   FROM rest GROUP BY block),
walk AS (
  SELECT DISTINCT block, CAST(0 AS BIGINT) AS i, list_transform(range(15), lambda x: CAST(0 AS BIGINT)) AS held,
     list_transform(range(3), lambda x: CAST(0 AS BIGINT)) AS n, CAST(NULL AS BIGINT) AS session, CAST(NULL AS BIGINT) AS size, CAST(NULL AS INTEGER) AS fold
  FROM rest
  UNION ALL
  SELECT block, i + 1, list_transform(range(15), lambda j: held[j + 1] + CASE WHEN j // 5 = f THEN v[j % 5 + 1] ELSE 0 END),
     list_transform(range(3), lambda j: n[j + 1] + CASE WHEN j = f THEN size ELSE 0 END), session, size, CAST(f AS INTEGER)
  FROM (SELECT s.block, s.i, s.held, s.n, r.session, r.size, r.v,
          list_min([{', '.join(_cost_sql(f) for f in range(3))}]).fold AS f
        FROM walk s JOIN rest r ON r.block = s.block AND r.i = s.i JOIN weights w ON w.block = s.block) q)
SELECT session, size, CAST(CASE WHEN (r // 3) % 2 = 0 THEN r % 3 ELSE 2 - r % 3 END AS INTEGER) AS fold FROM placed WHERE r < m - m % 3
UNION ALL SELECT session, size, fold FROM walk WHERE i > 0"""


@query("class_balanced_folds", BALANCED)
def q_balanced_folds(spark, sf):
    return sp.class_balanced_folds(pred(spark, sf), group="session", label="true_label")


_REC = f"CASE WHEN {hash_sql('42', 'sample_id')} % 10000 < 8000 THEN 'train' ELSE 'val' END"


@query("record_split", "WITH " + PRED + f" SELECT sample_id, session, {_REC} AS side FROM pred")
def q_record(spark, sf):
    return sp.record_split(pred(spark, sf), "sample_id").select("sample_id", "session", "side")


@query(
    "leak_audit",
    "WITH " + PRED + f""", s AS (SELECT session, {_REC} AS side FROM pred), g AS (SELECT session, max(side = 'train') AS t, max(side = 'val') AS v FROM s GROUP BY 1)
SELECT count(*) FILTER (WHERE v) AS val_groups, count(*) FILTER (WHERE t AND v) AS also_in_train FROM g""",
)
def q_audit(spark, sf):
    return sp.leak_audit(sp.record_split(pred(spark, sf), "sample_id"), "session")


@query(
    "balanced_sample",
    "WITH " + PRED + f""", a AS (SELECT vehicle, true_label, session, sample_id, {hash_sql('42', 'sample_id')} AS h FROM pred),
b AS (SELECT *, row_number() OVER (PARTITION BY vehicle, true_label, session ORDER BY h, sample_id) - 1 AS k FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY vehicle, true_label ORDER BY k, h, sample_id) - 1 AS at_ FROM b)
SELECT vehicle, true_label, session, sample_id FROM c WHERE at_ < 400""",
)
def q_balanced(spark, sf):
    p = pred(spark, sf).select("vehicle", "true_label", "session", "sample_id")
    return sp.balanced_sample(p, cell=["vehicle", "true_label"], drive="session", key="sample_id", cap=400)


@query(
    "seeded_pick",
    "WITH " + PRED + f""" SELECT sample_id, vehicle, true_label FROM pred WHERE vehicle = 'KONA' AND true_label = 'DEMAG'
ORDER BY {hash_sql('42', 'sample_id')}, sample_id LIMIT 1""",
)
def q_pick(spark, sf):
    p = pred(spark, sf).filter((F.col("vehicle") == "KONA") & (F.col("true_label") == "DEMAG"))
    return sp.seeded_pick(p.select("sample_id", "vehicle", "true_label"), "sample_id")


@query(
    "sorted_distinct",
    "WITH " + PRED + " SELECT vehicle, array_to_string(list_sort(list(DISTINCT true_label)), ',') AS classes FROM pred GROUP BY 1",
)
def q_distinct(spark, sf):
    return pred(spark, sf).groupBy("vehicle").agg(
        F.array_join(F.sort_array(F.collect_set("true_label")), ",").alias("classes")
    )


_STD = PANEL + """, el AS (SELECT cls AS fold, sensor, vec_id, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS pos FROM panel),
fit AS (SELECT f.fold, e.sensor, avg(e.v) AS mean, stddev_pop(e.v) AS std FROM (SELECT DISTINCT fold, sensor FROM el) f
   JOIN el e ON e.sensor = f.sensor AND e.fold <> f.fold GROUP BY 1, 2)"""


def _panel_folds(spark, sf):
    return panel(spark, sf).select("vec_id", "sensor", F.col("cls").alias("fold"), "x")


@query("standardiser_fit", "WITH " + _STD + f" SELECT fold, sensor, {r('mean', 7)} AS mean, {r('std', 7)} AS std FROM fit")
def q_fit(spark, sf):
    out = sp.standardiser(_panel_folds(spark, sf), fold="fold", channel="sensor")
    return out.withColumn("mean", half_up(F.col("mean"), 7)).withColumn("std", half_up(F.col("std"), 7))


@query(
    "standardised",
    "WITH " + _STD + f""" SELECT e.vec_id, {r('avg((v - mean) / std)', 5)} AS mean, {r('max((v - mean) / std)', 5)} AS top, {r('min((v - mean) / std)', 5)} AS low
FROM el e JOIN fit f ON e.fold = f.fold AND e.sensor = f.sensor GROUP BY 1""",
)
def q_standardised(spark, sf):
    from drivepulse.functions.matrices import mean

    rows = _panel_folds(spark, sf)
    out = sp.standardise(rows, sp.standardiser(rows, fold="fold", channel="sensor"), fold="fold", channel="sensor")
    return out.select(
        "vec_id", half_up(mean(F.col("x")), 5).alias("mean"), half_up(F.array_max("x"), 5).alias("top"),
        half_up(F.array_min("x"), 5).alias("low"),
    )
