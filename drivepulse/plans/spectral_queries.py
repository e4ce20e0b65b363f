"""Spectrogram features over the 8 x 8 maps and short signals of the panel view."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from drivepulse.functions.domains import SENSORS
from drivepulse.functions.matrices import spread
from drivepulse.functions.scalars import half_up
from drivepulse.operators import shaping, spectral
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import query
from drivepulse.plans.views import CHUNK, LENIENT, PANEL, SPEC, panel, sig_slice, spec, table



def flat(maps, matrix, value):
    """Matrix rows to (vec_id, f, t, value)."""
    return spread(spread(maps, ["vec_id"], matrix, "f", "row"), ["vec_id", "f"], "row", "t", value)


WINDOW, HOP, ROWS, REF_RPM = 16, 8, 8, 5700.0


@query(
    "stft",
    "WITH " + PANEL + f""",
fr AS (SELECT unnest(range(0, 7)) AS t), k AS (SELECT unnest(range(0, {ROWS})) AS f), n AS (SELECT unnest(range(0, {WINDOW})) AS n),
w AS (SELECT n, 0.5e0 - 0.5e0 * cos(2e0 * {pi!r} * n / {WINDOW - 1}) AS w FROM n),
dft AS (SELECT p.vec_id, f, t, sum(x[t * {HOP} + w.n + 1] * w.w * cos(2e0 * {pi!r} * f * w.n / {WINDOW})) AS re,
   sum(x[t * {HOP} + w.n + 1] * w.w * sin(2e0 * {pi!r} * f * w.n / {WINDOW})) AS im FROM panel p, fr, k, w GROUP BY 1, 2, 3),
m AS (SELECT vec_id, f, t, sqrt(re * re + im * im) AS a FROM dft)
SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, {r('a / max(a) OVER (PARTITION BY vec_id)', 5)} AS e FROM m""",
)
def q_stft(spark, sf):
    maps = spectral.stft(panel(spark, sf), keys=["vec_id"], window=WINDOW, hop=HOP, rows=ROWS)
    return flat(maps, "e", "e").withColumn("e", half_up(F.col("e"), 5))


def _jet_sql(v, off):
    return f"CAST(floor(least(greatest(1.5e0 - abs({v} * 4e0 - {off}e0), 0e0), 1e0) * 255e0) AS INTEGER)"


_RGB = SPEC + f""", px AS (SELECT vec_id, f, t, {_jet_sql('e', 3)} AS r, {_jet_sql('e', 2)} AS g, {_jet_sql('e', 1)} AS b FROM spec)"""


def pixels(spark, sf):
    red, green, blue = spectral.jet(F.col("e"))
    return flat(spec(spark, sf), "e", "e").select("vec_id", "f", "t", red.alias("r"), green.alias("g"), blue.alias("b"))


@query("colour_map", "WITH " + _RGB + " SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, r, g, b FROM px")
def q_jet(spark, sf):
    return pixels(spark, sf)


@query(
    "colour_inversion",
    "WITH " + _RGB + f""",
lut AS (SELECT i, {_jet_sql('(i / 255e0)', 3)} AS lr, {_jet_sql('(i / 255e0)', 2)} AS lg, {_jet_sql('(i / 255e0)', 1)} AS lb FROM (SELECT unnest(range(0, 256)) AS i)),
vox AS (SELECT DISTINCT r // 4 AS vr, g // 4 AS vg, b // 4 AS vb FROM px),
best AS (SELECT vr, vg, vb, arg_min(i, ((vr * 4 + 2 - lr) * (vr * 4 + 2 - lr) + (vg * 4 + 2 - lg) * (vg * 4 + 2 - lg) + (vb * 4 + 2 - lb) * (vb * 4 + 2 - lb)) * 256 + i) AS i
  FROM vox, lut GROUP BY 1, 2, 3)
SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, {r('i / 255e0', 6)} AS e FROM px JOIN best ON vr = r // 4 AND vg = g // 4 AND vb = b // 4""",
)
def q_inversion(spark, sf):
    out = spectral.recover_scalar(pixels(spark, sf))
    return out.select("vec_id", "f", "t", half_up(F.col("e"), 6).alias("e"))


_Z = SPEC + """,
md AS (SELECT vec_id, f, quantile_cont(e, 0.5) AS m FROM spec GROUP BY 1, 2),
ma AS (SELECT s.vec_id, s.f, quantile_cont(abs(e - m), 0.5) AS mad FROM spec s JOIN md ON md.vec_id = s.vec_id AND md.f = s.f GROUP BY 1, 2),
zz AS (SELECT s.vec_id, s.f, s.t, s.e, (s.e - md.m) / (1.4826e0 * (ma.mad + 1e-6)) AS z FROM spec s
   JOIN md ON md.vec_id = s.vec_id AND md.f = s.f JOIN ma ON ma.vec_id = s.vec_id AND ma.f = s.f)"""


@query("baseline_removed", "WITH " + _Z + f" SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, {r('z', 5)} AS z FROM zz")
def q_baseline(spark, sf):
    z = spectral.remove_baseline(spec(spark, sf))
    return flat(z, "z", "z").withColumn("z", half_up(F.col("z"), 5))


_BASIC = _Z + """, lim AS (SELECT vec_id, quantile_cont(z, 0.9) AS lim FROM zz GROUP BY 1),
basic AS (SELECT z.vec_id, z.t, arg_max(f, z) AS pk, min(CASE WHEN z > lim THEN f END) AS b0, max(CASE WHEN z > lim THEN f END) AS b1, sqrt(avg(e * e)) AS rms
  FROM zz z JOIN lim USING (vec_id) GROUP BY 1, 2)"""


@query(
    "basic_features",
    "WITH " + _BASIC + f""" SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(pk AS INTEGER) AS peak_freq_bin, CAST(b0 AS DOUBLE) AS band_start,
  CAST(b1 AS DOUBLE) AS band_end, {r('rms', 6)} AS rms FROM basic""",
)
def q_basic(spark, sf):
    return _basic(spectral.basic_features(spec(spark, sf), keys=["vec_id"]))


def _shape_sql(src: str, name: str) -> str:
    """CTEs computing the twelve shape features of ``src(vec_id, f, t, e)`` (null e = absent)."""
    return f""",
{name}_p AS (SELECT vec_id, f, t, e, coalesce(e, 0e0) / (sum(e) OVER (PARTITION BY vec_id, t) + 1e-12) AS p FROM {src}),
{name}_c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id, t ORDER BY f) AS cum FROM {name}_p),
{name} AS (SELECT vec_id, t, {', '.join(f'sum(CASE WHEN f = {j} THEN p ELSE 0e0 END) AS band_{j}' for j in range(8))},
  sum(f * p) AS centroid, -sum(p * ln(p + 1e-12)) AS entropy, min(CASE WHEN cum >= 0.85e0 THEN f END) AS rolloff,
  avg(ln(e + 1e-12)) - ln(avg(e) + 1e-12) AS log_flatness FROM {name}_c GROUP BY 1, 2)"""


_SHAPE_COLS = ", ".join(f"{r(c, 5)} AS {c}" for c in [f"band_{j}" for j in range(8)] + ["centroid", "entropy", "log_flatness"])


def _rounded(df, prefix=""):
    names = [f"{prefix}{s}" for s in spectral.SHAPE if s != "rolloff"]
    return df.withColumns({n: half_up(F.col(n), 5) for n in names}).withColumn(
        f"{prefix}rolloff", F.col(f"{prefix}rolloff").cast("double")
    )


def _basic(df):
    """Rounded rms; band limits may be absent and are shown as doubles."""
    return df.withColumns(
        {"rms": half_up(F.col("rms"), 6), **{c: F.col(c).cast("double") for c in ("band_start", "band_end")}}
    )


@query(
    "shape_features",
    "WITH " + SPEC + _shape_sql("spec", "sh") + f" SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(rolloff AS DOUBLE) AS rolloff, {_SHAPE_COLS} FROM sh",
)
def q_shape(spark, sf):
    return _rounded(spectral.shape_features(spec(spark, sf), keys=["vec_id"]))


_ORDER = SPEC + f""",
ks AS (SELECT DISTINCT s.vec_id, s.rpm, s.t, k, k * s.rpm / {REF_RPM}e0 AS u FROM spec s, (SELECT unnest(range(0, 8)) AS k)),
ord AS (SELECT a.vec_id, a.k AS f, a.t, CASE WHEN u <= 7 THEN l.e + (coalesce(h.e, l.e) - l.e) * (u - floor(u)) END AS e
  FROM ks a LEFT JOIN spec l ON l.vec_id = a.vec_id AND l.t = a.t AND l.f = floor(u) LEFT JOIN spec h ON h.vec_id = a.vec_id AND h.t = a.t AND h.f = floor(u) + 1)"""
_ORDER = _ORDER.replace("5700.0e0", "5700e0")


@query("order_axis", "WITH " + _ORDER + f" SELECT vec_id, CAST(f AS INTEGER) AS f, CAST(t AS INTEGER) AS t, {r('e', 6)} AS e FROM ord")
def q_order(spark, sf):
    o = spectral.order_axis(spec(spark, sf), rpm=F.col("rpm"), reference_rpm=REF_RPM)
    return flat(o, "e_order", "e").withColumn("e", half_up(F.col("e"), 6))


@query(
    "order_features",
    "WITH " + _ORDER + _shape_sql("ord", "sh") + f" SELECT vec_id, CAST(t AS INTEGER) AS t, CAST(rolloff AS DOUBLE) AS rolloff, {_SHAPE_COLS} FROM sh",
)
def q_order_features(spark, sf):
    o = spectral.order_axis(spec(spark, sf), rpm=F.col("rpm"), reference_rpm=REF_RPM)
    return _rounded(spectral.shape_features(o, keys=["vec_id"], matrix="e_order"))


_A = ", ".join(f"{r('a.' + c, 5)} AS abs_{c}" for c in [f"band_{j}" for j in range(8)] + ["centroid", "entropy", "log_flatness"])
_O = ", ".join(f"{r('o.' + c, 5)} AS ord_{c}" for c in [f"band_{j}" for j in range(8)] + ["centroid", "entropy", "log_flatness"])


_FEATURES = (
    "WITH " + _BASIC + _ORDER[len(SPEC):] + _shape_sql("spec", "sa") + _shape_sql("ord", "so") + f"""
SELECT b.vec_id, CAST(b.t AS INTEGER) AS t, CAST(b.pk AS INTEGER) AS peak_freq_bin, CAST(b.b0 AS DOUBLE) AS band_start, CAST(b.b1 AS DOUBLE) AS band_end,
  {r('b.rms', 6)} AS rms, q.rpm, CAST(a.rolloff AS DOUBLE) AS abs_rolloff, CAST(o.rolloff AS DOUBLE) AS ord_rolloff, {_A}, {_O}
FROM basic b JOIN sa a ON a.vec_id = b.vec_id AND a.t = b.t JOIN so o ON o.vec_id = b.vec_id AND o.t = b.t
JOIN (SELECT DISTINCT vec_id, rpm FROM spec) q ON q.vec_id = b.vec_id"""
)


@query("sensor_features", _FEATURES)
def q_all(spark, sf):
    out = spectral.sensor_features(spec(spark, sf), keys=["vec_id"], reference_rpm=REF_RPM)
    out = _rounded(_rounded(out, "abs_"), "ord_")
    return _basic(out)


@query("sensor_features_batched", _FEATURES)
def q_batched(spark, sf):
    out = spectral.sensor_features_batched(spec(spark, sf), keys=["vec_id"], reference_rpm=REF_RPM)
    out = _rounded(_rounded(out, "abs_"), "ord_")
    return _basic(out)


def _fused_totals(spark, sf, name):
    """Sum of every fused channel per session."""
    feats = spectral.sensor_features_batched(spec(spark, sf), keys=["vec_id"], reference_rpm=REF_RPM)
    panels = spectral.channel_panel(feats, keys=["vec_id"], columns=spectral.feature_set(name))
    sensor = F.get(F.array(*[F.lit(s) for s in SENSORS]), (F.col("vec_id") % 3).cast("int"))
    keyed = panels.select(F.floor(F.col("vec_id") / 3).alias("session"), sensor.alias("sensor"), "channels")
    fused = shaping.fuse_sensors(keyed, session=["session"])
    rows = spread(fused, ["session", "length"], "fused", "channel", "_c")
    total = F.aggregate(
        F.filter("_c", lambda v: v.isNotNull() & ~F.isnan(v)), F.lit(0.0), lambda a, v: a + v.cast("double")
    )
    return rows.select("session", "length", "channel", half_up(total, 2).alias("total"))


def _fused_sql(name):
    columns = spectral.feature_set(name)
    plain = {"peak_freq_bin": "b.pk", "band_start": "b.b0", "band_end": "b.b1", "rms": "b.rms", "rpm": "q.rpm"}
    source = [plain.get(c, f"a.{c[4:]}" if c.startswith("abs_") else f"o.{c[4:]}") for c in columns]
    values = ", ".join(f"CAST({c} AS FLOAT)::DOUBLE" for c in source)
    return (
        "WITH " + _BASIC + _ORDER[len(SPEC):] + _shape_sql("spec", "sa") + _shape_sql("ord", "so") + f""",
whole AS (SELECT vec_id // 3 AS session FROM embeddings GROUP BY 1 HAVING count(DISTINCT vec_id % 3) = 3),
wide AS (SELECT b.vec_id, b.t, [{values}] AS v FROM basic b JOIN sa a ON a.vec_id = b.vec_id AND a.t = b.t
  JOIN so o ON o.vec_id = b.vec_id AND o.t = b.t JOIN (SELECT DISTINCT vec_id, rpm FROM spec) q ON q.vec_id = b.vec_id),
tall AS (SELECT vec_id, t, unnest(v) AS v, generate_subscripts(v, 1) - 1 AS j FROM wide)
SELECT vec_id // 3 AS session, CAST(count(DISTINCT t) AS INTEGER) AS length, CAST((vec_id % 3) * {len(columns)} + j AS INTEGER) AS channel,
  {r('coalesce(sum(v), 0e0)', 2)} AS total FROM tall JOIN whole ON session = vec_id // 3 GROUP BY vec_id, j"""
    )


@query("fused_87", _fused_sql("87"))
def q_fused(spark, sf):
    return _fused_totals(spark, sf, "87")


@query("fused_48", _fused_sql("48"))
def q_fused_48(spark, sf):
    return _fused_totals(spark, sf, "48")


_COND = LENIENT.replace("CASE WHEN event_id % 20 <> 0 THEN value END AS rms", "value AS rms, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS act")


@query(
    "condition_statistics",
    "WITH " + _COND + f""" SELECT unit, chunk_id, {r('avg(rms - act)', 5)} AS deviation_mean, {r('stddev_pop(rms - act)', 5)} AS deviation_std,
  {r('regr_slope(rms - act, pos)', 5)} AS deviation_trend, {r('avg(act)', 5)} AS act_mean, {r('stddev_pop(act)', 5)} AS act_std, {r('regr_slope(act, pos)', 5)} AS act_trend,
  CAST(floor(avg(act) / 25e0) AS BIGINT) AS condition FROM chunked GROUP BY 1, 2""",
)
def q_conditions(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("unit"), "ts", F.col("event_id").alias("seq"), F.col("value").alias("rms"),
        F.from_json("props", "k double")["k"].alias("act"),
    )
    rows = shaping.chunk_rows(e, recording=["unit"], order=["ts", "seq"], slice_by=sig_slice(), chunk_size=CHUNK, strict=False)
    out = spectral.condition_statistics(rows, chunk=["unit", "chunk_id"], reference="rms", actual="act", extra=["act"], bin_by="act")
    return out.withColumns({c: half_up(F.col(c), 5) for c in out.columns if c not in ("unit", "chunk_id", "condition")})
