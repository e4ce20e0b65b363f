"""Diagnosis-shaped views over the driver tables, in Spark and as SQL CTE bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, SENSORS, VEHICLES
from drivepulse.functions.matrices import reshape
from drivepulse.functions.scalars import pick

CHUNK = 16
EVENT_FAULT = {"view": "NORMAL", "click": "ECC10", "purchase": "ECC20", "signup": "DEMAG", "error": "REDUC"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def table_path(sf: str, name: str) -> str:
    return f"{sf}/{name}.parquet"


def _names(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


# Signals: one unit per user, every twentieth sample missing.
def sig(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("unit"),
        F.col("event_type").alias("sensor"),
        "ts",
        F.col("event_id").alias("seq"),
        F.when(F.col("event_id") % 20 != 0, F.col("value")).alias("rms"),
    )


def sig_slice():
    """Slices of one minute keep the tasks of a hot unit small."""
    return F.date_trunc("minute", F.col("ts"))


SIG = """sig AS (
  SELECT user_id AS unit, event_type AS sensor, ts, event_id AS seq,
         CASE WHEN event_id % 20 <> 0 THEN value END AS rms
  FROM events),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY unit ORDER BY ts, seq) - 1 AS place,
         count(*) OVER (PARTITION BY unit) AS len FROM sig)"""
LENIENT = SIG + f""",
chunked AS (
  SELECT *, CAST(place // {CHUNK} AS INTEGER) AS chunk_id, CAST(place % {CHUNK} AS INTEGER) AS pos
  FROM placed WHERE place // {CHUNK} < len // {CHUNK})"""
STRICT = SIG + f""",
chunked AS (
  SELECT *, CAST(place // {CHUNK} AS INTEGER) AS chunk_id, CAST(place % {CHUNK} AS INTEGER) AS pos
  FROM placed WHERE len % {CHUNK} = 0)"""
REPAIRED = """,
near AS (
  SELECT *,
    last_value(CASE WHEN rms IS NOT NULL THEN pos END IGNORE NULLS) OVER w1 AS pp,
    last_value(rms IGNORE NULLS) OVER w1 AS pv,
    last_value(CASE WHEN rms IS NOT NULL THEN pos END IGNORE NULLS) OVER w2 AS np,
    last_value(rms IGNORE NULLS) OVER w2 AS nv
  FROM chunked
  WINDOW w1 AS (PARTITION BY unit, chunk_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         w2 AS (PARTITION BY unit, chunk_id ORDER BY pos DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
repaired AS (
  SELECT *, rms IS NULL AS was_gap,
    CASE WHEN rms IS NOT NULL THEN rms
         WHEN pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) / (np - pp) * (pos - pp)
         ELSE coalesce(pv, nv, 0) END AS clean
  FROM near)"""


# Panels: 64 samples per vector, five classes, groups of one class each.
def panel(spark, sf):
    return panel_of(table(spark, sf, "embeddings"))


def panel_of(embeddings):
    cls = F.col("label") % 5
    return embeddings.select(
        "vec_id",
        cls.cast("int").alias("cls"),
        pick(CLASSES, cls.cast("int")).alias("fault_class"),
        (cls * 1000 + F.floor(F.col("vec_id") / 25)).cast("long").alias("grp"),
        pick(SENSORS, (F.col("vec_id") % 3).cast("int")).alias("sensor"),
        F.floor(F.col("vec_id") / 3).alias("session"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


PANEL = f"""panel AS (
  SELECT vec_id, CAST(label % 5 AS INTEGER) AS cls, {_names(CLASSES)}[label % 5 + 1] AS fault_class,
         CAST((label % 5) * 1000 + vec_id // 25 AS BIGINT) AS grp,
         {_names(SENSORS)}[CAST(vec_id % 3 AS INTEGER) + 1] AS sensor,
         vec_id // 3 AS session, embedding::DOUBLE[] AS x
  FROM embeddings)"""


# Packs: 8 time steps x 8 cells of volts.
def pack(spark, sf):
    e = table(spark, sf, "embeddings")
    level = F.lit(3.3) + F.lit(0.15) * (F.col("vec_id") % 5)
    gain = F.lit(0.1) * (F.lit(1) + F.col("label") % 3)
    volts = F.transform(F.col("embedding").cast("array<double>"), lambda x: level + gain * x)
    return e.select(
        "vec_id",
        F.when(F.col("label") % 2 == 0, "Vlt_96").otherwise("Dev_96").alias("pack_type"),
        volts.alias("_v"),
    ).select("vec_id", "pack_type", reshape(F.col("_v"), 8, 8).alias("m"))


PACK = """cells AS (
  SELECT vec_id, CASE WHEN label % 2 = 0 THEN 'Vlt_96' ELSE 'Dev_96' END AS pack_type,
         (i - 1) // 8 AS t, (i - 1) % 8 AS cell,
         3.3e0 + 0.15e0 * (vec_id % 5) + 0.1e0 * (1 + label % 3) * CAST(embedding[i] AS DOUBLE) AS v
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
PACK_METRICS = PACK + """,
stepdev AS (SELECT vec_id, t, stddev_pop(v) AS sd FROM cells GROUP BY 1, 2),
dev AS (SELECT vec_id, avg(sd) AS dev FROM stepdev GROUP BY 1),
lows AS (SELECT vec_id, any_value(pack_type) AS pack_type, min(v) AS vmin FROM cells GROUP BY 1),
metrics AS (
  SELECT l.vec_id, l.pack_type, l.vmin, d.dev,
         floor(l.vmin * 1e3 + 0.5e0) / 1e3 AS min_cell_voltage,
         floor(d.dev * 1e4 + 0.5e0) / 1e4 AS voltage_deviation,
         CASE WHEN l.vmin < 3.3e0 OR d.dev > 0.05e0 THEN 'DEFECT'
              WHEN l.vmin < 3.7e0 OR d.dev > 0.02e0 THEN 'CAUTION' ELSE 'NORMAL' END AS classification
  FROM lows l JOIN dev d USING (vec_id)),
soh AS (
  SELECT *, greatest(least(floor((100e0
      - 15e0 * least(voltage_deviation / 0.1e0, 1e0)
      - 15e0 * least(greatest(4.2e0 - min_cell_voltage, 0e0) / 1.2e0, 1e0)
      - 10e0 * (CASE classification WHEN 'NORMAL' THEN 0e0 WHEN 'DEFECT' THEN 1e0 ELSE 0.5e0 END))
      * 1e1 + 0.5e0) / 1e1, 100e0), 0e0) AS soh_proxy
  FROM metrics)"""


# Spectrograms: 8 frequency rows x 8 time columns in [0, 1].
def spec(spark, sf):
    x = F.col("x")
    low, high = F.array_min(x), F.array_max(x)
    unit = F.transform(x, lambda v: (v - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))
    return (
        table(spark, sf, "embeddings")
        .select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
        .select("vec_id", "label", "x", low.alias("_lo"), high.alias("_hi"))
        .select(
            "vec_id",
            (F.col("label") * 900 + 500).cast("double").alias("rpm"),
            reshape(unit, 8, 8).alias("e"),
        )
    )


SPEC = """spec AS (
  SELECT vec_id, rpm, (i - 1) // 8 AS f, (i - 1) % 8 AS t, (x[i] - lo) / (hi - lo) AS e
  FROM (SELECT vec_id, CAST(label * 900 + 500 AS DOUBLE) AS rpm, embedding::DOUBLE[] AS x,
               list_min(embedding)::DOUBLE AS lo, list_max(embedding)::DOUBLE AS hi FROM embeddings),
       (SELECT unnest(range(1, 65)) AS i))"""


# Predictions of two models over orders; one fold and vehicle per session.
def pred(spark, sf):
    truth = (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("y")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", truth)
    key, cust = F.col("o_orderkey"), F.col("o_custkey")

    def shifted(n):
        return F.when(key % n == 0, (F.col("y") + 1) % 5).otherwise(F.col("y"))

    return o.select(
        key.alias("sample_id"),
        cust.alias("session"),
        pick(VEHICLES, (cust % 3).cast("int")).alias("vehicle"),
        (F.floor(cust / 3) % 3).cast("int").alias("fold"),
        pick(CLASSES, F.col("y")).alias("true_label"),
        pick(CLASSES, shifted(7)).alias("pred_a"),
        pick(CLASSES, shifted(11)).alias("pred_b"),
    )


PRED = f"""pred AS (
  SELECT o_orderkey AS sample_id, o_custkey AS session, {_names(VEHICLES)}[CAST(o_custkey % 3 AS INTEGER) + 1] AS vehicle,
         CAST((o_custkey // 3) % 3 AS INTEGER) AS fold, {_names(CLASSES)}[y + 1] AS true_label,
         {_names(CLASSES)}[(CASE WHEN o_orderkey % 7 = 0 THEN (y + 1) % 5 ELSE y END) + 1] AS pred_a,
         {_names(CLASSES)}[(CASE WHEN o_orderkey % 11 = 0 THEN (y + 1) % 5 ELSE y END) + 1] AS pred_b
  FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 AS y FROM orders))"""


# Recording paths written out from orders; some names break the suffix rule.
def paths(spark, sf):
    o = table(spark, sf, "orders")
    vehicle = pick(VEHICLES, (F.col("o_custkey") % 3).cast("int"))
    fault = pick(CLASSES, F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    sensor = pick(SENSORS, (F.col("o_orderkey") % 3).cast("int"))
    rec = F.floor(F.col("o_orderkey") / 3)
    stamp = F.date_format("o_orderdate", "yy_MM_dd")
    name = F.concat(
        stamp, F.lit("_"), F.lpad(rec.cast("string"), 9, "0"), F.lit("_01_zsplit"),
        F.lpad((rec % 7 + 1).cast("string"), 3, "0"), F.lit("_"), sensor,
        F.when((F.col("o_orderstatus") == "P") | ((vehicle == "NIRO") & (fault == "REDUC") & (sensor == "Vib_TM")),
               F.lit("_raw.csv")).otherwise(F.lit("_timeseries.csv")),
    )
    return o.select(
        F.concat_ws("/", F.lit("/data"), vehicle, fault, F.date_format("o_orderdate", "MMdd"), sensor, name).alias("path")
    )


PATHS = f"""parts AS (
  SELECT {_names(VEHICLES)}[CAST(o_custkey % 3 AS INTEGER) + 1] AS pv,
         {_names(CLASSES)}[CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS pf,
         {_names(SENSORS)}[CAST(o_orderkey % 3 AS INTEGER) + 1] AS ps,
         o_orderkey // 3 AS rec, o_orderdate AS d, o_orderstatus AS st FROM orders),
paths AS (
  SELECT '/data/' || pv || '/' || pf || '/' || strftime(d, '%m%d') || '/' || ps || '/' ||
         strftime(d, '%y_%m_%d') || '_' || lpad(CAST(rec AS VARCHAR), 9, '0') || '_01_zsplit' ||
         lpad(CAST(rec % 7 + 1 AS VARCHAR), 3, '0') || '_' || ps ||
         CASE WHEN st = 'P' OR (pv = 'NIRO' AND pf = 'REDUC' AND ps = 'Vib_TM') THEN '_raw.csv' ELSE '_timeseries.csv' END AS path
  FROM parts),
named AS (
  SELECT path, split_part(path, '/', 3) AS vehicle, split_part(path, '/', 4) AS fault_class,
         split_part(path, '/', 5) AS date, split_part(path, '/', 6) AS sensor, split_part(path, '/', 7) AS file FROM paths),
idx AS (
  SELECT path AS csv_path, vehicle, fault_class, date, sensor,
         left(file, length(file) - length('_' || sensor || '_timeseries.csv')) AS group_key
  FROM named WHERE ends_with(file, '_' || sensor || '_timeseries.csv'))"""

