"""Index, coverage and pairing queries over recording paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, META_COLUMNS, SENSORS
from drivepulse.functions.matrices import reshape, spread
from drivepulse.functions.scalars import half_up
from drivepulse.operators import shaping
from drivepulse.plans.registry import half_up_sql as r
from drivepulse.plans.registry import query
from drivepulse.plans.views import PANEL, PATHS, SIG, panel, paths, sig, table
from drivepulse.sources import paths as ix
from drivepulse.session import shared_dir
from drivepulse.sources import signals as sg


def index(spark, sf):
    return ix.recording_index(paths(spark, sf))


@query("recording_index", "WITH " + PATHS + " SELECT csv_path, vehicle, fault_class, date, sensor, group_key FROM idx")
def q_index(spark, sf):
    return index(spark, sf)


@query(
    "group_key",
    "WITH " + PATHS + """ SELECT path, CASE WHEN ends_with(file, '_' || sensor || '_timeseries.csv')
  THEN left(file, length(file) - length('_' || sensor || '_timeseries.csv')) ELSE '-' END AS group_key FROM named""",
)
def q_group_key(spark, sf):
    p = F.col("path")
    return paths(spark, sf).select("path", F.coalesce(ix.group_key(ix.part(p, 1), ix.part(p, 2)), F.lit("-")).alias("group_key"))


@query(
    "coverage_gaps",
    "WITH " + PATHS + """,
leaf AS (SELECT vehicle, fault_class, date, sensor, max(ends_with(file, '_' || sensor || '_timeseries.csv')) AS ok FROM named GROUP BY 1, 2, 3, 4),
dom AS (SELECT * FROM (SELECT unnest(['IONIQ','KONA','NIRO']) AS vehicle), (SELECT unnest(['NORMAL','ECC10','ECC20','DEMAG','REDUC','GHOST']) AS fault_class)),
missing AS (SELECT vehicle, fault_class, '-' AS date, '-' AS sensor, 'class folder missing' AS problem FROM dom
  WHERE NOT EXISTS (SELECT 1 FROM leaf l WHERE l.vehicle = dom.vehicle AND l.fault_class = dom.fault_class)),
wanted AS (SELECT DISTINCT vehicle, fault_class, date, s.sensor FROM leaf, (SELECT unnest(['Current_U','Vib_Motor','Vib_TM']) AS sensor) s)
SELECT * FROM missing UNION ALL
SELECT w.vehicle, w.fault_class, w.date, w.sensor, CASE WHEN l.ok IS NULL THEN 'sensor leaf missing' ELSE 'sensor leaf empty' END
FROM wanted w LEFT JOIN leaf l ON w.vehicle = l.vehicle AND w.fault_class = l.fault_class AND w.date = l.date AND w.sensor = l.sensor
WHERE l.ok IS NULL OR NOT l.ok""",
)
def q_coverage(spark, sf):
    return ix.coverage_gaps(paths(spark, sf), classes=(*CLASSES, "GHOST")).fillna("-")


@query(
    "index_overview",
    "WITH " + PATHS + " SELECT count(*) AS n_rows, count(DISTINCT group_key) AS n_groups, count(DISTINCT (vehicle, sensor, fault_class)) AS n_combinations FROM idx",
)
def q_overview(spark, sf):
    return ix.index_overview(index(spark, sf))


def _pivot_sql(by):
    cols = ", ".join(f"count(*) FILTER (WHERE fault_class = '{c}') AS \"{c}\"" for c in CLASSES)
    return "WITH " + PATHS + f" SELECT {by}, {cols} FROM idx GROUP BY 1"


@query("index_by_vehicle", _pivot_sql("vehicle"))
def q_by_vehicle(spark, sf):
    return ix.index_pivot(index(spark, sf), "vehicle")


@query("index_by_sensor", _pivot_sql("sensor"))
def q_by_sensor(spark, sf):
    return ix.index_pivot(index(spark, sf), "sensor")


@query(
    "index_stats",
    "WITH " + PATHS + " SELECT count(*) AS total, array_to_string(list_sort(list(DISTINCT vehicle || '/' || fault_class)), ',') AS keys FROM idx",
)
def q_stats(spark, sf):
    return ix.index_stats(index(spark, sf), "fault_class")


# Lengths stand in for row counts: lines per order, in thousands.
_SIZES = PATHS + """,
len AS (SELECT l_orderkey AS k, count(*) * 2000 AS n_rows FROM lineitem GROUP BY 1),
sized AS (SELECT i.vehicle, i.sensor, i.fault_class, i.csv_path, l.n_rows, l.n_rows // 2000 AS n_chunks
  FROM (SELECT *, CAST(split_part(split_part(group_key, '_', 4), '_', 1) AS BIGINT) * 3
               + list_position(['Current_U','Vib_Motor','Vib_TM'], sensor) - 1 AS k FROM idx) i JOIN len l ON i.k = l.k)"""


def sized(spark, sf):
    """Recordings with a row count taken from the lines of their order."""
    i = index(spark, sf)
    rec = F.split("group_key", "_")[3].cast("long")
    key = rec * 3 + F.array_position(F.array(*[F.lit(s) for s in SENSORS]), F.col("sensor")) - 1
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg((F.count(F.lit(1)) * 2000).alias("n_rows"))
    return i.withColumn("k", key).join(lines, "k").withColumn("n_chunks", F.floor(F.col("n_rows") / 2000))


@query("sweep_sizes", "WITH " + _SIZES + " SELECT csv_path, n_rows, n_chunks, n_rows IN (2000, 4000, 6000, 8000, 10000) AS allowed FROM sized")
def q_sizes(spark, sf):
    return sized(spark, sf).select(
        "csv_path", "n_rows", "n_chunks", F.col("n_rows").isin(2000, 4000, 6000, 8000, 10000).alias("allowed")
    )


@query(
    "sweep_distribution",
    "WITH " + _SIZES + """, f AS (SELECT n_rows, count(*) AS n, CAST(sum(n_chunks) AS BIGINT) AS c FROM sized GROUP BY 1),
d AS (SELECT unnest([2000, 4000, 6000, 8000, 10000])::BIGINT AS n_rows)
SELECT coalesce(d.n_rows, f.n_rows) AS n_rows, d.n_rows IS NOT NULL AS expected, coalesce(n, 0) AS n_recordings, coalesce(c, 0) AS n_chunks
FROM d FULL JOIN f ON d.n_rows = f.n_rows""",
)
def q_distribution(spark, sf):
    return sg.length_distribution(sized(spark, sf))


@query(
    "sweep_pivot",
    "WITH " + _SIZES + " SELECT vehicle, sensor, "
    + ", ".join(f"CAST(coalesce(sum(CASE WHEN fault_class = '{c}' THEN n_chunks END), 0) AS BIGINT) AS \"{c}\"" for c in CLASSES)
    + ", CAST(sum(n_chunks) AS BIGINT) AS \"TOTAL\" FROM sized GROUP BY 1, 2",
)
def q_sweep_pivot(spark, sf):
    return sg.chunk_pivot(sized(spark, sf))


@query(
    "recording_meta",
    "WITH " + SIG + " SELECT unit, arg_min(sensor, (ts, seq)) AS sensor, arg_min(seq, (ts, seq)) AS first_seq FROM sig GROUP BY 1",
)
def q_meta(spark, sf):
    s = sig(spark, sf).withColumn("first_seq", F.col("seq")).withColumn("at", F.struct("ts", "seq"))
    return sg.recording_meta(s, recording=["unit"], order="at", meta=["sensor", "first_seq"], label=None)


# Battery files: every order is a matrix; some labels are missing or misnamed.
_PACKFILES = """files AS (
  SELECT kind, folder, stem, '/raw/' || kind || '/' || pt AS u, pt, v, s,
         '/x/' || pt || '/' || kind || '/' || v || '/' || s || '/' || folder || '/' || stem || CASE kind WHEN 'NPY' THEN '.npy' ELSE '.json' END AS path
  FROM (SELECT ['Vlt_96','Vlt_98','Dev_96','Dev_98'][CAST(o_orderkey % 4 AS INTEGER) + 1] AS pt, ['IONIQ','KONA','NIRO'][CAST(o_custkey % 3 AS INTEGER) + 1] AS v,
        ['NORMAL','CAUTION','DEFECT'][CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END] AS s, strftime(o_orderdate, '%m%d') || '/' || CAST(o_custkey % 10 AS VARCHAR) AS folder,
        CASE WHEN kind = 'JSON' AND o_orderkey % 5 = 0 THEN 'other' ELSE 'p' END || CAST(o_orderkey AS VARCHAR) AS stem, kind, o_orderkey AS ok
        FROM orders, (SELECT unnest(['NPY','JSON']) AS kind)) WHERE kind = 'NPY' OR ok % 3 > 0)"""


def pack_files(spark, sf):
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.col("kind")
    o = table(spark, sf, "orders").withColumn("kind", F.explode(F.array(F.lit("NPY"), F.lit("JSON"))))
    pt = F.get(F.array(*[F.lit(t) for t in ("Vlt_96", "Vlt_98", "Dev_96", "Dev_98")]), (key % 4).cast("int"))
    v = F.get(F.array(*[F.lit(t) for t in ("IONIQ", "KONA", "NIRO")]), (cust % 3).cast("int"))
    s = F.when(F.col("o_orderstatus") == "F", "NORMAL").when(F.col("o_orderstatus") == "O", "CAUTION").otherwise("DEFECT")
    stem = F.concat(F.when((kind == "JSON") & (key % 5 == 0), "other").otherwise("p"), key.cast("string"))
    path = F.concat_ws(
        "/", F.lit("/x"), pt, kind, v, s, F.date_format("o_orderdate", "MMdd"), (cust % 10).cast("string"),
        F.concat(stem, F.when(kind == "NPY", ".npy").otherwise(".json")),
    )
    # Every third matrix has no label of its own.
    return o.filter((kind == "NPY") | (key % 3 > 0)).select(path.alias("path"))


@query(
    "pack_index",
    "WITH " + _PACKFILES + """,
d AS (SELECT * FROM files WHERE kind = 'NPY'), j AS (SELECT * FROM files WHERE kind = 'JSON'),
e AS (SELECT pt, v, s, folder, stem, min(path) AS p FROM j GROUP BY ALL), a AS (SELECT pt, v, s, folder, min(path) AS p FROM j GROUP BY ALL)
SELECT d.path AS matrix_path, coalesce(e.p, a.p) AS label_path, d.pt AS pack_type, d.v AS vehicle, d.s AS status
FROM d LEFT JOIN e ON d.pt = e.pt AND d.v = e.v AND d.s = e.s AND d.folder = e.folder AND d.stem = e.stem
LEFT JOIN a ON d.pt = a.pt AND d.v = a.v AND d.s = a.s AND d.folder = a.folder WHERE coalesce(e.p, a.p) IS NOT NULL""",
)
def q_pack_index(spark, sf):
    return ix.pack_index(pack_files(spark, sf))


def image_files(spark, sf):
    """Images of all recordings plus labels for the leading channel of two thirds of them."""
    o = table(spark, sf, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    v = F.get(F.array(*[F.lit(t) for t in ("IONIQ", "KONA", "NIRO")]), (cust % 3).cast("int"))
    fault = F.get(F.array(*[F.lit(c) for c in CLASSES]), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    sensor = F.get(F.array(*[F.lit(s) for s in SENSORS]), F.col("s"))
    n = F.explode(F.sequence(F.lit(0), F.lit(2)))
    kind = F.explode(F.array(F.lit("png"), F.lit("json")))
    fanned = o.withColumn("s", n).withColumn("kind", kind)
    present = F.when(
        F.col("kind") == "png", (key % 7 != F.col("s")) & ~((cust % 4 == 0) & (F.col("s") == 0))
    ).otherwise(key % 3 > 0)
    path = F.concat_ws(
        "/", F.when(F.col("kind") == "png", "/img").otherwise("/lbl"), v, fault, F.date_format("o_orderdate", "yyMMdd"),
        sensor, F.concat(F.lit("r"), key.cast("string"), F.lit("_"), sensor, F.lit("."), F.col("kind")),
    )
    return fanned.filter(present).select(path.alias("path"))


_IMG = """f0 AS (
  SELECT *, ['Current_U','Vib_Motor','Vib_TM'][s + 1] AS channel FROM (
    SELECT o_orderkey AS k, o_custkey AS c, ['IONIQ','KONA','NIRO'][CAST(o_custkey % 3 AS INTEGER) + 1] AS vehicle,
      ['NORMAL','ECC10','ECC20','DEMAG','REDUC'][CAST(substr(o_orderpriority, 1, 1) AS INTEGER)] AS fault_class, strftime(o_orderdate, '%y%m%d') AS date, s, kind
    FROM orders, (SELECT unnest(range(0, 3)) AS s), (SELECT unnest(['png','json']) AS kind))
  WHERE CASE kind WHEN 'png' THEN k % 7 <> s AND NOT (c % 4 = 0 AND s = 0) ELSE k % 3 > 0 END),
f AS (SELECT *, CASE kind WHEN 'png' THEN '/img/' ELSE '/lbl/' END || vehicle || '/' || fault_class || '/' || date || '/' || channel || '/r' || CAST(k AS VARCHAR) || '_' || channel || '.' || kind AS path,
   vehicle || '/' || fault_class || '/' || date AS day FROM f0),
png AS (SELECT * FROM f WHERE kind = 'png'), js AS (SELECT * FROM f WHERE kind = 'json'),
lead_ AS (SELECT day, coalesce(max(CASE WHEN channel = 'Current_U' THEN channel END), min(channel)) AS lead_channel FROM png GROUP BY 1),
led AS (SELECT p.*, l.lead_channel FROM png p JOIN lead_ l ON p.day = l.day AND p.channel = l.lead_channel),
spare AS (SELECT day, channel, min(path) AS path FROM png GROUP BY 1, 2),
asked AS (SELECT l.path, l.day, l.vehicle, l.fault_class, l.lead_channel, l.k, ch, coalesce(x.path, s.path) AS file
  FROM led l CROSS JOIN (SELECT unnest(['Current_U','Vib_Motor','Vib_TM']) AS ch)
  LEFT JOIN png x ON x.day = l.day AND x.channel = ch AND x.k = l.k LEFT JOIN spare s ON s.day = l.day AND s.channel = ch),
wide AS (SELECT path, day, vehicle, fault_class, lead_channel, k, max(CASE WHEN ch = 'Current_U' THEN file END) AS current_u,
   max(CASE WHEN ch = 'Vib_Motor' THEN file END) AS vib_motor, max(CASE WHEN ch = 'Vib_TM' THEN file END) AS vib_tm FROM asked GROUP BY ALL),
jex AS (SELECT day, channel, k, min(path) AS p FROM js GROUP BY ALL), jany AS (SELECT day, channel, min(path) AS p FROM js GROUP BY ALL),
images AS (SELECT w.*, coalesce(e.p, a.p) AS label_path FROM wide w LEFT JOIN jex e ON e.day = w.day AND e.channel = w.lead_channel AND e.k = w.k
  LEFT JOIN jany a ON a.day = w.day AND a.channel = w.lead_channel WHERE coalesce(e.p, a.p) IS NOT NULL)"""


@query(
    "spectrogram_index",
    "WITH " + _IMG + " SELECT path, vehicle, fault_class, label_path, coalesce(current_u, '-') AS current_u, coalesce(vib_motor, '-') AS vib_motor, coalesce(vib_tm, '-') AS vib_tm FROM images",
)
def q_images(spark, sf):
    out = ix.spectrogram_index(image_files(spark, sf))
    return out.select(
        "path", "vehicle", "fault_class", "label_path",
        *[F.coalesce(F.try_element_at("channels", F.lit(s)), F.lit("-")).alias(s.lower()) for s in SENSORS],
    )


@query(
    "relative_resource",
    "WITH " + _IMG + " SELECT path, '/static/' || substr(coalesce(current_u, vib_motor, vib_tm), 6) AS url FROM images",
)
def q_resource(spark, sf):
    out = ix.spectrogram_index(image_files(spark, sf))
    return out.select("path", ix.relative_resource(F.col("channels"), "/img", "/static/").alias("url"))


# Fragments: the order numbers of a customer, with holes.
@query(
    "stitched_runs",
    """WITH f AS (SELECT l_suppkey AS rec, l_partkey AS frag, count(*) AS n_rows FROM lineitem GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN frag - lag(frag) OVER (PARTITION BY rec ORDER BY frag) = 1 THEN 0 ELSE 1 END AS br FROM f),
c AS (SELECT *, CAST(sum(br) OVER (PARTITION BY rec ORDER BY frag) AS BIGINT) AS run FROM b)
SELECT rec, run, min(frag) AS first_fragment, max(frag) AS last_fragment, count(*) AS n_fragments, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM c GROUP BY 1, 2""",
)
def q_stitch(spark, sf):
    frags = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("rec"), F.col("l_partkey").alias("frag")).agg(
        F.count(F.lit(1)).alias("rows_in")
    )
    return shaping.stitch_fragments(frags, recording=["rec"], number="frag", size="rows_in")


def _channels(spark, sf):
    """Each sensor has two channels of 32 samples; Vib_TM is two samples short."""
    p = panel(spark, sf)
    two = reshape(F.col("x"), 2, 32)
    short = F.transform(two, lambda c: F.slice(c, 1, 30))
    return p.select("session", "sensor", F.when(F.col("sensor") == "Vib_TM", short).otherwise(two).alias("channels"))


@query(
    "early_fusion",
    "WITH " + PANEL + f""", el AS (SELECT session, sensor, unnest(x) AS v, generate_subscripts(x, 1) - 1 AS i FROM panel),
full_ AS (SELECT session FROM panel GROUP BY 1 HAVING count(DISTINCT sensor) = 3)
SELECT e.session, CAST((list_position(['Current_U','Vib_Motor','Vib_TM'], sensor) - 1) * 2 + i // 32 AS INTEGER) AS channel, CAST((i % 32) // 15 AS INTEGER) AS chunk_id,
  CAST(i % 32 % 15 AS INTEGER) AS pos, {r('v', 6)} AS v FROM el e JOIN full_ USING (session) WHERE i % 32 < 30""",
)
def q_fusion(spark, sf):
    fused = shaping.fuse_sensors(_channels(spark, sf), session=["session"])
    chunks = shaping.panel_chunks(fused, ["session"], 15)
    return (
        spread(spread(chunks, ["session", "chunk_id"], "fused", "channel", "_c"), ["session", "chunk_id", "channel"], "_c", "pos", "v")
        .withColumn("v", half_up(F.col("v"), 6))
    )


@query(
    "session_completeness",
    "WITH " + PANEL + """, s AS (SELECT session, sensor, CASE WHEN vec_id % 11 = 0 THEN 30 ELSE 32 END AS length FROM panel)
SELECT session, count(DISTINCT sensor) AS n_sensors, min(length) AS min_len, max(length) AS max_len,
  count(DISTINCT sensor) = 3 AND min(length) = max(length) AS complete FROM s GROUP BY 1""",
)
def q_complete(spark, sf):
    s = panel(spark, sf).select("session", "sensor", F.when(F.col("vec_id") % 11 == 0, 30).otherwise(32).alias("length"))
    return shaping.session_completeness(s, session=["session"])


@query(
    "signal_csv_scan",
    """SELECT CAST(user_id AS VARCHAR) AS group_key, count(*) AS n_rows, count(CASE WHEN event_id % 20 <> 0 THEN 1 END) AS n_values,
  CAST(sum(event_id) AS BIGINT) AS place_sum FROM events WHERE user_id % 10 <> 7 GROUP BY 1""",
)
def q_csv_scan(spark, sf):
    """Recordings written as CSV with two orders of columns and, for some, without a metadata column; the latter are refused."""
    text = {c: F.lit("x") for c in META_COLUMNS} | {"group_key": F.col("user_id").cast("string"), "sensor": F.col("event_type")}
    values = {"time_idx": F.col("event_id"), "peak_freq_bin": F.lit(1), "band_start": F.lit(0), "band_end": F.lit(2),
              "rms": F.when(F.col("event_id") % 20 != 0, F.col("value")).otherwise(F.lit("NaN").cast("double"))}
    names = [*META_COLUMNS, *values]
    rows = table(spark, sf, "events").select("user_id", *[e.alias(c) for c, e in (text | values).items()])
    root = shared_dir(spark, "recordings")
    parts = {
        "plain": (rows.filter("user_id % 2 = 0 AND user_id % 10 <> 7"), names), "turned": (rows.filter("user_id % 2 = 1 AND user_id % 10 <> 7"), names[::-1]),
        "lacking": (rows.filter("user_id % 10 = 7"), [n for n in names if n != "zsplit"])}
    for folder, (part, columns) in parts.items():
        part.select(*columns).write.option("header", True).csv(f"{root}/{folder}")
    found = sg.scan_signals(spark, [f"{root}/{folder}" for folder in parts], skip_unreadable=True)
    return found.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("rms").alias("n_values"), F.sum("time_idx").alias("place_sum"))
