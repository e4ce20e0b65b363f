"""From battery files to responses and alerts: new files only, each version once.

A batch is the set of matrix files whose version (time and size of the matrix and of its label) no
earlier batch has answered. Its results are written to folders named after the set, and last of all
its files are entered in the ledger; results of folders that the ledger does not name are not read.
So a job that is lost half-way is simply run again, and running it twice adds nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.operators import alerts, battery, health
from drivepulse.session import materialise
from drivepulse.sources import binary, paths
from drivepulse.sources.signals import literal_path
from drivepulse.sources.sinks import fingerprint

LEDGER = "matrix_path string, version string, batch string"
UNREADABLE = "matrix is unreadable or not two-dimensional"


def listing(spark: SparkSession, root: str) -> DataFrame:
    """Rows ``path, version``: matrices and labels below ``root`` without their contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{npy,json}").load(root)
    stamp = F.concat_ws("|", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
    return files.select(F.col("path"), stamp.alias("version"))


def _ledger(spark: SparkSession, out: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(f"{out}/ledger")
    except AnalysisException:  # nothing is done yet
        return spark.createDataFrame([], LEDGER)


def new_packs(spark: SparkSession, root: str, out: str) -> DataFrame:
    """Indexed packs whose version is not in the ledger."""
    files = listing(spark, root)
    index = paths.pack_index(files.select("path"))
    index = index.join(files.withColumnsRenamed({"path": "matrix_path", "version": "_m"}), "matrix_path")
    index = index.join(files.withColumnsRenamed({"path": "label_path", "version": "_l"}), "label_path")
    named = index.withColumn("version", F.sha2(F.concat_ws("#", "_m", "label_path", "_l"), 256)).drop("_m", "_l")
    return named.join(_ledger(spark, out), ["matrix_path", "version"], "left_anti")


def results(spark: SparkSession, out: str, name: str) -> DataFrame:
    """``responses``, ``alerts`` or ``rejects`` of all finished batches."""
    done = _ledger(spark, out).select("batch").distinct()
    return spark.read.parquet(f"{out}/{name}").join(done, "batch", "left_semi")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The response of the newest version of every matrix."""
    return health.latest(results(spark, out, "responses"), ["matrix_path"], ["ts", "version"])


def run(spark: SparkSession, root: str, out: str, *, now: str) -> int:
    """Answers all new packs below ``root`` with the time ``now``; returns how many there were."""
    out = out.rstrip("/")
    packs = materialise(new_packs(spark, root, out), "packs")
    batch = fingerprint(packs.withColumn("_all", F.lit(1)), ["_all"], F.concat_ws("|", "matrix_path", "version")).first()
    if batch is None:
        return 0
    name = batch["sha256"][:32]
    # Only the files of the batch are opened: their paths are one row per file, as in the listing.
    matrices = binary.scan_matrices(spark, [literal_path(r["matrix_path"]) for r in packs.select("matrix_path").collect()])
    labels = binary.scan_labels(spark, [literal_path(r["label_path"]) for r in packs.select("label_path").distinct().collect()])
    temperature = labels.select(paths.plain_path(F.col("path")).alias("_label"), F.col("metadata.temperature").alias("_temperature"))
    temperature = temperature.groupBy("_label").agg(F.first("_temperature", ignorenulls=True).alias("_temperature"))
    read = packs.join(matrices.withColumnRenamed("path", "matrix_path"), "matrix_path", "left")
    read = read.withColumn("_label", paths.plain_path(F.col("label_path"))).join(temperature, "_label", "left").drop("_label")
    read = materialise(read, "matrices")
    readable = F.coalesce(F.size("m") > 0, F.lit(False))
    rejects = read.filter(~readable).select("matrix_path", "version", F.lit(UNREADABLE).alias("reason"))
    answered = battery.response_columns(
        read.filter(readable), classification=F.col("status"), pack_type=F.col("pack_type"), temperature=F.col("_temperature"))
    responses = answered.select(
        "matrix_path", "version", F.lit(now).cast("timestamp").alias("ts"), F.col("vehicle").alias("car_model"), health.battery_part("fault_type").alias("battery"))
    raised = alerts.pack_alerts(answered.select(
        F.concat_ws("|", "matrix_path", "version").alias("response_id"), F.lit(now).cast("timestamp").alias("ts"),
        F.col("matrix_path").alias("vehicle_id"), F.col("vehicle").alias("car_model"), "battery_status", "classification", "soh_proxy",
        F.size("faulty_cells").alias("n_faulty")))
    for folder, rows in (("responses", responses), ("alerts", raised), ("rejects", rejects)):
        rows.write.mode("overwrite").parquet(f"{out}/{folder}/batch={name}")
    packs.select("matrix_path", "version").write.mode("overwrite").parquet(f"{out}/ledger/batch={name}")
    return batch["members"]
