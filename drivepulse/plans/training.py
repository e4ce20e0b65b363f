"""Jobs from a recording tree to chunks, splits, models and their report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.functions.domains import CHUNK_ROWS, SENSORS
from drivepulse.functions.scalars import argmax0, decode_label, encode_label
from drivepulse.operators import evaluation, models, rocket, shaping, splits
from drivepulse.session import materialise
from drivepulse.sources import paths, signals, sinks


def build_index(spark: SparkSession, root: str, out: str | None = None) -> DataFrame:
    """Index of a recording tree, written as Parquet when ``out`` is given."""
    index = paths.recording_index(paths.list_files(spark, root, "*.csv"))
    return index if out is None else sinks.write_index(index, out)


# Buckets of recordings that an ingested sensor is cut into.
BUCKETS = 64
TABLE_COLUMNS = ("path", "time_idx", "group_key", "vehicle", "fault_class", "peak_freq_bin", "band_start", "band_end", "rms", "sensor", "bucket")


def _bucket(group: str = "group_key"):
    return F.pmod(F.xxhash64(group), F.lit(BUCKETS)).cast("int")


def _known(index: DataFrame) -> DataFrame:
    return index.select(paths.plain_path(F.col("csv_path")).alias("path"), "csv_path", "group_key", "sensor", "vehicle", "fault_class")


def _scan(index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the indexed files, no others, with what the index says of them, and the refused files."""
    files = [r["path"] for r in _known(index).select("path").collect()]  # one row per file, as in a listing
    if not files:
        raise ValueError("no recordings match the groups")
    rows, rejects = signals.scan_with_rejects(index.sparkSession, files)
    samples = rows.select("path", "time_idx", *signals.SIGNAL_COLUMNS)
    return samples.join(_known(index).drop("csv_path"), "path"), rejects


def ingest(index: DataFrame, out: str) -> DataFrame:
    """Samples of all indexed recordings as Parquet by (sensor, bucket of recordings), ordered inside; returns the table.

    Refused files go to ``{out}_rejects``. Later reads of some recordings open their buckets only, and
    row groups of other recordings are left out by their statistics.
    """
    spark = index.sparkSession
    rows, rejects = _scan(index)
    piece = F.expr("time_idx div 1000000")  # a very long recording is several tasks
    keyed = rows.withColumn("bucket", _bucket()).select(*TABLE_COLUMNS)
    keyed.repartition("sensor", "bucket", "group_key", piece).sortWithinPartitions("group_key", "path", "time_idx").write.mode(
        "overwrite").partitionBy("sensor", "bucket").parquet(f"{out.rstrip('/')}")
    rejects.write.mode("overwrite").parquet(f"{out.rstrip('/')}_rejects")
    return spark.read.parquet(out)


def pruned(table: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows of some (sensor, group_key) of an ingested table; partitions of others are not opened.

    The partitions are named in the plan: at most sensors times ``BUCKETS`` pairs come to the driver.
    """
    named = groups.select("sensor", "group_key").distinct().withColumn("bucket", _bucket())
    buckets: dict[str, list[int]] = {}
    for r in named.select("sensor", "bucket").distinct().collect():
        buckets.setdefault(r["sensor"], []).append(r["bucket"])
    wanted = F.lit(False)
    for sensor, numbers in sorted(buckets.items()):
        wanted = wanted | ((F.col("sensor") == sensor) & F.col("bucket").isin(sorted(numbers)))
    return table.filter(wanted).join(named, ["sensor", "bucket", "group_key"], "left_semi")


def chunks_of(rows: DataFrame, *, chunk_size: int = CHUNK_ROWS, value: str = "rms") -> DataFrame:
    """Repaired chunks of sample rows; recordings whose length is no multiple of the chunk size are left out."""
    placed = shaping.chunk_rows(rows.select("path", "time_idx", value), recording=["path"], chunk_size=chunk_size)
    clean = shaping.repair_gaps(placed, value, chunk=["path", "chunk_id"])
    chunks = shaping.assemble_chunks(clean, chunk=["path", "chunk_id"])
    known = rows.groupBy("path").agg(*[F.first(c).alias(c) for c in ("group_key", "sensor", "vehicle", "fault_class")])
    return chunks.join(known, "path").select(
        "group_key", "sensor", "vehicle", "fault_class", encode_label(F.col("fault_class")).alias("cls"), F.col("path").alias("csv_path"),
        "chunk_id", "x")


def skipped_files(rows: DataFrame, rejects: DataFrame, *, chunk_size: int = CHUNK_ROWS) -> DataFrame:
    """Rows ``path, reason`` of every file that gives no chunks: refused ones and those of a wrong length."""
    odd = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") % chunk_size != 0))
    return rejects.unionByName(odd.select("path", F.format_string(f"%d rows are no multiple of {chunk_size}", "n").alias("reason")))


def load_chunks(
    index: DataFrame, groups: DataFrame | None = None, *, chunk_size: int = CHUNK_ROWS, value: str = "rms"
) -> DataFrame:
    """Repaired chunks of the indexed recordings, optionally of some (sensor, group_key) only.

    Only these files are opened. For repeated loads :func:`ingest` once and read :func:`pruned` rows.
    """
    return load_with_skipped(index, groups, chunk_size=chunk_size, value=value)[0]


def load_with_skipped(
    index: DataFrame, groups: DataFrame | None = None, *, chunk_size: int = CHUNK_ROWS, value: str = "rms"
) -> tuple[DataFrame, DataFrame]:
    """The chunks of :func:`load_chunks` and ``path, reason`` of every file that gave none."""
    rows, rejects = _scan(index if groups is None else index.join(groups, ["sensor", "group_key"], "left_semi"))
    return chunks_of(rows, chunk_size=chunk_size, value=value), skipped_files(rows, rejects, chunk_size=chunk_size)


def export_validation_chunks(index: DataFrame, split: DataFrame, out: str, *, chunk_size: int = CHUNK_ROWS) -> DataFrame:
    """Chunk table of the validation groups, partitioned by sensor and ordered by group; files that gave no chunks go to ``{out}_skipped``."""
    held = split.filter(F.col("side") == "val").select("sensor", "group_key")
    chunks, skipped = load_with_skipped(index, held, chunk_size=chunk_size)
    sinks.write_chunks(chunks, out)
    skipped.write.mode("overwrite").json(f"{out.rstrip('/')}_skipped")
    return index.sparkSession.read.parquet(out)


def split_groups(index: DataFrame, **kw) -> DataFrame:
    """Hold-out by recording group per sensor, with the first class of each group."""
    labels = splits.group_labels(index, group="group_key", label="fault_class", by=["sensor"], order="csv_path")
    out = splits.group_holdout(labels, by="sensor", group="group_key", label="fault_class", **kw)
    splits.assert_no_leak(out, by="sensor", group="group_key")
    return out


def train_sensors(
    chunks: DataFrame, split: DataFrame, root: str, *, n_features: int = 10_000, sensors: Sequence[str] = SENSORS,
    max_iter: int = 1000,
) -> DataFrame:
    """One feature plan and model per sensor; returns the validation report.

    Plans and models see the training side only. Models go to ``{root}/models``,
    the report to ``{root}/summary``.
    """
    spark = chunks.sparkSession
    sided = chunks.join(split.select("sensor", "group_key", "side"), ["sensor", "group_key"])
    keyed = sided.withColumn("chunk_key", F.concat_ws("#", "sensor", "group_key", F.col("chunk_id").cast("string")))
    keyed = materialise(keyed, "chunks")
    length = keyed.select(F.size("x")).first()[0]
    fitted, parts = {}, []
    for sensor in sensors:
        mine = keyed.filter(F.col("sensor") == sensor)
        plan = rocket.make_plan(length, n_features=n_features)
        plan = rocket.fit_biases(mine.filter(F.col("side") == "train"), plan, key="chunk_key")
        features = materialise(rocket.transform(mine, plan, keys=["chunk_key", "sensor", "cls", "side"]), "features")
        fitted[sensor] = models.train(features.filter(F.col("side") == "train"), max_iter=max_iter)
        parts.append(features.filter(F.col("side") == "val"))
    models.ModelStore(spark, f"{root}/models").save(fitted)
    table = models.coefficient_table(spark, fitted)
    held = parts[0]
    for p in parts[1:]:
        held = held.unionByName(p)
    scored = models.linear_probabilities(held, table).select(
        "sensor", decode_label(F.col("cls")).alias("true_label"),
        decode_label(argmax0(F.col("probs"))).alias("predicted_label"),
    )
    report = evaluation.classification_report(scored, ["sensor"])
    sinks.write_splits(report, f"{root}/summary")
    return report
