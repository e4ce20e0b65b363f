"""Signal recordings: CSV scan, metadata split, length checks and sweep report."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from drivepulse.functions.domains import ALLOWED_ROW_COUNTS, CHUNK_ROWS, CLASSES, META_COLUMNS, SIGNAL_COLUMNS
from drivepulse.functions.scalars import encode_label
from drivepulse.sources.paths import plain_path

SIGNAL_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in META_COLUMNS]
    + [T.StructField("time_idx", T.LongType())]
    + [T.StructField(c, T.FloatType()) for c in SIGNAL_COLUMNS]
)


# What a refused file is listed with.
NO_HEADER, BAD_ROWS, EMPTY = "no header with time_idx", "malformed rows", "empty file"
_BAD = "_malformed"


def file_headers(spark: SparkSession, files: str | Sequence[str]) -> DataFrame:
    """Rows ``path, header`` of all files; the header is null where none names ``time_idx``.

    Files are read as text once; of each only its header line goes on.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(files).select(plain_path(F.col("path")).alias("path"))
    lines = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(files)
    named = lines.filter(F.col("value").rlike(r'(^|[,\s"])time_idx([,\s"]|$)'))
    found = named.groupBy(plain_path(F.col("_metadata.file_path")).alias("path")).agg(F.min("value").alias("header"))
    return listed.join(found, "path", "left")


def header_columns(header: str) -> list[str]:
    return [c.strip().strip('"') for c in header.lstrip("\ufeff").rstrip("\r\n").split(",")]


def literal_path(path: str) -> str:
    """A path in which signs of file patterns stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def _scan_group(spark: SparkSession, columns: Sequence[str], files: Sequence[str]) -> DataFrame:
    """Rows of files with the same header; rows with too few, too many or unreadable fields are marked."""
    fields = {f.name: f for f in SIGNAL_SCHEMA}
    schema = T.StructType([fields.get(c, T.StructField(c, T.StringType())) for c in columns] + [T.StructField("_corrupt", T.StringType())])
    raw = (
        spark.read.schema(schema)
        .option("header", True)
        .option("nanValue", "NaN")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("columnPruning", False)  # without all fields a short row would pass
        .csv([literal_path(f) for f in files])
    )
    present = [
        (F.nanvl(F.col(c), F.lit(None).cast("float")) if c in SIGNAL_COLUMNS else F.col(c)).alias(c) if c in columns
        else F.lit(None).cast(f.dataType).alias(c) for c, f in fields.items()]
    bad = F.col("_corrupt").isNotNull() | F.col("time_idx").isNull()
    return raw.select(plain_path(F.col("_metadata.file_path")).alias("path"), *present, bad.alias(_BAD))


def scan_with_rejects(spark: SparkSession, files: str | Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Recordings as rows with ``path``, and ``path, reason`` of the files that were refused.

    Columns are found by name: files with the same header, whatever its order, share a scan. A file
    that lacks a metadata column or ``time_idx``, or holds a row that does not fit its header, is
    refused as a whole and listed, an empty one where it is named itself. NaN samples become null, absent signal columns are null.
    """
    groups: dict[tuple[str, ...], list[str]] = {}
    refused: list[tuple[str, str]] = []
    seen: set[str] = set()
    for r in file_headers(spark, files).collect():  # one row per file, which the driver lists anyway
        seen.add(r["path"])
        columns = tuple(header_columns(r["header"])) if r["header"] is not None else ()
        missing = [c for c in META_COLUMNS if c not in columns]
        twice = sorted({c for c in columns if columns.count(c) > 1})
        if "time_idx" not in columns:
            refused.append((r["path"], NO_HEADER))
        elif missing:
            refused.append((r["path"], f"missing metadata columns: {missing}"))
        elif twice:
            refused.append((r["path"], f"repeated columns: {twice}"))
        else:
            groups.setdefault(columns, []).append(r["path"])
    # Readers leave empty files out, so they are known only where they are named.
    folders = {p.rsplit("/", n)[0] for p in seen for n in range(p.count("/") + 1)}
    for name in () if isinstance(files, str) else files:
        plain = re.sub("^file:/+", "/", name.rstrip("/"))
        if plain not in seen and plain not in folders:
            refused.append((plain, EMPTY))
    rejects = spark.createDataFrame(sorted(refused), "path string, reason string")
    if not groups:
        empty = T.StructType([T.StructField("path", T.StringType()), *SIGNAL_SCHEMA.fields])
        return spark.createDataFrame([], empty), rejects
    rows = reduce(DataFrame.unionByName, [_scan_group(spark, c, f) for c, f in sorted(groups.items())])
    broken = rows.filter(_BAD).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    broken = broken.select("path", F.format_string(f"{BAD_ROWS}: %d", "n").alias("reason"))
    return rows.join(broken.select("path"), "path", "left_anti").drop(_BAD), rejects.unionByName(broken)


def scan_signals(spark: SparkSession, files: str | Sequence[str], *, skip_unreadable: bool = False) -> DataFrame:
    """Rows of :func:`scan_with_rejects`. Refused files are an error unless ``skip_unreadable`` is set."""
    rows, rejects = scan_with_rejects(spark, files)
    found = [] if skip_unreadable else rejects.orderBy("path").take(5)
    if found:
        raise ValueError("files that cannot be read: " + "; ".join(f"{r['path']} ({r['reason']})" for r in found))
    return rows


def recording_meta(
    rows: DataFrame,
    *,
    recording: Sequence[str] = ("path",),
    order: str = "time_idx",
    meta: Sequence[str] = META_COLUMNS,
    label: str | None = "fault_class",
) -> DataFrame:
    """One metadata row per recording, taken from its first row, with ``label_id``."""
    first = rows.groupBy(*recording).agg(F.min_by(F.struct(*meta), F.col(order)).alias("_m"))
    out = first.select(*recording, *[F.col(f"_m.{c}").alias(c) for c in meta if c not in recording])
    return out if label is None else out.withColumn("label_id", encode_label(F.col(label)))


def signal_part(rows: DataFrame, *, recording: Sequence[str] = ("path",)) -> DataFrame:
    return rows.select(*recording, "time_idx", *SIGNAL_COLUMNS)


def row_count_check(
    rows: DataFrame,
    *,
    recording: Sequence[str] = ("path",),
    allowed: Sequence[int] = ALLOWED_ROW_COUNTS,
    chunk_size: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows and whole chunks per recording and whether the length is an expected one."""
    sizes = rows.groupBy(*recording).agg(F.count(F.lit(1)).alias("n_rows"))
    return sizes.withColumn("n_chunks", F.floor(F.col("n_rows") / chunk_size)).withColumn(
        "allowed", F.col("n_rows").isin(*allowed)
    )


def length_distribution(sizes: DataFrame, allowed: Sequence[int] = ALLOWED_ROW_COUNTS) -> DataFrame:
    """Recordings per expected length (zero-filled) followed by the unexpected lengths."""
    spark = sizes.sparkSession
    expected = spark.createDataFrame([(int(a),) for a in allowed], "n_rows long")
    found = sizes.groupBy("n_rows").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chunks").alias("chunks"))
    return F.broadcast(expected).withColumn("expected", F.lit(True)).join(found, "n_rows", "full_outer").select(
        "n_rows",
        F.coalesce("expected", F.lit(False)).alias("expected"),
        F.coalesce("n", F.lit(0)).alias("n_recordings"),
        F.coalesce("chunks", F.lit(0)).alias("n_chunks"),
    )


def chunk_pivot(sizes: DataFrame, *, rows: Sequence[str] = ("vehicle", "sensor"), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Chunks per (vehicle, sensor) and class with a row total."""
    wide = sizes.groupBy(*rows).pivot("fault_class", list(classes)).agg(F.sum("n_chunks")).fillna(0)
    total = sum((F.col(c) for c in classes[1:]), F.col(classes[0]))
    return wide.withColumn("TOTAL", total)
