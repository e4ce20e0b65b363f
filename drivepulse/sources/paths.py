"""Indexes built from file listings: recordings, packs and spectrograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES, RECORDING_SUFFIX, SENSORS, VEHICLES
from drivepulse.functions.scalars import let
from drivepulse.session import materialise


def plain_path(path: Column) -> Column:
    """One spelling for a path: listings and file metadata differ in escapes and slashes."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "/")


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """All files below ``root`` as ``path``; file contents are never read.

    A missing root fails when Spark resolves the path.
    """
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", pattern)
        .load(root)
        .select("path")
    )


def _at(parts: Column, from_end: int) -> Column:
    return F.try_element_at(parts, F.lit(-from_end))


def _known(parts: Column, from_end: int, names: Sequence[str]) -> Column:
    return F.coalesce(_at(parts, from_end).isin(*names), F.lit(False))


def part(path: Column, from_end: int) -> Column:
    """Path element counted from the end: 1 is the file name."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def group_key(file_name: Column, sensor: Column) -> Column:
    """File name without the exact ``_{sensor}_timeseries.csv`` ending, else null."""
    ending = F.concat(F.lit("_"), sensor, F.lit(RECORDING_SUFFIX))
    stem = F.substring(file_name, F.lit(1), F.length(file_name) - F.length(ending))
    return F.when(F.endswith(file_name, ending), stem)


def recording_index(
    listing: DataFrame,
    *,
    vehicles: Sequence[str] = VEHICLES,
    sensors: Sequence[str] = SENSORS,
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """Index rows of ``{vehicle}/{fault}/{date}/{sensor}/{file}``; other names drop out."""
    record = let(
        F.split("path", "/"),
        lambda parts: F.when(
            _known(parts, 5, vehicles) & _known(parts, 4, classes) & _known(parts, 2, sensors),
            F.struct(
                _at(parts, 5).alias("vehicle"),
                _at(parts, 4).alias("fault_class"),
                _at(parts, 3).alias("date"),
                _at(parts, 2).alias("sensor"),
                group_key(_at(parts, 1), _at(parts, 2)).alias("group_key"),
            ),
        ),
    )
    # The generator keeps the filter above it, so each path is taken apart once.
    parsed = listing.select(F.col("path").alias("csv_path"), F.explode_outer(F.array(record)).alias("r"))
    return parsed.filter(F.col("r.group_key").isNotNull()).select("csv_path", "r.*")


def coverage_gaps(
    listing: DataFrame,
    *,
    vehicles: Sequence[str] = VEHICLES,
    sensors: Sequence[str] = SENSORS,
    classes: Sequence[str] = CLASSES,
) -> DataFrame:
    """Expected places without recordings: class folders, then sensor leaves of known dates.

    The expectation grows only with the distinct date folders, not with the files.
    """
    spark = listing.sparkSession
    record = let(
        F.split("path", "/"),
        lambda parts: F.struct(
            _at(parts, 5).alias("vehicle"),
            _at(parts, 4).alias("fault_class"),
            _at(parts, 3).alias("date"),
            _at(parts, 2).alias("sensor"),
            group_key(_at(parts, 1), _at(parts, 2)).isNotNull().alias("_ok"),
        ),
    )
    seen = listing.select(F.explode_outer(F.array(record)).alias("r")).select("r.*")
    # One flag per sensor and date folder: null without a leaf, false for a leaf without recordings.
    flags = [F.max(F.when(F.col("sensor") == name, F.col("_ok"))).alias(f"_s{i}") for i, name in enumerate(sensors)]
    folders = seen.groupBy("vehicle", "fault_class", "date").agg(F.lit(True).alias("_seen"), *flags)
    domain = [(v, c) for v in vehicles for c in classes]
    expected = spark.createDataFrame(domain, "vehicle string, fault_class string")

    def problem(sensor: str | None, text: Column) -> Column:
        return F.struct(F.lit(sensor).cast("string").alias("sensor"), text.alias("problem"))

    def leaf(i: int, name: str) -> Column:
        flag = F.col(f"_s{i}")
        text = F.when(flag.isNull(), "sensor leaf missing").otherwise("sensor leaf empty")
        return F.when(flag.isNull() | ~flag, problem(name, text))

    leaves = F.filter(F.array(*[leaf(i, name) for i, name in enumerate(sensors)]), lambda p: p.isNotNull())
    found = F.when(F.col("_seen").isNull(), F.array(problem(None, F.lit("class folder missing")))).otherwise(leaves)
    joined = expected.join(folders, ["vehicle", "fault_class"], "left")
    return joined.select("vehicle", "fault_class", "date", F.explode(found).alias("p")).select(
        "vehicle", "fault_class", "date", "p.sensor", "p.problem"
    )


def index_overview(index: DataFrame) -> DataFrame:
    return index.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("group_key").alias("n_groups"),
        # A closed set of a few dozen combinations: kept in the aggregate itself.
        F.size(F.collect_set(F.concat_ws("/", "vehicle", "sensor", "fault_class"))).cast("long").alias("n_combinations"),
    )


def index_pivot(index: DataFrame, by: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Recordings per ``by`` and class, zero-filled."""
    return index.groupBy(by).pivot("fault_class", list(classes)).count().fillna(0)


def pack_index(listing: DataFrame) -> DataFrame:
    """Pair voltage matrices with labels.

    ``…/{type}/NPY/{vehicle}/{status}/…/name.npy`` belongs to the JSON at the same
    relative stem below ``{type}/JSON``; failing that, to the first JSON of that
    folder; failing both, the matrix drops out.
    """
    pattern = r"([^/]+)/(NPY|JSON)/(([^/]+)/([^/]+)/(?:.*/)?)([^/]+)\.(npy|json)$"
    names = {1: "pack_type", 3: "folder", 4: "vehicle", 5: "status", 6: "stem", 7: "kind"}
    record = let(
        F.col("path"),
        lambda p: F.when(
            p.rlike(pattern), F.struct(*[F.regexp_extract(p, pattern, i).alias(n) for i, n in names.items()])
        ),
    )
    files = listing.select("path", F.explode_outer(F.array(record)).alias("r"))
    files = files.filter(F.col("r").isNotNull()).select("path", "r.*")
    data = files.filter(F.col("kind") == "npy").drop("kind").withColumnRenamed("path", "matrix_path")
    labels = files.filter(F.col("kind") == "json")
    exact = labels.groupBy("pack_type", "folder", "stem").agg(F.min("path").alias("_exact"))
    spare = exact.groupBy("pack_type", "folder").agg(F.min("_exact").alias("_spare"))
    return (
        data.join(exact, ["pack_type", "folder", "stem"], "left")
        .join(spare, ["pack_type", "folder"], "left")
        .withColumn("label_path", F.coalesce("_exact", "_spare"))
        .filter(F.col("label_path").isNotNull())
        .select("matrix_path", "label_path", "pack_type", "vehicle", "status")
    )


def spectrogram_index(listing: DataFrame, *, sensors: Sequence[str] = SENSORS) -> DataFrame:
    """One row per spectrogram of the leading channel with the paths of all channels.

    Files are ``{vehicle}/{fault}/{date}/{channel}/{name}.png|json`` under a data
    and a label root. The leading channel is the first of ``sensors`` when that
    folder exists, otherwise the first folder by name. A channel path is the file
    with the channel renamed, else the first image of the channel folder. Labels
    follow the same exact-then-folder rule.
    """
    record = let(
        F.split("path", "/"),
        lambda parts: F.struct(
            F.concat_ws("/", _at(parts, 5), _at(parts, 4), _at(parts, 3)).alias("day"),
            _at(parts, 5).alias("vehicle"),
            _at(parts, 4).alias("fault_class"),
            _at(parts, 2).alias("channel"),
            F.regexp_extract(_at(parts, 1), r"^(.*)\.(png|json)$", 1).alias("stem"),
            F.regexp_extract(_at(parts, 1), r"\.(png|json)$", 1).alias("kind"),
        ),
    )
    files = listing.select("path", F.explode_outer(F.array(record)).alias("r")).select("path", "r.*")
    # Listed and taken apart once; folders, names and labels below are read from it.
    files = materialise(files, "files")
    images = files.filter(F.col("kind") == "png")
    by_folder = images.groupBy("day", "channel").agg(F.min("path").alias("_spare"))
    lead = by_folder.groupBy("day").agg(
        F.coalesce(F.max(F.when(F.col("channel") == sensors[0], F.col("channel"))), F.min("channel")).alias("lead")
    )
    leading = images.join(lead, "day").filter(F.col("channel") == F.col("lead"))
    by_name = images.groupBy("day", "channel", "stem").agg(F.min("path").alias("_exact"))
    # One row per image and channel: a fixed fan-out of the channel count.
    asked = leading.select(
        "path", "day", "vehicle", "fault_class", "lead", F.col("stem").alias("lead_stem"),
        F.explode(F.array(*[F.lit(s) for s in sensors])).alias("channel"),
    ).withColumn("stem", F.replace(F.col("lead_stem"), F.col("lead"), F.col("channel")))
    found = (
        asked.join(by_name, ["day", "channel", "stem"], "left")
        .join(by_folder, ["day", "channel"], "left")
        .withColumn("_file", F.coalesce("_exact", "_spare"))
    )
    gathered = found.groupBy("path", "day", "vehicle", "fault_class", "lead", "lead_stem").agg(
        F.array_sort(
            F.collect_list(F.when(F.col("_file").isNotNull(), F.struct("channel", F.col("_file").alias("file"))))
        ).alias("_pairs")
    )
    own = F.array(F.struct(F.col("lead").alias("channel"), F.col("path").alias("file")))
    channels = F.map_from_entries(F.when(F.size("_pairs") > 0, F.col("_pairs")).otherwise(own))
    labels = files.filter(F.col("kind") == "json")
    exact = labels.groupBy("day", F.col("channel").alias("lead"), F.col("stem").alias("lead_stem")).agg(
        F.min("path").alias("_label")
    )
    spare = exact.groupBy("day", "lead").agg(F.min("_label").alias("_any"))
    return (
        gathered.withColumn("channels", channels)
        .join(exact, ["day", "lead", "lead_stem"], "left")
        .join(spare, ["day", "lead"], "left")
        .withColumn("label_path", F.coalesce("_label", "_any"))
        .filter(F.col("label_path").isNotNull())
        .select("path", "vehicle", "fault_class", "channels", "label_path")
    )


def index_stats(index: DataFrame, status: str) -> DataFrame:
    """Total and the sorted distinct ``vehicle/status`` keys, comma separated."""
    key = F.concat_ws("/", "vehicle", status)
    return index.agg(
        F.count(F.lit(1)).alias("total"), F.array_join(F.sort_array(F.collect_set(key)), ",").alias("keys")
    )


def relative_resource(channels: Column, root: str, prefix: str, primary: str = SENSORS[0]) -> Column:
    """Path of the primary channel (else any channel) below ``root``, under ``prefix``."""
    file = F.coalesce(F.try_element_at(channels, F.lit(primary)), F.get(F.map_values(channels), F.lit(0)))
    inside = root.rstrip("/") + "/"
    return F.when(F.startswith(file, F.lit(inside)), F.concat(F.lit(prefix), F.substr(file, F.lit(len(inside) + 1))))
