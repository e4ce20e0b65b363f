"""Spectrogram features. A spectrogram is one row holding ``array<array<double>>``
indexed [frequency][time]; every feature is a projection, so nothing is shuffled."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from drivepulse.functions import matrices as mx
from drivepulse.functions.scalars import let

EPS = 1e-12
# Constants of the feature definitions.
MAD_SCALE, MAD_FLOOR = 1.4826, 1e-6
BANDS, ROLLOFF_SHARE, THRESHOLD_QUANTILE = 8, 0.85, 0.9
BASIC = ("peak_freq_bin", "band_start", "band_end", "rms")
SHAPE = tuple(f"band_{j}" for j in range(BANDS)) + ("centroid", "entropy", "rolloff", "log_flatness")

VOXELS_PER_AXIS, VOXEL_STEP = 64, 4
FLUSH_ROWS = 10_000  # feature rows a task hands over at a time


def stft(signals: DataFrame, *, keys: Sequence[str], array: str = "x", window: int = 128, hop: int = 24, rows: int = 48) -> DataFrame:
    """Hann-window magnitude spectrogram of each array, divided by its maximum.

    Adds ``e`` as [frequency][time] with the first ``rows`` bins; signals shorter
    than the window give an empty matrix.
    """
    schema = signals.select(*keys, F.array(F.array(F.lit(0.0))).alias("e")).schema

    def transform(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hann = np.hanning(window)
        for batch in batches:
            maps = []
            for x in batch[array]:
                x = np.asarray(x, dtype="float64")
                if len(x) < window:
                    maps.append([])
                    continue
                frames = np.lib.stride_tricks.sliding_window_view(x, window)[::hop]
                mag = np.abs(np.fft.rfft(frames * hann, axis=1))[:, :rows].T
                top = mag.max()
                maps.append((mag / top if top > 0 else mag).tolist())
            out = batch[list(keys)].copy()
            out["e"] = maps
            yield out

    return signals.select(*keys, array).mapInPandas(transform, schema)


def jet(value: Column) -> list[Column]:
    """Forward colour map: red, green and blue bytes of a value in [0, 1]."""
    def channel(offset: float) -> Column:
        v = F.lit(1.5) - F.abs(value * 4.0 - offset)
        return F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0)) * 255.0).cast("int")

    return [channel(o) for o in (3.0, 2.0, 1.0)]


@cache
def _nearest_colours() -> np.ndarray:
    """Index of the nearest of the 256 map colours for each voxel of the colour cube.

    Distances are integers between voxel centres and colours; ties go to the lower
    index. Built once per worker from the rule of the map.
    """
    side = VOXELS_PER_AXIS
    v = np.arange(256) / 255.0
    offsets = np.array([3.0, 2.0, 1.0])[:, None]
    colours = np.floor(np.clip(1.5 - np.abs(4.0 * v - offsets), 0, 1) * 255.0).astype("int32")
    centres = np.arange(side, dtype="int32") * VOXEL_STEP + VOXEL_STEP // 2
    gap = (centres[None, :, None] - colours[:, None, :]) ** 2  # channel, voxel, colour
    plane = gap[1][:, None, :] + gap[2][None, :, :]
    return np.stack([(plane + gap[0][i]).argmin(axis=2) for i in range(side)]).reshape(-1).astype("int32")


def colour_table(spark) -> DataFrame:
    """Voxel number and nearest colour: exactly 64³ rows, so it may always be broadcast."""

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"voxel": batch["id"], "colour": _nearest_colours()[batch["id"].to_numpy()]})

    return spark.range(VOXELS_PER_AXIS**3).mapInPandas(nearest, "voxel long, colour int")


def maps_from_images(images: DataFrame, *, keys: Sequence[str] = ("path",)) -> DataFrame:
    """Spectrogram matrix of each decoded image, without unfolding it into pixels.

    Every image is inverted where it was read; image row 0 is the highest frequency.
    """
    keys = list(keys)
    schema = images.select(*keys, F.array(F.array(F.lit(0.0))).alias("e")).schema

    def invert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = VOXELS_PER_AXIS
        for batch in batches:
            for i in range(len(batch)):
                row = batch.iloc[i : i + 1]
                shape = (int(row["height"].iat[0]), int(row["width"].iat[0]), int(row["channels"].iat[0]))
                bgr = np.frombuffer(row["data"].iat[0], dtype="uint8").reshape(shape).astype("int32") // VOXEL_STEP
                red, green, blue = (bgr[..., min(c, shape[2] - 1)] if shape[2] > 1 else bgr[..., 0] for c in (2, 1, 0))
                e = _nearest_colours()[(red * side + green) * side + blue][::-1] / 255.0
                out = row[keys].copy()
                out["e"] = [e.tolist()]
                yield out

    return images.select(*keys, "height", "width", "channels", "data").mapInPandas(invert, schema)


def recover_scalar(pixels: DataFrame, *, red: str = "r", green: str = "g", blue: str = "b", out: str = "e") -> DataFrame:
    """Approximate inverse of the colour map by voxel lookup."""
    side = VOXELS_PER_AXIS
    r, g, b = (F.floor(F.col(c) / VOXEL_STEP) for c in (red, green, blue))
    table = F.broadcast(colour_table(pixels.sparkSession))
    return (
        pixels.withColumn("voxel", (r * side + g) * side + b)
        .join(table, "voxel")
        .withColumn(out, F.col("colour") / 255.0)
        .drop("voxel", "colour")
    )


def assemble_map(pixels: DataFrame, keys: Sequence[str], *, row: str = "row", col: str = "col", value: str = "e") -> DataFrame:
    """Long pixels of an image to its matrix; image row 0 is the highest frequency."""
    rows = pixels.groupBy(*keys, row).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(col, value))), lambda s: s[value]).alias("_line")
    )
    return rows.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct(row, "_line")), asc=False), lambda s: s["_line"]
        ).alias("e")
    )


def _row_z(row: Column) -> Column:
    """Distance from the row's median in scaled median absolute deviations."""
    def scaled(centred: Column) -> Column:
        mad = mx.quantile(F.transform(centred, F.abs), 0.5)
        return let(F.lit(MAD_SCALE) * (mad + F.lit(MAD_FLOOR)), lambda s: F.transform(centred, lambda d: d / s))

    return let(mx.quantile(row, 0.5), lambda m: let(F.transform(row, lambda v: v - m), scaled))


def remove_baseline(maps: DataFrame, *, matrix: str = "e", out: str = "z") -> DataFrame:
    """Robust z values per frequency row: median and scaled MAD over time."""
    return maps.withColumn(out, F.transform(matrix, _row_z))


def _located(cols: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Peak, band limits and rms from one column per row (``e``, ``z``, ``_limit``)."""
    z = F.col("z")
    above = F.filter(F.transform(z, lambda v, i: F.when(v > F.col("_limit"), i)), lambda i: i.isNotNull())
    return cols.withColumn("_above", above).select(
        *keep,
        (F.array_position(z, F.array_max(z)).cast("int") - 1).alias("peak_freq_bin"),
        F.array_min("_above").alias("band_start"),
        F.array_max("_above").alias("band_end"),
        F.sqrt(mx.total(F.transform("e", lambda v: v * v)) / F.size("e")).alias("rms"),
    )


def _with_limit(maps: DataFrame, matrix: str) -> DataFrame:
    return remove_baseline(maps, matrix=matrix).withColumn("_limit", mx.quantile(F.flatten("z"), THRESHOLD_QUANTILE))


def basic_features(maps: DataFrame, *, keys: Sequence[str], matrix: str = "e") -> DataFrame:
    """Peak bin, band start/end and rms per time column, one row per (key, t)."""
    both = F.arrays_zip(mx.transpose(F.col(matrix)).alias("e"), mx.transpose(F.col("z")).alias("z"))
    cols = mx.spread(_with_limit(maps, matrix), [*keys, "_limit"], both, "t", "c")
    return _located(cols.select(*keys, "t", "_limit", "c.e", "c.z"), [*keys, "t"])


def _shape(column: Column) -> Column:
    """Struct of the twelve distribution features of one spectrum.

    Null bins (outside a resampled axis) count as absent.
    """
    height = F.size(column)
    known = F.filter(column, lambda v: v.isNotNull())

    def band(p: Column, j: int) -> Column:
        kept = F.filter(p, lambda v, i: F.floor(i * BANDS / height) == j)
        return mx.total(kept).alias(f"band_{j}")

    def walk(acc, s):
        run = acc["run"] + s["p"]
        return F.struct(run.alias("run"), F.coalesce(acc["bin"], F.when(run >= ROLLOFF_SHARE, s["i"])).alias("bin"))

    def rolloff(p: Column) -> Column:
        start = F.struct(F.lit(0.0).alias("run"), F.lit(None).cast("int").alias("bin"))
        pairs = F.transform(p, lambda v, i: F.struct(v.alias("p"), i.alias("i")))
        return F.aggregate(pairs, start, walk, lambda acc: acc["bin"])

    def flatness(k: Column) -> Column:
        logs = mx.total(F.transform(k, lambda v: F.ln(v + EPS))) / F.size(k)
        return F.when(F.size(k) > 0, logs - F.ln(mx.total(k) / F.size(k) + F.lit(EPS)))

    def described(k: Column, p: Column) -> Column:
        return F.struct(
            *[band(p, j) for j in range(BANDS)],
            mx.total(F.transform(p, lambda v, i: v * i)).alias("centroid"),
            (-mx.total(F.transform(p, lambda v: v * F.ln(v + EPS)))).alias("entropy"),
            rolloff(p).alias("rolloff"),
            flatness(k).alias("log_flatness"),
        )

    def shares(s: Column) -> Column:
        return F.transform(column, lambda v: F.coalesce(v, F.lit(0.0)) / s)

    return let(
        known, lambda k: let(let(mx.total(k) + F.lit(EPS), shares), lambda p: described(k, p))
    )


def shape_of_column(cols: DataFrame, *, keys: Sequence[str], column: str = "col", prefix: str = "") -> DataFrame:
    """Eight band shares, centroid, entropy, rolloff and log flatness of one spectrum per row."""
    staged = cols.withColumn("_shape", _shape(F.col(column)))
    return staged.select(*keys, *[F.col(f"_shape.{s}").alias(f"{prefix}{s}") for s in SHAPE])


def time_columns(maps: DataFrame, *, keys: Sequence[str], matrix: str = "e") -> DataFrame:
    return mx.spread(maps, keys, mx.transpose(F.col(matrix)), "t", "col")


def shape_features(maps: DataFrame, *, keys: Sequence[str], matrix: str = "e", prefix: str = "") -> DataFrame:
    """The twelve distribution features per (key, t)."""
    return shape_of_column(time_columns(maps, keys=keys, matrix=matrix), keys=[*keys, "t"], prefix=prefix)


def order_axis(maps: DataFrame, *, rpm: Column, reference_rpm: float, matrix: str = "e", out: str = "e_order") -> DataFrame:
    """Resample the frequency axis by speed: bin k reads ``k · rpm / reference``.

    Linear between neighbours; positions beyond the last bin are null. The
    reference speed has no default because published values disagree.
    """
    def sample(column: Column) -> Column:
        ratio = rpm / F.lit(float(reference_rpm))
        last = F.size(column) - 1

        def at(k: Column) -> Column:
            u = k * ratio
            low = F.floor(u).cast("int")
            left = F.get(column, low)
            right = F.coalesce(F.get(column, low + 1), left)
            return F.when(u <= last, left + (right - left) * (u - low))

        return F.transform(F.sequence(F.lit(0), last), at)

    return maps.withColumn(out, mx.transpose(F.transform(mx.transpose(F.col(matrix)), sample)))


def sensor_features(maps: DataFrame, *, keys: Sequence[str], rpm: str = "rpm", reference_rpm: float, matrix: str = "e") -> DataFrame:
    """All 29 features per (key, t): basic, rpm, twelve absolute and twelve order features."""
    resampled = order_axis(maps, rpm=F.col(rpm), reference_rpm=reference_rpm, matrix=matrix)
    zipped = F.arrays_zip(
        mx.transpose(F.col(matrix)).alias("e"), mx.transpose(F.col("z")).alias("z"),
        mx.transpose(F.col("e_order")).alias("o"),
    )
    limited = _with_limit(resampled, matrix).withColumn("rpm", F.col(rpm))
    cols = mx.spread(limited, [*keys, "rpm", "_limit"], zipped, "t", "c").select(
        *keys, "t", "rpm", "_limit", "c.e", "c.z", "c.o"
    )
    cols = _located(cols, [*keys, "t", "rpm", "e", "o"])
    carried = [*keys, "t", "rpm", *BASIC]
    absolute = shape_of_column(cols, keys=[*carried, "o"], column="e", prefix="abs_")
    done = [*carried, *[f"abs_{s}" for s in SHAPE]]
    return shape_of_column(absolute, keys=done, column="o", prefix="ord_")


def _shape_arrays(e: np.ndarray) -> dict[str, np.ndarray]:
    """The twelve distribution features of every column of (frequency, time); NaN bins are absent."""
    height = len(e)
    known = ~np.isnan(e)
    filled = np.where(known, e, 0.0)
    p = filled / (filled.sum(axis=0) + EPS)
    band = np.arange(height) * BANDS // height
    out = {f"band_{j}": p[band == j].sum(axis=0) for j in range(BANDS)}
    out["centroid"] = (np.arange(height)[:, None] * p).sum(axis=0)
    out["entropy"] = -(p * np.log(p + EPS)).sum(axis=0)
    reached = np.cumsum(p, axis=0) >= ROLLOFF_SHARE
    out["rolloff"] = np.where(reached.any(axis=0), reached.argmax(axis=0), np.nan)
    n = known.sum(axis=0)
    logs = np.where(known, np.log(filled + EPS), 0.0).sum(axis=0) / n
    out["log_flatness"] = logs - np.log(filled.sum(axis=0) / n + EPS)
    return out


def _feature_rows(e: np.ndarray, rpm: float, reference_rpm: float) -> dict[str, np.ndarray]:
    height, steps = e.shape
    centred = e - np.median(e, axis=1, keepdims=True)
    z = centred / (MAD_SCALE * (np.median(np.abs(centred), axis=1, keepdims=True) + MAD_FLOOR))
    above = z > np.quantile(z, THRESHOLD_QUANTILE)
    found = above.any(axis=0)
    start = np.where(found, above.argmax(axis=0), np.nan)
    end = np.where(found, height - 1 - above[::-1].argmax(axis=0), np.nan)
    rows = {
        "t": np.arange(steps, dtype="int32"), "rpm": np.full(steps, rpm), "peak_freq_bin": z.argmax(axis=0),
        "band_start": start, "band_end": end, "rms": np.sqrt((e * e).mean(axis=0)),
    }
    u = np.arange(height) * (rpm / reference_rpm)
    low = np.minimum(np.floor(u).astype(int), height - 1)
    left, right = e[low], e[np.minimum(low + 1, height - 1)]
    order = left + (right - left) * (u - low)[:, None]
    order[u > height - 1] = np.nan
    for prefix, m in (("abs_", e), ("ord_", order)):
        rows |= {f"{prefix}{k}": v for k, v in _shape_arrays(m).items()}
    return rows


def sensor_features_batched(
    maps: DataFrame, *, keys: Sequence[str], rpm: str = "rpm", reference_rpm: float, matrix: str = "e"
) -> DataFrame:
    """The rows of :func:`sensor_features` for image-sized maps.

    A map of 2.5 million cells is one numpy array here instead of as many boxed
    values; maps still never leave their task.
    """
    keys = list(keys)
    whole = {"t", "peak_freq_bin", "band_start", "band_end", "abs_rolloff", "ord_rolloff"}
    names = ["t", "rpm", *BASIC, *[f"{p}{s}" for p in ("abs_", "ord_") for s in SHAPE]]
    schema = maps.select(
        *keys, *[F.lit(None).cast("int" if n in whole else "double").alias(n) for n in names]
    ).schema

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush() -> pd.DataFrame:
            joined = {n: np.concatenate([r[n] for r in held]) for n in names}
            spread = np.repeat(np.arange(len(held)), [len(r["t"]) for r in held])
            out = pd.concat(owners, ignore_index=True).iloc[spread].reset_index(drop=True)
            out = out.assign(**joined)
            return out.astype({n: "Int32" for n in whole})[[*keys, *names]]

        for batch in batches:
            held, owners, size = [], [], 0
            for i in range(len(batch)):
                e = np.stack([np.asarray(r, dtype="float64") for r in batch[matrix].iat[i]])
                held.append(_feature_rows(e, float(batch["_rpm"].iat[i]), float(reference_rpm)))
                owners.append(batch[keys].iloc[i : i + 1])
                size += e.shape[1]
                if size >= FLUSH_ROWS:
                    yield flush()
                    held, owners, size = [], [], 0
            if held:
                yield flush()

    return maps.select(*keys, F.col(rpm).alias("_rpm"), matrix).mapInPandas(features, schema)


def feature_set(name: str, *, left_out: str = "log_flatness", temperature: str = "temperature") -> list[str]:
    """Column list per sensor of an ablation configuration (named by its fused width).

    Configurations with eleven shape features drop ``left_out``; which one was
    dropped is not published, hence the parameter.
    """
    def shape(prefix: str, full: bool) -> list[str]:
        return [f"{prefix}{s}" for s in SHAPE if full or s != left_out]

    basic, rpm = list(BASIC), ["rpm"]
    sets = {
        "12": basic,
        "15": basic + rpm,
        "18": basic + rpm + [temperature],
        "48": basic + rpm + shape("abs_", False),
        "51": basic + rpm + shape("abs_", True),
        "51_order": basic + rpm + shape("ord_", True),
        "81": basic + rpm + shape("abs_", False) + shape("ord_", False),
        "87": basic + rpm + shape("abs_", True) + shape("ord_", True),
    }
    return sets[name]


def channel_panel(features: DataFrame, *, keys: Sequence[str], columns: Sequence[str], out: str = "channels") -> DataFrame:
    """Feature rows of one recording to a channel-major panel in time order."""
    ordered = F.array_sort(F.collect_list(F.struct("t", F.array(*[F.col(c).cast("float") for c in columns]).alias("v"))))
    numbers = F.sequence(F.lit(0), F.lit(len(columns) - 1))
    channels = let(ordered, lambda o: F.transform(numbers, lambda i: F.transform(o, lambda s: F.get(s["v"], i))))
    return features.groupBy(*keys).agg(channels.alias(out))


def condition_statistics(rows: DataFrame, *, chunk: Sequence[str], reference: str, actual: str, extra: Sequence[str] = (), pos: str = "pos", bin_by: str | None = None, bin_width: float = 25.0) -> DataFrame:
    """Per chunk: mean, spread and trend of the torque deviation and of further signals."""
    staged = rows.withColumn("_dev", F.col(reference) - F.col(actual))
    aggs = []
    for c, n in [("_dev", "deviation"), *[(e, e) for e in extra]]:
        aggs += [
            F.avg(c).alias(f"{n}_mean"), F.stddev_pop(c).alias(f"{n}_std"), F.regr_slope(c, F.col(pos)).alias(f"{n}_trend")
        ]
    if bin_by is not None:
        aggs.append(F.floor(F.avg(bin_by) / bin_width).alias("condition"))
    return staged.groupBy(*chunk).agg(*aggs)
