"""Matrix, label and image files decoded inside Spark tasks."""

from __future__ import annotations

from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATRIX = T.ArrayType(T.ArrayType(T.DoubleType()))
LABEL_SCHEMA = T.StructType(
    [
        T.StructField("metadata", T.StructType([T.StructField("temperature", T.DoubleType())])),
        T.StructField(
            "image", T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())])
        ),
        T.StructField(
            "annotations",
            T.StructType([T.StructField("polygons", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))))]),
        ),
    ]
)


def _decode(blob) -> list | None:
    try:
        matrix = np.load(BytesIO(blob), allow_pickle=False)
    except Exception:  # an unreadable file is data, not a failure of the job
        return None
    return matrix.astype("float64").tolist() if matrix.ndim == 2 else None


def scan_matrices(spark: SparkSession, root: str) -> DataFrame:
    """``path, m`` for every ``.npy`` below root; null where it is unreadable or not 2-D."""

    @F.pandas_udf(MATRIX)
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(_decode)

    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(root)
    )
    return files.select("path", decode("content").alias("m"))


def scan_labels(spark: SparkSession, root: str) -> DataFrame:
    """Label files with a fixed schema; a broken file gives nulls."""
    return (
        spark.read.schema(LABEL_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .json(root)
        .select(F.col("_metadata.file_path").alias("path"), "metadata", "image", "annotations")
    )


def scan_spectrograms(spark: SparkSession, root: str) -> DataFrame:
    """Decoded images: ``path, height, width, channels, data``."""
    return (
        spark.read.format("image")
        .option("dropInvalid", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.png")
        .load(root)
        .select(
            F.col("image.origin").alias("path"),
            F.col("image.height").alias("height"),
            F.col("image.width").alias("width"),
            F.col("image.nChannels").alias("channels"),
            F.col("image.data").alias("data"),
        )
    )


def pixels(images: DataFrame) -> DataFrame:
    """Long pixels ``path, row, col, r, g, b`` from the decoder's blue-green-red bytes."""
    n = F.col("height") * F.col("width")
    at = F.col("i") * F.col("channels")

    def byte(offset: int):
        return F.conv(F.hex(F.substring("data", at + 1 + offset, F.lit(1))), 16, 10).cast("int")

    grey = F.col("channels") == 1
    spread = images.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    return spread.select(
        "path",
        F.floor(F.col("i") / F.col("width")).cast("int").alias("row"),
        (F.col("i") % F.col("width")).cast("int").alias("col"),
        F.when(grey, byte(0)).otherwise(byte(2)).alias("r"),
        F.when(grey, byte(0)).otherwise(byte(1)).alias("g"),
        byte(0).alias("b"),
    )
