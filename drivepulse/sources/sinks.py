"""Writing indexes, splits, reports and chunk tables; artifact fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_index(index: DataFrame, path: str) -> DataFrame:
    """Parquet by sensor, read back and compared with what was written."""
    index.write.mode("overwrite").partitionBy("sensor").parquet(path)
    back = index.sparkSession.read.schema(index.schema).parquet(path)
    if back.count() != index.count():
        raise OSError(f"index at {path} did not survive the round trip")
    return back


def write_splits(splits: DataFrame, path: str) -> None:
    """One JSON document per sensor."""
    splits.write.mode("overwrite").partitionBy("sensor").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").option("header", True).csv(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk table partitioned by sensor and clustered by recording for later pruning.

    A very long recording is cut into blocks of chunks, so no task writes it whole.
    """
    if not chunks.take(1):
        raise ValueError("no chunks to write")
    block = F.floor(F.col("chunk_id") / 1000)
    chunks.repartition("sensor", "group_key", block).sortWithinPartitions("group_key", "chunk_id").write.mode(
        "overwrite"
    ).partitionBy("sensor").parquet(path)


def fingerprint(df: DataFrame, keys: Sequence[str], member: Column) -> DataFrame:
    """Digest over the members of each key, independent of row order.

    Each member gives four 60-bit words of its SHA-256; their sums and the number of members are
    added map-side and hashed once, so no list of members is ever built.
    """
    digest = F.sha2(member.cast("string"), 256)
    rows = df.select(*keys, digest.alias("_h"))
    words = [F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *[F.sum(w).alias(f"_w{i}") for i, w in enumerate(words)])
    parts = F.concat_ws(",", F.col("members").cast("string"), *[F.col(f"_w{i}").cast("string") for i in range(4)])
    return sums.select(*keys, "members", F.sha2(parts, 256).alias("sha256"))
