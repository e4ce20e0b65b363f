"""Session defaults and shared scratch locations."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "drivepulse", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, adaptive execution and Arrow exchange switched on."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


# Bytes of rows that an executor gathers into one Arrow batch for its Python worker.
BATCH_BYTES = 6 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, as rows may hold texts and arrays of any length; a session's own bound stays.

    A batch is held several times over: while its buffers grow, as it is sent and by the Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def short_reads(spark: SparkSession, rows: int) -> Iterator[None]:
    """Parquet is decoded by ``rows`` at once, for jobs inside that read rows of many kilobytes; a session's own number stays.

    The default of 4,096 rows would be decoded to memory that no cache of a core holds.
    """
    key = "spark.sql.parquet.columnarReaderBatchSize"
    own = spark.conf.get(key, None) is not None
    if not own:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(key)


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share.

    Without that setting only a session on one machine (``local[…]``) gets a folder of its own; on a
    cluster the executors would not see each other's files, so it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _own_dir()
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


@cache
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="drivepulse-")


def materialise(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
