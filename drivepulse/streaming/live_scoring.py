"""Arriving chunks scored by the newest stored models, which may change while the stream runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.operators import fold_training, models
from drivepulse.streaming import streams


def publish(state: DataFrame, root: str, version: int) -> None:
    """Store the models of ``fold_training.state_table`` (``model`` names the slot) as a version; written whole, then marked."""
    spark = state.sparkSession
    state.write.mode("overwrite").parquet(f"{root}/models/version={version}")
    spark.range(1).select(F.lit(version).alias("version")).write.mode("append").parquet(f"{root}/published")


def newest(spark: SparkSession, root: str) -> int:
    return spark.read.schema("version int").parquet(f"{root}/published").agg(F.max("version")).first()[0]


def verdicts(chunks: DataFrame, root: str, version: int, *, keys: Sequence[str], slot: str = "sensor", array: str = "x") -> DataFrame:
    """Batch form: label, shares and anomaly score of every chunk by the models of one version."""
    state = fold_training.load_state(chunks.sparkSession.read.parquet(f"{root}/models/version={version}"))
    scored = fold_training.score_chunks(chunks, state, keys=keys, slot=slot, array=array)
    return models.verdicts(scored.filter("probs IS NOT NULL"), slot=slot).withColumn("model_version", F.lit(version))


def score_live(
    chunks: DataFrame, purpose: str, root: str, *, keys: Sequence[str], slot: str = "sensor", array: str = "x", location: str | None = None
) -> DataFrame:
    """Score a stream of chunks; each batch takes the version that is newest when it starts.

    A batch that is repeated after a loss replaces its own folder. Chunks of slots without a model are
    kept beside the scores, in ``unscored``, and counted nowhere else.
    """
    spark = chunks.sparkSession

    def handle(batch: DataFrame, number: int, base: str) -> None:
        version = newest(batch.sparkSession, root)
        known = [r["model"] for r in batch.sparkSession.read.parquet(f"{root}/models/version={version}").select("model").collect()]
        verdicts(batch, root, version, keys=keys, slot=slot, array=array).write.mode("overwrite").parquet(f"{base}/data/batch={number}")
        left = batch.filter(F.col(slot).isNull() | ~F.col(slot).isin(known)).select(*keys, slot)
        left.write.mode("overwrite").parquet(f"{base}/unscored/batch={number}")

    base = streams.each_batch(chunks, purpose, handle, mode="append", location=location)
    return spark.read.parquet(f"{base}/data").drop("batch")
