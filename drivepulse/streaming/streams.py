"""Structured Streaming forms of chunk assembly, scoring, alerts and rings."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from drivepulse.functions.domains import SENSORS
from drivepulse.functions.scalars import half_up
from drivepulse.operators import alerts, health, models
from drivepulse.session import shared_dir

# Buckets of keys that a ring is kept in.
RING_BUCKETS = 64
# States that open chunks are dealt to.
CHUNK_SHARDS = 256


def file_stream(spark: SparkSession, path: str, schema, *, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format("parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def table_stream(spark: SparkSession, path: str, **kw) -> DataFrame:
    """Stream the files of a parquet table with the table's own schema.

    The exact-match pattern lets a table be one file as well as a folder of files.
    """
    schema = spark.read.parquet(path).schema
    return file_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, **kw)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone; the zone is the session's."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def append_to(stream: DataFrame, purpose: str, *, trigger: dict | None = None, location: str | None = None) -> DataFrame:
    """Run an append stream into a parquet sink and read the result back.

    Without a trigger everything available now is processed; a live job passes
    e.g. ``{"processingTime": "2 seconds"}`` and handles the query itself. A job that
    must resume names its ``location``: a later call goes on where the last one stopped.
    """
    spark = stream.sparkSession
    base = location or shared_dir(spark, purpose)
    query = (
        stream.writeStream.outputMode("append").format("parquet")
        .option("checkpointLocation", f"{base}/checkpoint").option("path", f"{base}/data")
        .trigger(**(trigger or {"availableNow": True})).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def each_batch(
    stream: DataFrame, purpose: str, handle: Callable[[DataFrame, int, str], None], *, mode: str = "update", location: str | None = None
) -> str:
    """Drive ``handle(batch, number, folder)`` over everything available; returns the folder (``location``, to resume)."""
    base = location or shared_dir(stream.sparkSession, purpose)
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(lambda df, number: handle(df, number, base))
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return base


def upsert(stream: DataFrame, purpose: str, keys: Sequence[str], *, location: str | None = None) -> DataFrame:
    """Collect an update-mode stream: the newest version of every key.

    Each batch writes its own folder, so a repeated batch replaces itself.
    """
    def write(batch: DataFrame, number: int, base: str) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/data/batch={number}")

    base = each_batch(stream, purpose, write, location=location)
    spark = stream.sparkSession
    values = [c for c in stream.columns if c not in keys]
    versions = spark.read.parquet(f"{base}/data")
    newest = F.max_by(F.struct(*values), F.col("batch")).alias("_v")
    return versions.groupBy(*keys).agg(newest).select(*keys, "_v.*")


def assemble_live(
    rows: DataFrame, *, recording: Sequence[tuple[str, str]], place: str, value: str, chunk_size: int, ts: str | None = None, delay: str = "10 minutes"
) -> DataFrame:
    """Emit a chunk as soon as all of its samples have arrived, in any order.

    ``recording`` lists (column, type). The sample's position tells its chunk. A repeated sample counts once.

    Without ``ts`` the open chunks are dealt by a hash of (recording, chunk) to ``CHUNK_SHARDS`` states, so a
    busy recording spreads over all of them; a batch assembles a shard's chunks together, as tables.

    With ``ts`` state is keyed by (recording, chunk), and no key holds more than one chunk.
    With the event time ``ts`` state is bounded: once the watermark (``delay`` behind the newest sample)
    has passed a chunk's newest sample, its state goes. A finished chunk's mark just ends; an unfinished
    one comes out with ``finished`` false, a null ``x`` and the ``n_rows`` that had arrived, so that none
    is lost uncounted. Samples behind the watermark are left out and counted in the query's progress.
    Without ``ts`` nothing is ever too late and marks stay.
    """
    names = [n for n, _ in recording]
    timed = event_time(rows, ts).withWatermark(ts, delay) if ts else rows
    stamp = [F.col(ts).alias("_ts")] if ts else []
    keyed = timed.select(
        *names,
        F.floor(F.col(place) / chunk_size).cast("int").alias("chunk_id"),
        (F.col(place) % chunk_size).cast("int").alias("pos"),
        F.col(value).cast("double").alias("v"),
        *stamp,
    )
    key_types = ", ".join(f"{n} {t}" for n, t in recording)
    columns = [*names, "chunk_id", "x", *(["n_rows", "finished"] if ts else [])]
    if not ts:
        return _assemble_shards(keyed, recording, chunk_size)

    def row(key, x, n: int) -> pd.DataFrame:
        return pd.DataFrame([[*key, x, n, x is not None][: len(columns)]], columns=columns)

    def collect(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        places, values, done, newest = state.get if state.exists else ([], [], False, 0)
        if state.hasTimedOut:
            state.remove()
            if not done:
                yield row(key, None, len(places))
            return
        # What is held comes first, so a repeated sample changes nothing.
        pos, val = [np.asarray(places, "int64")], [np.asarray(values, "float64")]
        for batch in batches:
            pos.append(batch["pos"].to_numpy("int64"))
            val.append(batch["v"].to_numpy("float64", na_value=np.nan))
            if ts and len(batch):
                newest = max(newest, int(batch["_ts"].max().timestamp() * 1000))
        full = False
        if not done:
            at, first = np.unique(np.concatenate(pos), return_index=True)
            held = np.concatenate(val)[first]
            full = len(at) == chunk_size
            x = [None if np.isnan(v) else float(v) for v in held]
            places, values = ([], []) if full else (at.tolist(), x)
        state.update((places, values, done or full, newest))
        if ts:
            state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 1)
        if full:
            yield row(key, x, chunk_size)

    return keyed.groupBy(*names, "chunk_id").applyInPandasWithState(
        collect,
        f"{key_types}, chunk_id int, x array<double>" + (", n_rows int, finished boolean" if ts else ""),
        "places array<int>, values array<double>, done boolean, newest long",
        "append",
        GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout,
    )


def _assemble_shards(keyed: DataFrame, recording: Sequence[tuple[str, str]], chunk_size: int) -> DataFrame:
    """Finished chunks of samples ``recording, chunk_id, pos, v``; a state holds a shard's open samples and the marks of its chunks."""
    names = [n for n, _ in recording]
    # Columns of a recording travel as text, which keeps nulls beside long numbers exact.
    texts = [f"r{i}" for i in range(len(names))]
    key, sample = [*texts, "chunk_id"], [*texts, "chunk_id", "pos"]
    dealt = keyed.filter("chunk_id IS NOT NULL").select(
        F.pmod(F.xxhash64(*names, "chunk_id"), F.lit(CHUNK_SHARDS)).cast("int").alias("shard"),
        *[F.col(n).cast("string").alias(t) for n, t in zip(names, texts, strict=True)], "chunk_id", "pos", "v")
    shape = pd.DataFrame({**dict.fromkeys(texts, pd.Series(dtype=object)), "chunk_id": pd.Series(dtype="int32"), "pos": pd.Series(dtype="int32"), "v": pd.Series(dtype="float64")})

    def collect(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, done = pickle.loads(state.get[0]) if state.exists else (shape, shape[key])
        # What is held comes first, so a repeated sample changes nothing.
        rows = pd.concat([held, *(b[[*sample, "v"]] for b in batches)], ignore_index=True).drop_duplicates(sample, ignore_index=True)
        rows[texts] = rows[texts].astype(object)
        # Chunks that are done come first and have no samples left.
        group = pd.concat([done, rows[key]], ignore_index=True).groupby(key, dropna=False, sort=False).ngroup().to_numpy()
        group = group[len(done) :]
        open_ = group >= len(done)
        rows, group = rows[open_], group[open_] - len(done)
        full = np.bincount(group, minlength=1)[group] == chunk_size
        whole = rows[full].iloc[np.lexsort((rows["pos"].to_numpy()[full], group[full]))]
        firsts = whole[key].iloc[::chunk_size]
        state.update((pickle.dumps((rows[~full], pd.concat([done, firsts], ignore_index=True)), pickle.HIGHEST_PROTOCOL),))
        values = whole["v"].to_numpy().reshape(-1, chunk_size)
        x = [[None if np.isnan(v) else float(v) for v in chunk] for chunk in values]
        if len(x):
            yield firsts.assign(x=x)

    out = dealt.groupBy("shard").applyInPandasWithState(
        collect, ", ".join(f"{t} string" for t in texts) + ", chunk_id int, x array<double>", "held binary", "append", GroupStateTimeout.NoTimeout)
    return out.select(*[F.col(t).cast(kind).alias(n) for t, (n, kind) in zip(texts, recording, strict=True)], "chunk_id", "x")


def score_stream(chunks: DataFrame, coefficients: DataFrame, *, slot: str = "sensor", column: str = "features") -> DataFrame:
    """Stateless scoring of arriving chunks against a fixed coefficient table."""
    return models.verdicts(models.linear_probabilities(chunks, coefficients, slot=slot, column=column), slot=slot)


def latest_state(scored: DataFrame, *, keys: Sequence[str], score: str, order: Sequence[Column | str]) -> DataFrame:
    """Newest score per key (update mode)."""
    return scored.groupBy(*keys).agg(F.max_by(score, F.struct(*order)).alias("score"))


def integrated_state(
    scored: DataFrame, *, keys: Sequence[str], sensor: str, score: str, order: Sequence[str], sensors: Sequence[str] = SENSORS
) -> DataFrame:
    """Integrated score of each unit from the newest score of each of its sensors (update mode).

    The sensors are few and known, so one aggregate holds the newest of each of them and what is
    integrated follows from its row; two aggregates in a row are not possible in update mode.
    """
    newest = [F.max_by(F.when(F.col(sensor) == s, F.col(score)), F.when(F.col(sensor) == s, F.struct(*order))) for s in sensors]
    state = scored.groupBy(*keys).agg(F.array(*newest).alias("_all"))
    held = state.select(*keys, F.filter("_all", lambda v: v.isNotNull()).alias("_s"))
    mean = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("_s"), F.lit(0))
    worst = F.array_max("_s")
    value = health.integrated_score(mean, worst)
    return held.select(
        *keys, value.alias("integrated"), half_up(mean, 3).alias("mean"), half_up(worst, 3).alias("worst"),
        F.bround(value * 100.0, 0).cast("int").alias("points"))


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ring(
    stream: DataFrame, purpose: str, *, keys: Sequence[str], order: Sequence[str], keep: int, location: str | None = None
) -> DataFrame:
    """Newest ``keep`` rows per key, carried from batch to batch in buckets of keys.

    A batch reads and writes the buckets that it has rows for; a manifest tells in which batch's folder
    each bucket stands. A repeated batch starts from the manifest before it; versions that neither this
    nor the last manifest names are removed. A missing version is an error.
    """
    spark = stream.sparkSession
    schema = stream.schema
    bucket = F.pmod(F.xxhash64(*keys), F.lit(RING_BUCKETS)).cast("int") if keys else F.lit(0)

    def manifest(session: SparkSession, base: str, number: int) -> dict[int, int]:
        rows = session.read.schema("bucket int, batch int").parquet(f"{base}/manifest/{number}").collect()
        return {r["bucket"]: r["batch"] for r in rows}  # at most one row per bucket

    def versions(base: str, places: dict[int, int]) -> list[str]:
        return [f"{base}/data/{n}/__bucket={b}" for b, n in sorted(places.items())]

    def compact(batch: DataFrame, number: int, base: str) -> None:
        session = batch.sparkSession
        before = manifest(session, base, number - 1) if number > 0 else {}
        arrived = batch.withColumn("__bucket", bucket).persist()
        touched = [r["__bucket"] for r in arrived.select("__bucket").distinct().collect()]
        old = versions(base, {b: before[b] for b in touched if b in before})
        merged = arrived.drop("__bucket")
        if old:
            merged = session.read.schema(schema).parquet(*old).unionByName(merged)
        newest = [F.col(c).desc() for c in order]
        kept = (
            alerts.keep_newest_per(merged, keys, newest, keep) if keys else merged.orderBy(*newest).limit(keep)
        )
        if touched:
            kept.withColumn("__bucket", bucket).repartition("__bucket").write.mode("overwrite").partitionBy("__bucket").parquet(f"{base}/data/{number}")
        arrived.unpersist()
        after = before | dict.fromkeys(touched, number)
        session.createDataFrame(sorted(after.items()), "bucket int, batch int").coalesce(1).write.mode("overwrite").parquet(f"{base}/manifest/{number}")
        session.range(1).select(F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{base}/last")
        if number > 1:
            named = {*versions(base, before), *versions(base, after)}
            for path in versions(base, manifest(session, base, number - 2)):
                if path not in named:
                    _remove(session, path)

    base = each_batch(stream, purpose, compact, mode="append", location=location)
    try:
        last = spark.read.schema("batch int").parquet(f"{base}/last").first()
    except AnalysisException:  # no batch yet
        return spark.createDataFrame([], schema)
    places = manifest(spark, base, last["batch"])
    return spark.read.schema(schema).parquet(*versions(base, places)) if places else spark.createDataFrame([], schema)


def alert_stream(responses: DataFrame, *, ts: str = "ts", delay: str | None = None) -> DataFrame:
    """Alerts of arriving responses, each id once.

    With a ``delay`` the ids of older responses are forgotten, and later repeats come through; without
    one no response is ever too late and all ids are kept.
    """
    timed = event_time(responses, ts)
    if delay is None:
        return alerts.response_alerts(timed).dropDuplicates(["id"])
    return alerts.response_alerts(timed.withWatermark(ts, delay)).dropDuplicatesWithinWatermark(["id"])


def message_rate(messages: DataFrame, *, ts: str = "ts", every: str = "1 second", delay: str | None = None) -> DataFrame:
    """Messages per tumbling window (update mode).

    With a ``delay`` closed windows are dropped from the state and later messages with them.
    """
    timed = event_time(messages, ts)
    if timed.isStreaming and delay is not None:
        timed = timed.withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, every).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "n"
    )


