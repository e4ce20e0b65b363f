"""Exact top-k inner products by an impact-ordered index that is read a score at a time.

Components are integers, floor(1024 x). In a block of rows, every dimension has its rows in order of
value, read from the top for a positive and from the bottom for a negative query component; the
impact of a row there is how far its value is from the far end, so that impacts never are negative.
The lists are cut into segments of equal quantised impact. A query adds segments of all dimensions
to the scores of their rows, by descending product of component and impact. What a dimension may
still add is bounded by its next segment. As soon as too few points are left for any row to reach
the k-th best score known (of this block or of an earlier one), the rest is left unread; the rows
that may be members are scored exactly.

Vectors that are null, or hold a null or a component that is not finite, take no part. A query and a
row must have the same length. Equal scores go to the smaller id. Rows that repeat an id are rows of
their own, but never answers to a query with that id; of query rows that repeat an id the smallest
vector asks. Queries go to the rows in blocks of ``QUERY_BLOCK``; rows are never paired in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.session import shared_dir

SCALE = 1024
K = 10
QUERY_BLOCK = 8_192
ROW_BLOCK = 8_192
# Steps in which the products of component and impact are read.
LEVELS = 12
SEGMENTS = 16


def scaled(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``vec_id, v``: integer components of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(
        x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.filter(usable).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


class Block:
    """The index of a block of rows of one length."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        n, self.dims = rows.shape
        self.low, self.high = rows.min(0), rows.max(0)
        # For each direction and dimension: rows by descending impact, and where each segment of equal quantised impact begins.
        self.lists = []
        width = np.maximum(1, -(-(self.high - self.low + 1) // SEGMENTS))
        for impact in (rows - self.low, self.high - rows):
            order = np.argsort(-impact, axis=0, kind="stable")
            value = np.take_along_axis(impact, order, 0)
            level = value // width
            cuts = np.stack([np.searchsorted(-level[:, d], -np.arange(SEGMENTS - 1, -2, -1)) for d in range(self.dims)])
            self.lists.append((order.T.astype(np.int32).ravel(), value.T.astype(np.float64).ravel(), cuts))
        self.width = width
        self.n = n

    def top(self, query: np.ndarray, own: int, k: int, known: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of all rows that may be among the k best, given that k rows score ``known`` elsewhere."""
        n = self.n
        weight = np.abs(query).astype(np.float64)
        backwards = query < 0
        base = float((query * np.where(backwards, self.high, self.low)).sum())
        cuts = np.where(backwards[:, None], self.lists[1][2], self.lists[0][2])
        # Segment s of a dimension has impacts below (SEGMENTS - s) * width; empty ones are passed over.
        ceiling = weight[:, None] * (np.arange(SEGMENTS, 0, -1) * self.width[:, None] - 1)
        ceiling = np.minimum(ceiling, (weight * (self.high - self.low))[:, None])
        most = ceiling.max() if ceiling.size else 0.0
        step = np.clip(np.floor((most - ceiling) * LEVELS / max(most, 1.0)), 0, LEVELS - 1).astype(int)
        # Within a dimension segments are read in order, so each step takes a run of every list.
        read = np.zeros(self.dims, int)
        score = np.full(n, base)
        # Rows with the query's own id, however many, are no answers and prove nothing.
        others = np.flatnonzero(self.ids != own)
        for level in range(LEVELS):
            upto = (step <= level).sum(1)
            first = cuts[np.arange(self.dims), read] + np.arange(self.dims) * n
            last = cuts[np.arange(self.dims), upto] + np.arange(self.dims) * n
            for side in (0, 1):
                rows, value, _ = self.lists[side]
                which = np.flatnonzero((backwards == bool(side)) & (last > first))
                if len(which):
                    size = (last - first)[which]
                    ends = np.cumsum(size)
                    at = np.arange(ends[-1]) + np.repeat(first[which] - (ends - size), size)
                    score += np.bincount(rows[at], np.repeat(weight[which], size) * value[at], n)
            read = upto
            left = float(np.where(read < SEGMENTS, ceiling[np.arange(self.dims), np.minimum(read, SEGMENTS - 1)], 0.0).sum())
            met = score if len(others) == n else score[others]
            reached = np.partition(met, len(met) - k)[len(met) - k] if len(met) >= k else -np.inf
            bar = max(known, reached)
            # Proof: whoever stays below the bar with all that is left cannot be a member.
            possible = met + left >= bar
            if left == 0.0 or possible.sum() <= 4 * k:
                break
        which = others[possible]
        exact = self.rows[which] @ query
        order = np.lexsort([self.ids[which], -exact])[:k]
        return self.ids[which[order]], exact[order]


def _by_length(ids: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    at = np.cumsum(sizes) - sizes
    for size in np.unique(sizes[sizes > 0]).tolist():
        here = np.flatnonzero(sizes == size)
        yield ids[here], values[at[here][:, None] + np.arange(size)]


def _vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)


def search(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows ``query_id, rank, vec_id, score``: the k best rows for every query; both frames have ``vec_id, embedding``."""
    spark = vectors.sparkSession
    rows = scaled(vectors)
    asked = scaled(queries).groupBy("vec_id").agg(F.min("v").alias("v"))
    path, parts, block = shared_dir(spark, "top-k"), 0, []

    def answer(block: list) -> None:
        sent = spark.sparkContext.broadcast((np.array([i for i, _ in block], np.int64), np.concatenate([np.asarray(v, np.int64) for _, v in block]), np.array([len(v) for _, v in block], np.int64)))
        best_of_block(rows, sent, k).write.mode("append").parquet(path)

    for row in asked.toLocalIterator():
        block.append((row.vec_id, row.v))
        if len(block) == QUERY_BLOCK:
            answer(block)
            parts, block = parts + 1, []
    if block or not parts:
        answer(block or [(0, [])])
    found = spark.read.schema("query_id bigint, vec_id bigint, score bigint").parquet(path)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def best_of_block(rows: DataFrame, sent, k: int) -> DataFrame:
    """The k best rows of each partition for every query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = {q.shape[1]: (i, q) for i, q in _by_length(*sent.value)}
        best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for ids, values in _blocks(batches):
            if values.shape[1] not in asked:
                continue
            index = Block(ids, values)
            for q, query in zip(*asked[values.shape[1]], strict=True):
                key = (int(q), values.shape[1])
                have_ids, have = best.get(key, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
                found, score = index.top(query, int(q), k, float(have[-1]) if len(have) == k else -np.inf)
                found, score = np.concatenate([have_ids, found]), np.concatenate([have, score])
                order = np.lexsort([found, -score])[:k]
                best[key] = found[order], score[order]
        if best:
            sizes = [len(i) for i, _ in best.values()]
            columns = [np.repeat([q for q, _ in best], sizes), np.concatenate([i for i, _ in best.values()]), np.concatenate([s for _, s in best.values()])]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])

    return rows.mapInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one length in blocks."""
    waiting: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        for ids, values in _by_length(batch.column(0).to_numpy(), *_vectors(batch.column(1))):
            held = waiting.setdefault(values.shape[1], [])
            held.append((ids, values))
            if sum(len(i) for i, _ in held) >= ROW_BLOCK:
                yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
                held.clear()
    for held in waiting.values():
        if held:
            yield np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
