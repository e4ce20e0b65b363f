"""What the operators share: narrow reads, Arrow text views, bounded caches, scratch tables.

Rows of a documents table: ``doc_id`` (bigint) and ``text`` (string). Unless an operator says
otherwise a null text counts as an empty one, a null id stays a row of its own with a null id,
rows that share an id are scored one by one, and further columns are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Entries a per-process cache of encoded pieces may hold before it starts anew.
CACHE_ENTRIES = 400_000
# Bytes of text that one vectorised step works on.
STEP_BYTES = 2 << 20


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts_of(docs: DataFrame) -> DataFrame:
    """Only the two columns that text operators read; null text becomes empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def training_row(key: str = "doc_id"):
    """True for rows that models may learn from (crc32 of the id as text, mod 3, is not 1)."""
    return F.crc32(F.col(key).cast("string")) % 3 != 1


def held_out(key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False)).alias("held_out")


def utf8_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of an Arrow column, one after another, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``size`` bytes; a longer row is a run of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text."""
    for batch in batches:
        if batch.num_rows:
            _, at = utf8_parts(batch.column(batch.schema.get_field_index(text)))
            for first, last in steps(at, size):
                yield batch.slice(first, last - first)


class PieceCache(dict):
    """Encoded form of each piece; pieces that are missing are encoded together."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = CACHE_ENTRIES):
        super().__init__()
        self.encode, self.limit = encode, limit

    def learn(self, pieces) -> None:
        new = [p for p in pieces if p not in self]
        if new:
            if len(self) + len(new) > self.limit:
                self.clear()
                new = list(pieces)
            self.update(zip(new, self.encode(new), strict=True))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of every run, one run after another."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def run_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]


def words_of(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of rows stored one after another: maximal runs of bytes with ``inside[byte]``.

    Returns the start and end of every word and n + 1 offsets of the rows into the words.
    """
    kept = inside[data]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = kept[cut]
    stops = kept.copy()
    stops[:-1] &= ~kept[1:]
    stops[cut - 1] = kept[cut - 1]
    first, last = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return first, last, np.searchsorted(first, offsets)


# Random 64-bit word for each byte and an odd multiplier; both fixed by their seeds.
BYTE_WORDS = np.random.default_rng(20_260).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit words."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def span_hashes(data: np.ndarray, first: np.ndarray, last: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[first:last] for every span, however many and long they are.

    Spans must be sorted and must not overlap.
    """
    out = np.zeros(len(first), np.uint64)
    ends = np.cumsum(last - first)
    begin = 0
    while begin < len(first):  # a bounded number of bytes at once
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + STEP_BYTES, "right")))
        a, lengths = first[begin:end], (last - first)[begin:end]
        powers = STEP ** np.arange(int(lengths.max()) + 1, dtype=np.uint64)
        at = ragged(a, lengths)
        runs = np.cumsum(lengths) - lengths
        values = BYTE_WORDS[data[at]] * powers[np.arange(len(at)) - np.repeat(runs, lengths)]
        some = lengths > 0
        part = np.zeros(len(a), np.uint64)
        if some.any():
            part[some] = np.add.reduceat(values, runs[some])
        out[begin:end] = mix(part + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed))
        begin = end
    return out


KEYED = "part bigint, key bigint, doc bigint, n bigint, shared boolean"


def keyed_rows(key: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """The (key, document) pairs of one task, pre-aggregated before the shuffle.

    A pair whose key no other pair of the task has is sent to its key. Pairs of a key that the task
    has more than once are shared already: they are dealt out by document, and one row without a
    document brings their number to the key. So a key gets one row from a task at most.
    """
    order = np.lexsort([doc, key])
    key, doc = key[order], doc[order]
    fresh = np.append(True, key[1:] != key[:-1])[: len(key)]
    first = np.flatnonzero(fresh)
    n = np.diff(np.append(first, len(key)))
    names, many = key[first], n > 1
    alone = np.repeat(n == 1, n)
    # A document that has a key more than once is one pair.
    pairs = ~alone & (fresh | np.append(True, doc[1:] != doc[:-1])[: len(key)])
    parts = np.concatenate([key[alone], mix(doc[pairs].astype(np.uint64) + key[pairs].astype(np.uint64)).astype(np.int64), names[many]])
    docs = pa.concat_arrays([pa.array(doc[alone]), pa.array(doc[pairs]), pa.nulls(int(many.sum()), pa.int64())])
    counts = np.concatenate([np.ones(int(alone.sum() + pairs.sum()), np.int64), n[many]])
    shared = np.zeros(len(parts), bool)
    shared[int(alone.sum()) : int(alone.sum() + pairs.sum())] = True
    # A key is written only where the rows are not dealt out by it.
    keys = pa.concat_arrays([pa.nulls(int(alone.sum()), pa.int64()), pa.array(key[pairs]), pa.nulls(int(many.sum()), pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array(parts), keys, docs, pa.array(counts), pa.array(shared)], [f.split()[0] for f in KEYED.split(", ")])


def shared_pairs(rows: DataFrame, many: int | None = None) -> DataFrame:
    """Rows ``doc, key, n`` of all pairs whose key another pair has too (n is passed on from rows that are shared already).

    Keys with more than ``many`` pairs also give a row without a document, with their number of pairs.
    ``rows`` come from :func:`keyed_rows`. One shuffle; a task then looks at the rows of its keys at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs, counts = [], [], []
        for batch in batches:
            shared = batch.column(4)
            yield pa.RecordBatch.from_arrays([c.filter(shared) for c in (batch.column(2), batch.column(1), batch.column(3))], ["doc", "key", "n"])
            open_ = pa.compute.invert(shared)
            keys.append(batch.column(0).filter(open_).to_numpy(zero_copy_only=False))
            docs.append(batch.column(2).filter(open_))
            counts.append(batch.column(3).filter(open_).to_numpy(zero_copy_only=False))
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        doc = pa.concat_arrays(docs)
        names, at = np.unique(key, return_inverse=True)
        total = np.bincount(at, n, len(names)).astype(np.int64)
        kept = (total[at] > 1) & doc.is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([doc.filter(pa.array(kept)), pa.array(key[kept]), pa.array(n[kept])], ["doc", "key", "n"])
        if many is not None:
            names, total = names[total > many], total[total > many]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(names), pa.int64()), pa.array(names), pa.array(total)], ["doc", "key", "n"])

    return rows.repartition("part").mapInArrow(run, "doc bigint, key bigint, n bigint")


# Parts that keys are dealt to, and pairs that a task looks at together (or those of one part, if they are more).
PARTS, HELD_PAIRS = 1 << 12, 1 << 19
PACKED = "part int, base bigint, keys binary, low binary, high binary, totals binary, shared binary"


def _dealt(values: np.ndarray, part: np.ndarray) -> pa.Array:
    """The bytes of the values of each of ``PARTS`` parts."""
    order = np.argsort(part, kind="stable")
    offsets = np.searchsorted(part[order], np.arange(PARTS + 1)) * (values.itemsize * (values.shape[1] if values.ndim > 1 else 1))
    return pa.Array.from_buffers(pa.binary(), PARTS, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values[order]))])


def packed_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of :func:`keyed_rows` with all rows of a part in one row, so that a shuffle moves a row for some hundred pairs.

    ``keys`` and the halves of ``doc - base`` (``high`` is empty where ids of a batch differ by less than 2^32) are pairs,
    ``totals`` keys with their number of pairs, ``shared`` rows ``doc, key, n`` that are shared already.
    """
    for batch in batches:
        name, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
        ids = batch.column(2)
        known, doc = ids.is_valid().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
        done = batch.column(4).to_numpy(zero_copy_only=False)
        part = (mix(name.astype(np.uint64)) % np.uint64(PARTS)).astype(np.int32)
        pair, total = ~done & known, ~done & ~known
        base = int(doc[pair].min()) if pair.any() else 0
        away = doc[pair].astype(np.uint64) - np.int64(base).astype(np.uint64)
        high = (away >> np.uint64(32)).astype(np.uint32)
        wide = bool(high.any())
        key = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)
        columns = [
            _dealt(name[pair], part[pair]), _dealt(away.astype(np.uint32), part[pair]), _dealt(high if wide else high[:0], part[pair][: None if wide else 0]),
            _dealt(np.stack([name[total], n[total]], axis=1), part[total]), _dealt(np.stack([doc[done], key[done], n[done]], axis=1), part[done])]
        some = np.unique(part)
        rows = pa.RecordBatch.from_arrays(
            [pa.array(np.arange(PARTS, dtype=np.int32)), pa.array(np.full(PARTS, base)), *columns], [f.split()[0] for f in PACKED.split(", ")])
        yield rows.take(pa.array(some))


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all rows of a binary column, one after another, and how many each row has."""
    data, at = utf8_parts(column)
    return np.frombuffer(data.tobytes(), kind), np.diff(at) // np.dtype(kind).itemsize


def shared_packed(rows: DataFrame) -> DataFrame:
    """What :func:`shared_pairs` gives, from rows of :func:`packed_parts`; a task holds the pairs of a part, however few tasks there are."""

    def found(held: list) -> Iterator[pa.RecordBatch]:
        keys, docs, totals = (np.concatenate([h[i] for h in held]) for i in range(3))
        totals = totals.reshape(-1, 2)
        names, at = np.unique(np.concatenate([keys, totals[:, 0]]), return_inverse=True)
        many = np.bincount(at, np.concatenate([np.ones(len(keys), np.int64), totals[:, 1]]), len(names))
        kept = many[at[: len(keys)]] > 1
        yield pa.RecordBatch.from_arrays([pa.array(docs[kept]), pa.array(keys[kept]), pa.array(np.ones(int(kept.sum()), np.int64))], ["doc", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            triples = _numbers(batch.column(6), "int64")[0].reshape(-1, 3)
            if len(triples):
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in triples.T], ["doc", "key", "n"])
            part, base = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            keys, lengths = _numbers(batch.column(2), "int64")
            docs = _numbers(batch.column(3), "uint32")[0].astype(np.uint64) + np.repeat(base, lengths).astype(np.uint64)
            high, wide = _numbers(batch.column(4), "uint32")
            docs[np.repeat(wide > 0, lengths)] += high.astype(np.uint64) << np.uint64(32)
            totals, numbers = _numbers(batch.column(5), "int64")
            # Rows come in order of their part, so what stands before the last part is whole.
            row = int(np.searchsorted(part, part[-1]))
            a, t = int(lengths[:row].sum()), int(numbers[:row].sum())
            whole = row > 0 or last != part[-1]
            held.append((keys[:a], docs[:a].astype(np.int64), totals[:t]))
            size += a + t
            if whole and size >= HELD_PAIRS:
                yield from found(held)
                held, size = [], 0
            held.append((keys[a:], docs[a:].astype(np.int64), totals[t:]))
            size += len(keys) - a + len(totals) - t
            last = part[-1]
        if held:
            yield from found(held)

    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc bigint, key bigint, n bigint")
