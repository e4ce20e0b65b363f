"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents. Ids are split into chunks of eight bits. Level 0
has the lowest chunk of every id; a bitmap beside each level says which ids go on, and the next
level holds the next chunk of those alone. A rank directory (ones before every 512th bit) leads from
a position in one level to its position in the next, so any token is read with one chunk and one
rank per level; nothing is decoded in blocks.

Segments are rows of Parquet files written by Spark's own committer: a lost task is written again
and half-written files are never seen. ``bucket`` numbers the range of document ids, ``first`` is
the position of a segment's first token in its bucket. Ids grow from bucket to bucket.

Null text counts as empty and has the end id alone. Rows with one id follow each other by text; null
ids come first. An empty table gives no segment. A segment has about ``SEGMENT_BYTES`` of text; a document
is never split, a longer one is a segment of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.llm.byte_bpe import byte_characters
from drivepulse.llm.common import PieceCache, ragged, slices, texts_of, utf8_parts
from drivepulse.session import shared_dir

# Bytes of text in a segment, and the width of the cells by which positions are dealt to segments.
SEGMENT_BYTES = 2 << 20
CELL_TOKENS = 1 << 18
# Bits between two entries of a rank directory.
RANK_BITS = 512
ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def pack(ids: np.ndarray) -> bytes:
    """Levels of chunks: for each the number of ids, the chunks, the bitmap and its rank directory."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        goes_on = rest > 255
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        per_block = ONES[bits].reshape(-1, RANK_BITS // 8).sum(1, dtype=np.uint32)
        ranks = np.cumsum(per_block, dtype=np.uint32) - per_block
        out += [np.array([len(rest)], "<u4").tobytes(), (rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.astype("<u4").tobytes()]
        if not goes_on.any():
            return b"".join(out)
        rest = rest[goes_on] >> 8


class Levels:
    """A packed segment, read in place."""

    def __init__(self, packed: bytes):
        self.levels, at = [], 0
        while at < len(packed):
            n = int(np.frombuffer(packed, "<u4", 1, at)[0])
            blocks = -(-(-(-n // 8)) // (RANK_BITS // 8))
            chunks = np.frombuffer(packed, np.uint8, n, at + 4)
            bits = np.frombuffer(packed, np.uint8, blocks * RANK_BITS // 8, at + 4 + n)
            ranks = np.frombuffer(packed, "<u4", blocks, at + 4 + n + len(bits))
            self.levels.append((chunks, bits, ranks))
            at += 4 + n + len(bits) + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, i: int) -> int:
        """Token i: one chunk and one rank per level."""
        value = 0
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << 8 * depth
            if not bits[i >> 3] >> (i & 7) & 1:
                return value
            block = i // RANK_BITS * (RANK_BITS // 8)
            before = int(ONES[bits[block : i >> 3]].sum()) + int(ONES[bits[i >> 3] & ((1 << (i & 7)) - 1)])
            i = int(ranks[i // RANK_BITS]) + before
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """All tokens in order."""
        value = None
        for chunks, bits, _ in reversed(self.levels):
            goes_on = np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)
            ids = chunks.astype(np.uint32)
            if value is not None:
                ids[goes_on] |= value << np.uint32(8)
            value = ids
        return value


# Classes of bytes: white space, letter, digit, other sign, and whatever is left to the tokenizer as a whole word.
SPACE, LETTER, DIGIT, SIGN, OTHER = range(5)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[33:127] = SIGN
CLASS[48:58] = DIGIT
CLASS[65:91] = CLASS[97:123] = LETTER
CLASS[9:14] = CLASS[32] = SPACE
# Added tokens begin with "<", contractions with an apostrophe.
CLASS[[ord("<"), ord("'")]] = OTHER
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class WordEncoder:
    """The ids of texts from a tokenizers file that lower-cases, drops white space and never merges across it.

    Words of ASCII signs and Latin-1 letters are cut where the kind of sign changes (every digit by
    itself), as the file's own pattern cuts them, and the different pieces of a batch are encoded
    once: runs of letters by the merge model, others by the whole tokenizer. A word with any other
    character, an apostrophe or the beginning of an added token goes through the tokenizer as it is.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.map = dict(enumerate(byte_characters()))
        self.known = PieceCache(self._pieces)

    def _pieces(self, pieces: list[tuple[bytes, bool]]) -> list[bytes]:
        out: list = [None] * len(pieces)
        whole = []
        for i, (piece, easy) in enumerate(pieces):
            if easy:
                mapped = piece.decode("latin-1").translate(self.map)
                out[i] = np.array([t.id for t in self.model.tokenize(mapped)], "<u4").tobytes()
            else:
                whole.append(i)
        texts = [pieces[i][0].decode() for i in whole]
        for i, e in zip(whole, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            out[i] = np.array(e.ids, "<u4").tobytes()
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and n + 1 offsets of the rows into them."""
        kind = CLASS[data]
        low = LOWER[data]
        # Letters of two bytes, U+00C0 to U+00FF but for two signs; the capitals are 32 below.
        pair = np.flatnonzero(data[:-1] == 0xC3)
        second = data[pair + 1]
        pair, second = (x[(second != 0x97) & (second != 0xB7)] for x in (pair, second))
        kind[pair] = kind[pair + 1] = LETTER
        low[pair + 1] = np.where(second < 0x9F, second + 32, second)
        inside = kind != SPACE
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:-1]
        first = np.flatnonzero(begins)
        word = np.cumsum(begins) - 1
        hard = np.zeros(len(first), bool)
        hard[word[kind == OTHER]] = True
        hard_byte = hard[word] & inside if len(first) else inside
        new = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        begins[1:] |= inside[1:] & new & ~hard_byte[1:]
        kept = np.where(hard_byte, data, low)[inside]
        place = np.cumsum(inside) - inside
        first = np.flatnonzero(begins)
        bounds = np.append(place[first], len(kept)).astype(np.int32)
        column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(kept))])
        coded = column.dictionary_encode()
        at = coded.indices.to_numpy(zero_copy_only=False)
        # A piece is encoded the same way wherever it stands, so any of its places tells whether it is a run of letters.
        easy = np.zeros(len(coded.dictionary), bool)
        easy[at] = (kind[first] == LETTER) & ~hard_byte[first]
        pieces = list(zip(coded.dictionary.to_pylist(), easy.tolist(), strict=True))
        self.known.learn(pieces)
        ids = [self.known[p] for p in pieces]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), "<u4")
        starts = np.cumsum(sizes) - sizes
        counts = sizes[at]
        rows = np.searchsorted(first, offsets)
        return flat[ragged(starts[at], counts)], np.concatenate([[0], np.cumsum(counts)])[rows]


@cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


SEGMENTS = "bucket int, first bigint, n_tokens bigint, doc_ids array<bigint>, ends array<bigint>, payload binary"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, buckets: int | None = None) -> None:
    """Encode every whole text, append ``end_id`` and write segments in ascending order of ids."""
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, bucket, first = word_encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in slices(batches, size=SEGMENT_BYTES):
            ids, at = tool.encode(*utf8_parts(batch.column(1)))
            ends = at[1:] + np.arange(1, len(at))
            out = np.full(len(ids) + len(ends), end_id, np.uint32)
            out[np.arange(len(ids)) + np.repeat(np.arange(len(ends)), np.diff(at))] = ids
            values = [bucket, first, len(out), batch.column(0).to_pylist(), ends, pack(out)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
            first += len(out)

    ordered = texts_of(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, SEGMENTS).write.parquet(path)


def segments(spark, path: str) -> DataFrame:
    """The segments with ``start``, the number of tokens before each.

    Only one total per bucket is put in order, not the segments; these totals, as many as the files have
    buckets, go to the segments, so no payload is shuffled.
    """
    files = spark.read.schema(SEGMENTS).parquet(path)
    totals = files.groupBy("bucket").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("base"))
    return files.join(F.broadcast(base), "bucket").withColumn("start", F.col("base") + F.col("first")).drop("base")


def tokens_at(spark, path: str, positions: DataFrame) -> DataFrame:
    """Rows ``position, token`` for wanted positions in the whole file, each read in place.

    Positions are dealt to segments by binary search over the starts, a few bytes per segment.
    """
    parts = segments(spark, path)
    cell = CELL_TOKENS
    spans = parts.select("bucket", "first", "start", "payload", F.explode(
        F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("start") + F.col("n_tokens") - 1) / cell))).alias("cell"), "n_tokens")
    wanted = positions.select(F.col("position").cast("long").alias("position")).withColumn("cell", F.floor(F.col("position") / cell))
    inside = (F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("n_tokens"))
    found = wanted.join(spans, "cell").filter(inside).select("position", (F.col("position") - F.col("start")).alias("i"), "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [Levels(p).at(i) for i, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64())], ["position", "token"])

    return found.mapInArrow(run, "position bigint, token bigint")


def documents(spark, path: str) -> DataFrame:
    """Rows ``doc_id, start, ids`` read back from the files; ids packed as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Levels(row["payload"]).all().astype("<u4").tobytes()
                ends = np.asarray(row["ends"], np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                values = pa.array([ids[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(begins + row["start"], pa.int64()), values], ["doc_id", "start", "ids"])

    return segments(spark, path).select("start", "doc_ids", "ends", "payload").mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write token files below the shared folder and describe each document as read back from them."""
    path = shared_dir(docs.sparkSession, "tokens")
    write(docs, path, tokenizer, end_id)
    return documents(docs.sparkSession, path).select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
