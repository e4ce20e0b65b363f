"""Benchmark decontamination by suffix arrays over the training documents.

A shard is a few megabytes of documents as one sequence of word hashes, documents apart from each
other by a separator. Its suffixes are sorted (first by word, then by doubling the length that is
compared, among suffixes that still tie) to the length of the longest benchmark suffix. Every
benchmark suffix is then found by binary search in every shard: the range of suffixes that begin
with its window gives all places of the window, and extending those that no earlier word could join gives
the longest verbatim match of every document. Shards are built where the documents are read, so that
no text is shuffled. A shard is sorted once; the benchmark is searched in it in blocks of bounded size.
Word hashes of ``ROUND_WORDS`` characters of benchmark text are broadcast at a time; a larger benchmark
takes further rounds, between which the rows are written and the broadcast is destroyed.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. A window is
``window`` consecutive words of an item; an item of fewer words is one window, an item without words
has none. Null text has no words. Each document row is judged by itself: repeated rows repeat their
result. Items that share an id count once; passages of items with a null id are hits like any other, but
names and counts of items leave them out. With an empty benchmark nothing is hit. A document longer
than a shard is sorted in pieces that overlap by the longest benchmark suffix. Among equally long
verbatim matches the first place in the document counts; a document without hits has length 0 and no place.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from drivepulse.llm.common import slices, span_hashes, texts_of, utf8_parts, words_of
from drivepulse.session import bounded_batches, materialise

WINDOW = 13
# A document is contaminated when at least one in so many of its words is hit.
SHARE = 20
# Characters of benchmark text that a shard is searched for at once, and that one broadcast holds (8 bytes
# for each of its words); words of a sorted piece; words compared one by one; pairs of places compared at once.
BLOCK_WORDS = 1 << 20
ROUND_WORDS = 1 << 26
PIECE_WORDS = 1 << 19
STRIDE = 16
PAIRS = 1 << 16

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[97:123] = INSIDE[128:] = True
SEPARATOR = np.uint64(0)


def word_sequence(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of rows stored one after another, and n + 1 offsets of the rows into them."""
    data = LOWER[data]
    first, last, at = words_of(data, offsets, INSIDE)
    return span_hashes(data, first, last) | np.uint64(1), at


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes in the order of their first ``depth`` words (at least).

    Words are ordered by hash; the end of the sequence comes before any word.
    """
    n = len(words)
    order = np.argsort(words)
    fresh = np.ones(n, bool)
    fresh[1:] = words[order[1:]] != words[order[:-1]]
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, n))
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(heads, sizes)
    rank[n] = -1
    tied = order[np.repeat(sizes > 1, sizes)]
    length = 1
    while len(tied) and length < depth:
        group = rank[tied]
        key = (group << 32) + rank[np.minimum(tied + length, n)] + 1
        by_key = np.argsort(key)
        tied, key, group = tied[by_key], key[by_key], group[by_key]
        place = np.arange(len(tied))
        new_group = np.ones(len(tied), bool)
        new_group[1:] = group[1:] != group[:-1]
        new_key = np.ones(len(tied), bool)
        new_key[1:] = key[1:] != key[:-1]
        group_head = np.maximum.accumulate(np.where(new_group, place, 0))
        key_head = np.maximum.accumulate(np.where(new_key, place, 0))
        order[group + place - group_head] = tied
        rank[tied] = group + key_head - group_head
        alone = new_key & np.append(new_key[1:], True)
        tied = tied[~alone]
        length *= 2
    return order


# An odd multiplier of 64 bits and its inverse (fixed values), whose powers weigh the words of a sequence.
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(base: np.uint64, bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.append(np.uint64(1), np.full((1 << bits) - 1, base)))


class Sequence:
    """Word hashes, and sums over their prefixes, made when first needed, by which long stretches are compared in one step."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @cached_property
    def sums(self) -> np.ndarray:
        n = len(self.words)
        return np.append(np.uint64(0), np.cumsum(self.words * _powers(STEP, n.bit_length())[:n]))

    def stretch(self, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """64-bit hashes of ``n`` words from each ``first`` on."""
        return (self.sums[first + n] - self.sums[first]) * _powers(BACK, len(self.words).bit_length())[first]


def common(a: Sequence, places: np.ndarray, b: Sequence, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many words agree from each place of ``a`` and each begin of ``b`` on, up to ``sizes``.

    The first ``STRIDE`` words are compared one by one, the rest of pairs that agree so far by halving.
    """
    sizes = np.minimum(sizes, np.minimum(len(a.words) - places, len(b.words) - begins))
    step = np.arange(STRIDE)
    here, there = np.minimum(places[:, None] + step, len(a.words) - 1), np.minimum(begins[:, None] + step, len(b.words) - 1)
    same = (step < sizes[:, None]) & (a.words[here] == b.words[there])
    out = np.where(same.all(1), STRIDE, same.argmin(1))
    open_ = np.flatnonzero((out == STRIDE) & (sizes > STRIDE))
    low, high = out[open_], sizes[open_]
    while (todo := np.flatnonzero(low < high)).size:
        middle = (low[todo] + high[todo] + 1) >> 1
        agree = a.stretch(places[open_[todo]], middle) == b.stretch(begins[open_[todo]], middle)
        low[todo] = np.where(agree, middle, low[todo])
        high[todo] = np.where(agree, high[todo], middle - 1)
    out[open_] = low
    return out


@dataclass
class Block:
    """Benchmark suffixes: word hashes of all items in a row, and for each suffix where it starts and ends there.

    ``named`` tells whether the item has an id; ``item`` is 0 where it has none.
    """

    words: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    item: np.ndarray
    named: np.ndarray
    place: np.ndarray
    window: int

    @cached_property
    def sequence(self) -> Sequence:
        return Sequence(self.words)

    def needed(self) -> np.ndarray:
        """Words that the window at each suffix has; 0 where no window starts."""
        size, whole = self.end - self.begin, self.end - (self.begin - self.place)
        short = (whole < self.window) & (self.place == 0)
        return np.where(size >= self.window, self.window, np.where(short, size, 0))


@dataclass
class Items:
    """The items of a block as they are sent: word hashes of all in a row, n + 1 offsets of the items into them, and ids."""

    words: np.ndarray
    at: np.ndarray
    item: np.ndarray
    named: np.ndarray

    @property
    def depth(self) -> int:
        return int(np.diff(self.at).max(initial=0))

    def suffixes(self, window: int) -> Block:
        sizes = np.diff(self.at)
        begin = np.arange(len(self.words))
        end, item, named = (np.repeat(x, sizes) for x in (self.at[1:], self.item, self.named))
        return Block(self.words, begin, end, item, named, begin - np.repeat(self.at[:-1], sizes), window)


def items_of(items: list[tuple[int | None, str | None]]) -> Items:
    words, at = word_sequence(*utf8_parts(pa.array([t or "" for _, t in items], pa.string())))
    return Items(words, at, np.array([i or 0 for i, _ in items], np.int64), np.array([i is not None for i, _ in items], bool))


def blocks_of(benchmark: DataFrame) -> Iterator[tuple[int, Items]]:
    """The benchmark in blocks of at most ``BLOCK_WORDS`` characters (or one longer item), with their characters, a partition at a time."""
    rows, size = [], 0
    clean = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text")
    for item, text in clean.toLocalIterator():
        if rows and size + len(text) > BLOCK_WORDS:
            yield size, items_of(rows)
            rows, size = [], 0
        rows.append((item, text))
        size += len(text)
    if rows:
        yield size, items_of(rows)


def rounds_of(benchmark: DataFrame) -> Iterator[tuple[list[Items], bool]]:
    """Blocks of at most ``ROUND_WORDS`` characters together, and whether more follow; one empty round without items."""
    group, total = [], 0
    for size, block in blocks_of(benchmark):
        if group and total + size > ROUND_WORDS:
            yield group, True
            group, total = [], 0
        group.append(block)
        total += size
    yield group, False


class Piece:
    """A sorted piece of a shard and the binary searches over it."""

    def __init__(self, words: np.ndarray, depth: int):
        self.words = np.append(words, SEPARATOR)
        self.sequence = Sequence(self.words)
        self.order = suffix_array(words, depth)

    def bound(self, block: Block, which: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
        """First place whose suffix is not below (``after``: is above) the first ``size`` words of each suffix asked for."""
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            places, begins = self.order[middle], block.begin[which[open_]]
            same = common(self.sequence, places, block.sequence, begins, size[open_])
            # Past the end of the block only what is the same as a whole is read.
            here, there = self.words[np.minimum(places + same, len(self.words) - 1)], block.words[np.minimum(begins + same, len(block.words) - 1)]
            below = np.where(same == size[open_], after, here < there)
            low[open_] = np.where(below, middle + 1, low[open_])
            high[open_] = np.where(below, high[open_], middle)
            open_ = open_[low[open_] < high[open_]]
        return low

    def ranges(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Benchmark suffixes whose window occurs, with the range of places in suffix order."""
        size = block.needed()
        which = np.flatnonzero(size)
        first = self.words[self.order]
        low = np.searchsorted(first, block.words[block.begin[which]])
        high = np.searchsorted(first, block.words[block.begin[which]], "right")
        which, low, high = (x[low < high] for x in (which, low, high))
        start = self.bound(block, which, size[which], low, high, False)
        stop = self.bound(block, which, size[which], start, high, True)
        some = start < stop
        return which[some], start[some], stop[some]

    def longest(self, block: Block, which: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest verbatim match of each suffix found: beside where it would stand itself."""
        size = (block.end - block.begin)[which]
        at = self.bound(block, which, size, start, stop, False)
        best, place = np.zeros(len(which), np.int64), np.zeros(len(which), np.int64)
        for near in (np.maximum(at - 1, start), np.minimum(at, stop - 1)):
            length = common(self.sequence, self.order[near], block.sequence, block.begin[which], size)
            place = np.where(length > best, self.order[near], place)
            best = np.maximum(best, length)
        return best, place


def _shard(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch with a separator after every row; offsets of rows with and without separators."""
    words, at = word_sequence(*utf8_parts(texts))
    rows = len(at) - 1
    spread = np.full(len(words) + rows, SEPARATOR)
    spread[np.arange(len(words)) + np.repeat(np.arange(rows), np.diff(at))] = words
    return spread, at + np.arange(rows + 1), at


def _pieces(words: np.ndarray, depth: int) -> Iterator[tuple[int, Piece]]:
    for begin in range(0, len(words), PIECE_WORDS):
        yield begin, Piece(words[begin : begin + PIECE_WORDS + depth], depth)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Longest:
    """The longest verbatim match of every row of a shard and its first place."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.sequence, self.at = Sequence(words), at
        self.size, self.place = (np.zeros(len(at) - 1, np.int64) for _ in range(2))

    def add(self, block: Block, which: int, places: np.ndarray) -> None:
        """Matches of one benchmark suffix that begin at these places, if no word before both could join them."""
        begin, size = block.begin[which], block.end[which] - block.begin[which]
        if block.place[which]:
            before = np.where(places > 0, self.sequence.words[places - 1], SEPARATOR)
            places = places[before != block.words[begin - 1]]
        for first in range(0, len(places), PAIRS):
            some = places[first : first + PAIRS]
            n = common(self.sequence, some, block.sequence, np.full(len(some), begin), np.full(len(some), size))
            row = np.searchsorted(self.at, some, "right") - 1
            # The longest of each row, the first of equal ones.
            order = np.lexsort([some, -n, row])
            row, n, some = row[order], n[order], some[order]
            best = np.append(True, row[1:] != row[:-1])[: len(row)]
            row, n, some = row[best], n[best], some[best] - self.at[row[best]]
            better = (n > self.size[row]) | ((n == self.size[row]) & (some < self.place[row]))
            self.size[row[better]], self.place[row[better]] = n[better], some[better]


def _hits(group: list[Items], window: int, texts: pa.Array):
    """Words of every row, runs of hit words, the items found and the longest match."""
    words, at, plain = _shard(texts)
    change = np.zeros(len(words) + 1, np.int64)
    rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    longest = Longest(words, at)
    depth = max((block.depth for block in group), default=0)
    for begin, piece in _pieces(words, depth) if depth else ():
        for sent in group:
            block = sent.suffixes(window)
            needed = block.needed()
            which, start, stop = piece.ranges(block)
            for w, a, b in zip(which.tolist(), start.tolist(), stop.tolist(), strict=True):
                places = begin + piece.order[a:b]
                np.add.at(change, places, 1)
                np.subtract.at(change, places + needed[w], 1)
                longest.add(block, w, places)
                if block.named[w]:
                    found = np.unique(np.searchsorted(at, places, "right") - 1)
                    rows.append(found)
                    items.append(np.full(len(found), block.item[w]))
    hit = np.cumsum(change[:-1]) > 0
    edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    of_row = np.searchsorted(at, begins, "right") - 1
    runs: list[list] = [[] for _ in range(len(texts))]
    for r, a, b in zip(of_row.tolist(), (begins - at[of_row]).tolist(), (ends - at[of_row]).tolist(), strict=True):
        runs[r].append({"start": a, "end": b})
    pairs = np.unique(np.column_stack([np.concatenate(rows), np.concatenate(items)]), axis=0)
    found_items: list[list] = [[] for _ in range(len(texts))]
    for r, i in pairs.tolist():
        found_items[r].append(i)
    return np.diff(plain), runs, found_items, longest.size, longest.place


FOUND = "__n_words bigint, __runs array<struct<start:bigint,end:bigint>>, __items array<bigint>, __longest bigint, __longest_at bigint"


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows with all columns and ``__n_words, __n_hit, __runs, __items, __longest, __longest_at``: hit words as
    runs of word positions, the items whose windows occur, and words and place of the longest verbatim match."""
    bounded_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    at = docs.columns.index("text")
    names = docs.columns + [c.split()[0] for c in FOUND.split(", ")]
    schema = StructType(docs.schema.fields + StructType.fromDDL(FOUND).fields)
    out = docs
    for k, (group, follows) in enumerate(rounds_of(benchmark)):
        sent = sc.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, more=k > 0) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                n, runs, items, size, place = _hits(sent.value, window, batch.column(at))
                columns = batch.columns
                if more:
                    _, old_runs, old_items, old_size, old_place = columns[-5:]
                    runs = [a + b for a, b in zip(old_runs.to_pylist(), runs, strict=True)]
                    items = [a + b for a, b in zip(old_items.to_pylist(), items, strict=True)]
                    old_size, old_place = old_size.to_numpy(), old_place.fill_null(0).to_numpy()
                    kept = (old_size > size) | ((old_size == size) & (old_place < place))
                    size, place = np.where(kept, old_size, size), np.where(kept, old_place, place)
                    columns = columns[:-5]
                found = [pa.array(n, pa.int64()), pa.array(runs, RUNS), pa.array(items, pa.list_(pa.int64())), pa.array(size), pa.array(place, mask=size == 0)]
                yield pa.RecordBatch.from_arrays([*columns, *found], names)

        out = out.mapInArrow(run, schema)
        if follows:
            out = materialise(out, "hits")
            sent.destroy()
    # Runs of several blocks may overlap: only what lies beyond the furthest end so far counts.
    start = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    merged = F.aggregate(F.array_sort("__runs"), start, lambda acc, r: F.struct(
        F.greatest(acc["end"], r["end"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["end"] - F.greatest(acc["end"], r["start"]))).alias("n")))
    return out.withColumn("__n_hit", merged["n"]).withColumn("__items", F.array_distinct("__items"))


def _contaminated(share: int):
    return (F.col("__n_hit") > 0) & (share * F.col("__n_hit") >= F.col("__n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """The rows, with their columns, that are not contaminated; the columns may have any names."""
    plain = docs.toDF(*(c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)))
    return mark(plain, benchmark, window).filter(~_contaminated(share)).select(*plain.columns).toDF(*docs.columns)


def occurrences(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``doc_id, n_words, n_hit, runs, items, longest, longest_at, contaminated`` of every document."""
    found = mark(texts_of(docs), benchmark, window)
    return found.select("doc_id", *(F.col(f"__{c}").alias(c) for c in ("n_words", "n_hit", "runs", "items", "longest", "longest_at")), _contaminated(SHARE).alias("contaminated"))


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Counts of hit words, the digest of the items found and the longest verbatim match, one row per document."""
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return occurrences(docs, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), "contaminated",
        "longest", "longest_at")


def longest_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows ``item_id, place, n_words, doc_id, at``: for every benchmark suffix with a window in the documents its
    longest verbatim match and where that is (smallest document and word position among equals). Items with a
    null id share it."""
    sc = docs.sparkSession.sparkContext
    parts = []
    for group, follows in rounds_of(benchmark):
        sent = sc.broadcast(group)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            depth = max((items.depth for items in sent.value), default=0)
            for batch in slices(batches):
                words, at, _ = _shard(batch.column(1))
                for begin, piece in _pieces(words, depth) if depth else ():
                    for items in sent.value:
                        block = items.suffixes(window)
                        which, start, stop = piece.ranges(block)
                        best, _ = piece.longest(block, which, start, stop)
                        for w, a, b, size in zip(which.tolist(), start.tolist(), stop.tolist(), best.tolist(), strict=True):
                            places = piece.order[a:b]
                            if len(places) > 1:
                                same = common(piece.sequence, places, block.sequence, np.full(len(places), block.begin[w]), np.full(len(places), size))
                                places = places[same == size]
                            places = begin + places
                            row = np.searchsorted(at, places, "right") - 1
                            ids = batch.column(0).take(pa.array(row))
                            n = len(places)
                            item = pa.array([int(block.item[w]) if block.named[w] else None] * n, pa.int64())
                            columns = [np.full(n, block.place[w]), np.full(n, size), ids, places - at[row]]
                            yield pa.RecordBatch.from_arrays([item, *(pa.array(c, pa.int64()) for c in columns)], ["item_id", "place", "n_words", "doc_id", "at"])

        part = texts_of(docs).mapInArrow(run, "item_id bigint, place bigint, n_words bigint, doc_id bigint, at bigint")
        if follows:
            part = materialise(part, "matches")
            sent.destroy()
        parts.append(part)
    spark = docs.sparkSession
    found = spark.createDataFrame([], "item_id bigint, place bigint, n_words bigint, doc_id bigint, at bigint")
    for part in parts:
        found = found.unionByName(part)
    order = F.struct("n_words", (-F.col("doc_id")).alias("d"), (-F.col("at")).alias("a"))
    return found.groupBy("item_id", "place").agg(F.max(order).alias("best")).select(
        "item_id", "place", "best.n_words", (-F.col("best.d")).alias("doc_id"), (-F.col("best.a")).alias("at"))
