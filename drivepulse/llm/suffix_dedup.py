"""Removal of repeated passages by longest-previous-factor arrays over sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one. Sorting all suffixes of a corpus in one place is out of
reach, so strings are dealt to shards by their content first.

1. The anchor of a string is the 32-byte gram in it with the smallest hash. Consecutive starts share
   an anchor; such a run with the bytes that its strings cover is a context. Equal strings have
   equal anchors, so both are found under the same one. An anchor that occurs once in the corpus has
   no repeated string; these are most, and counting needs only hashes.
2. The contexts of repeated anchors are dealt to shards by anchor. Contexts equal in all bytes are
   one text: the earliest stays, the others are repeated as a whole. The suffixes of the rest are
   sorted to ``LENGTH`` bytes; the previous and the next smaller position in this order are the
   earlier places that share most with a suffix, which gives the longest previous factor of every
   start. Starts with at least ``LENGTH`` are repeated.
3. An anchor with more than ``GROUP_ROWS`` occurrences is dealt to several shards by document. What
   is first in its shard goes on as hash and position, and the earliest position of each string over
   all shards stays (aggregated before it is shuffled).
4. The repeated starts of each document are joined to it and the bytes taken out.

Null text counts as empty. Rows that repeat an id and a text are one document, each with its result.
Rows with one id and different texts, and rows with a null id (these first), are documents in order
of their text's hash. Texts below ``LENGTH`` bytes keep all. A long text is read in overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from drivepulse.llm.common import BYTE_WORDS, KEYED, keyed_rows, mix, ragged, shared_pairs, slices, utf8_parts
from drivepulse.session import materialise

LENGTH = 100
GRAM = 32
# Grams that a string holds.
REACH = LENGTH - GRAM + 1
GROUP_ROWS = 2_048
PIECE = 1 << 20
SHARD_BYTES = 2 << 20
POSITION_BITS = np.uint64(21)
STEP = np.uint64(0xD1342543DE82EF95)
BACK = np.uint64(pow(int(STEP), -1, 1 << 64))


def numbered(docs: DataFrame) -> DataFrame:
    """``doc, doc_id, text`` with numbers ``doc`` in the order of documents, different for different documents."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    tags = rows.select("doc_id", F.xxhash64("text").alias("tag"))
    doubtful = tags.groupBy("doc_id").agg(F.min("tag").alias("a"), F.max("tag").alias("b")).filter("a <> b OR doc_id IS NULL")
    if doubtful.isEmpty():
        return rows.select(F.col("doc_id").alias("doc"), "doc_id", "text")
    # Numbers grow along the sorted order; written once, so that they stay.
    order = materialise(tags.distinct().orderBy(F.asc_nulls_first("doc_id"), "tag").withColumn("doc", F.monotonically_increasing_id()), "order")
    order = order.select("doc", F.col("doc_id").alias("id"), "tag")
    joined = rows.withColumn("hash", F.xxhash64("text")).join(order, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("tag")))
    return joined.select("doc", "doc_id", "text")


class Powers:
    """Powers of the hash step and of its inverse; grown once per process."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) <= n:
            cls.up = STEP ** np.arange(n + 1, dtype=np.uint64)
            cls.down = BACK ** np.arange(n + 1, dtype=np.uint64)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    Powers.reach(len(data))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_WORDS[data] * Powers.up[: len(data)], dtype=np.uint64)])


def range_hash(sums: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hash of the bytes first:last of each range, wherever they stand."""
    return mix((sums[last] - sums[first]) * Powers.down[first] + (last - first).astype(np.uint64))


def contexts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of string starts with one anchor: row, start in ``data``, number of starts, anchor hash.

    Starts of all rows of ``data``; a string lies in one row.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(np.uint64)
    gram = BYTE_WORDS[data]
    size, power = 1, STEP
    while size < GRAM:
        gram = gram[:-size] + power * gram[size:]
        power, size = np.uint64(pow(int(STEP), 2 * size, 1 << 64)), 2 * size
    gram = mix(gram)
    # High bits of the hash, then the position: the smallest is the first gram with the smallest hash.
    low = gram >> POSITION_BITS << POSITION_BITS | np.arange(len(gram), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    rest = REACH - size
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    # low[i] stands for the string at i.
    starts = len(low)
    left = np.repeat(offsets[1:], np.diff(offsets))[:starts] - np.arange(starts)
    valid = left >= LENGTH
    begins = valid.copy()
    begins[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    first = np.flatnonzero(begins)
    ends = np.flatnonzero(np.append(valid[:-1] & (~valid[1:] | begins[1:]), valid[-1])) + 1
    anchor = gram[(low[first] & ((np.uint64(1) << POSITION_BITS) - np.uint64(1))).astype(np.int64)]
    return np.searchsorted(offsets, first, "right") - 1, first, ends - first, anchor


def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, place of its first byte in the row, bytes and offsets of parts of at most about ``PIECE`` bytes.

    A longer row comes in pieces that overlap by all but one byte of a string, so each string is in one piece.
    """
    row = 0
    while row < len(offsets) - 1:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + PIECE, "right")) - 1)
        if last == row + 1 and offsets[last] - offsets[row] > PIECE:
            for at in range(0, int(offsets[last] - offsets[row]) - LENGTH + 1, PIECE):
                part = data[offsets[row] + at : min(offsets[last], offsets[row] + at + PIECE + LENGTH - 1)]
                yield row, at, part, np.array([0, len(part)])
        else:
            yield row, 0, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def anchors(docs: DataFrame) -> DataFrame:
    """The anchors of all documents as rows for :func:`shared_pairs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found_keys, found_docs = [], []
        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            for row, _, data, offsets in pieces(*utf8_parts(batch.column(1))):
                of_row, _, _, anchor = contexts(data, offsets)
                found_keys.append(anchor.astype(np.int64))
                found_docs.append(ids[row + of_row])
        if found_keys:
            yield keyed_rows(np.concatenate(found_keys), np.concatenate(found_docs))

    return docs.select("doc", "text").mapInArrow(run, KEYED)


CONTEXTS = "part bigint, anchor bigint, context bigint, doc bigint, start bigint, n int, salts int, bytes binary"


def repeated_contexts(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """The contexts of the shared anchors of each document.

    Of equal contexts in one task only the earliest keeps its bytes; the others come without, and are
    repeated as a whole.
    """
    # At most one key in GROUP_ROWS pairs; written, so that the planner knows the size and broadcasts only a small table.
    hot = materialise(shared.filter("doc IS NULL").select(F.col("key").alias("hot"), F.ceil(F.col("n") / GROUP_ROWS).cast("long").alias("split")), "hot")
    pairs = shared.filter("doc IS NOT NULL")
    pairs = pairs.join(hot, pairs.key == hot.hot, "left").select("doc", "key", F.coalesce("split", F.lit(1)).alias("salts"))
    lists = pairs.groupBy("doc").agg(F.collect_set(F.struct("key", "salts")).alias("keys"))
    lists = lists.select(F.col("doc").alias("of"), F.col("keys.key").alias("keys"), F.col("keys.salts").alias("salts"))
    # A document and its repeated rows have the same contexts.
    joined = docs.join(lists, docs.doc == lists.of).select("doc", "text", "keys", "salts")
    names = [f.split()[0] for f in CONTEXTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, size=8 << 20):
            parts, datas = [], []
            ids = batch.column(0).to_numpy()
            keys, salts = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            bounds = np.concatenate([[0], np.cumsum(pa.compute.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False))])
            for row, place, data, offsets in pieces(*utf8_parts(batch.column(1))):
                of_row, first, n, anchor = contexts(data, offsets)
                rows = len(offsets) - 1
                a, b = bounds[row], bounds[row + rows]
                # Members of the row's own list only: row and key are looked up as one pair.
                own = np.repeat(np.arange(rows), np.diff(bounds[row : row + rows + 1]))
                wanted = mix(keys[a:b].astype(np.uint64)) + own.astype(np.uint64)
                order = np.argsort(wanted)
                asked = mix(anchor) + of_row.astype(np.uint64)
                spot = np.minimum(np.searchsorted(wanted[order], asked), max(0, b - a - 1))
                kept = wanted[order][spot] == asked if b > a else np.zeros(len(asked), bool)
                if kept.any():
                    of_row, first, n, anchor, spot = (x[kept] for x in (of_row, first, n, anchor, spot))
                    text = range_hash(prefix_sums(data), first, first + n + LENGTH - 1).astype(np.int64)
                    start = first - offsets[of_row] + place
                    parts.append((anchor.astype(np.int64), text, ids[row + of_row], start, n, salts[a:b][order][spot], first, np.full(len(first), len(datas))))
                    datas.append(data)
            if parts:
                yield from send(datas, *(np.concatenate(c) for c in zip(*parts, strict=True)))

    def send(datas, anchor, text, doc, start, n, salt, first, piece):
        """Contexts with bytes, and joined runs of those that are repeated as a whole."""
        order = np.lexsort([start, doc, text, anchor])
        fresh = np.ones(len(order), bool)
        fresh[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        gone = np.sort(order[~fresh & ~_same_place(fresh, doc[order], start[order])])
        if len(gone):
            d, s, size = doc[gone], start[gone], n[gone]
            head = np.append(True, (d[1:] != d[:-1]) | (s[1:] != s[:-1] + size[:-1]))
            at = np.flatnonzero(head)
            d, s, size = d[at], s[at], np.add.reduceat(size, at)
            nothing = np.zeros(len(at), np.int64)
            columns = [mix((d + s).astype(np.uint64)).astype(np.int64), nothing, nothing, d, s, size.astype(np.int32), nothing.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.nulls(len(at), pa.binary())], names)
        kept = np.sort(order[fresh])
        anchor, text, doc, start, n, salt, first, piece = (x[kept] for x in (anchor, text, doc, start, n, salt, first, piece))
        spread = mix(doc.astype(np.uint64)) % np.maximum(1, salt).astype(np.uint64)
        part = (mix(anchor.astype(np.uint64)) + spread).astype(np.int64)
        for k, data in enumerate(datas):
            here = np.flatnonzero(piece == k)
            size = n[here] + LENGTH - 1
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(cut), pa.py_buffer(data[ragged(first[here], size)])])
            arrays = [part[here], anchor[here], text[here], doc[here], start[here], n[here].astype(np.int32), salt[here].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, arrays), column], names)

    return joined.mapInArrow(run, CONTEXTS)


def _same_place(fresh: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Rows after the first of their group (``fresh``) that have the same document and start as the first."""
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(fresh)), 0)) if len(fresh) else np.zeros(0, int)
    return ~fresh & (doc == doc[first]) & (start == start[first])


def sorted_starts(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of ``starts`` by their first ``LENGTH`` bytes (equal ones in the order given) and the common
    prefix, up to ``LENGTH``, of each with the one before it."""
    padded = np.concatenate([data, np.zeros(LENGTH + 8, np.uint8)])
    word, size = padded.astype(np.uint64), 1
    while size < 8:  # eight bytes from every position, the first one highest
        word = (word[:-size] << np.uint64(8 * size)) | word[size:]
        size *= 2
    n = len(starts)
    order = np.argsort(word[starts], kind="stable")
    group = np.zeros(n, np.int64)
    common = np.zeros(n, np.int64)
    tied, begin = order, np.zeros(n, np.int64)
    for depth in range(0, LENGTH, 8):
        key = word[starts[tied] + depth]
        if depth + 8 > LENGTH:
            key = key >> np.uint64(8 * (depth + 8 - LENGTH))
        if depth:
            resort = np.lexsort([key, group[tied]])
            order[begin[: len(tied)]] = tied = tied[resort]
            key = key[resort]
        place = begin[: len(tied)]
        same_group = np.zeros(len(tied), bool)
        same_group[1:] = group[tied[1:]] == group[tied[:-1]]
        if not depth:
            same_group[1:] = True
            place = np.arange(n)
        differ = np.ones(len(tied), bool)
        if len(tied) > 1:
            changed = key[1:] ^ key[:-1]
            differ[1:] = changed != 0
            width = min(8, LENGTH - depth)
            # Equal bytes before the first that differs.
            lead = np.zeros(len(changed), np.int64)
            for k in range(1, width + 1):
                lead += (changed >> np.uint64(8 * (width - k))) == 0
            common[place[1:][same_group[1:]]] += lead[same_group[1:]]
        head = differ | ~same_group
        group[tied] = place[np.maximum.accumulate(np.where(head, np.arange(len(tied)), 0))]
        alone = head & np.append(head[1:], True)
        tied, begin = tied[~alone], place[~alone]
        if not len(tied):
            break
    return order, common


def longest_previous(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of every element, given the suffix order and the common prefixes of neighbours.

    Positions are the element numbers. The previous (next) smaller position in suffix order is found by
    following candidates of candidates, with the smallest common prefix on the way.
    """
    n = len(order)
    best = np.zeros(n, np.int64)
    for backwards in (False, True):
        position = order[::-1] if backwards else order
        prefix = np.concatenate([[0], common[:0:-1]]) if backwards else common
        candidate = np.arange(n) - 1
        shared = prefix.copy()
        open_ = np.flatnonzero(candidate >= 0)
        open_ = open_[position[candidate[open_]] > position[open_]]
        while len(open_):
            via = candidate[open_]
            shared[open_] = np.minimum(shared[open_], shared[via])
            candidate[open_] = candidate[via]
            open_ = open_[candidate[open_] >= 0]
            open_ = open_[position[candidate[open_]] > position[open_]]
        shared[candidate < 0] = 0
        best[position] = np.maximum(best[position], shared)
    return best


REPEATS = "doc bigint, start bigint, n int, string bigint, string2 bigint"


def repeated_starts(found: DataFrame) -> DataFrame:
    """Rows ``doc, start, n``: runs of repeated starts; and, with ``string`` hashes, first starts of split anchors."""
    names = [f.split()[0] for f in REPEATS.split(", ")]

    def rows(doc, start, n, string=None, second=None):
        nothing = pa.nulls(len(doc), pa.int64())
        hashes = [nothing, nothing] if string is None else [pa.array(string.astype(np.int64)), pa.array(second.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start), pa.array(np.asarray(n, np.int32)), *hashes], names)

    def solve(table: pa.Table):
        """Whole groups of an anchor, in the order of anchor, document and start."""
        doc, start, n, salts = (table.column(c).to_numpy() for c in ("doc", "start", "n", "salts"))
        data, offsets = utf8_parts(table.column("bytes"))
        owner = np.repeat(np.arange(len(doc)), n)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        starts = offsets[owner] + inner
        order_of_position = np.lexsort([start[owner] + inner, doc[owner]])
        owner, inner, starts = owner[order_of_position], inner[order_of_position], starts[order_of_position]
        order, common = sorted_starts(data, starts)
        again = longest_previous(order, common) >= LENGTH
        at = start[owner] + inner
        yield rows(*_runs(doc[owner[again]], at[again]))
        split = ~again & (salts[owner] > 1)
        if split.any():
            sums = prefix_sums(data)
            first = starts[split]
            yield rows(doc[owner[split]], at[split], np.ones(len(first)), range_hash(sums, first, first + LENGTH),
                       range_hash(sums, first, first + LENGTH - 1) ^ data[first + LENGTH - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            dropped = batch.column(7).is_null()
            gone = batch.filter(dropped)
            yield rows(*(gone.column(k).to_numpy() for k in (3, 4, 5)))
            held.append(batch.filter(pa.compute.invert(dropped)))
        held = [b for b in held if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        anchor, text, doc, start = (table.column(c).to_numpy() for c in ("anchor", "context", "doc", "start"))
        order = np.lexsort([start, doc, text, anchor])
        fresh = np.ones(len(order), bool)
        fresh[1:] = (anchor[order[1:]] != anchor[order[:-1]]) | (text[order[1:]] != text[order[:-1]])
        gone = table.take(pa.array(order[~fresh & ~_same_place(fresh, doc[order], start[order])]))
        yield rows(*(gone.column(c).to_numpy() for c in ("doc", "start", "n")))
        order = order[fresh]
        # Anchors whose contexts are all equal are done, unless other shards have more of them.
        new = np.ones(len(order), bool)
        new[1:] = anchor[order[1:]] != anchor[order[:-1]]
        lonely = new & np.append(new[1:], True) & (table.column("salts").to_numpy()[order] <= 1)
        order, new = order[~lonely], new[~lonely]
        if not len(order):
            return
        size = np.cumsum(table.column("n").to_numpy()[order] + LENGTH)
        heads = np.append(np.flatnonzero(new), len(order))
        first = 0
        while first < len(heads) - 1:
            done = size[heads[first] - 1] if heads[first] else 0
            last = max(first + 1, int(np.searchsorted(size[heads[1:] - 1], done + SHARD_BYTES, "right")))
            yield from solve(table.take(pa.array(order[heads[first] : heads[last]])).combine_chunks())
            first = last

    return found.repartition("part").mapInArrow(run, REPEATS)


def _runs(doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Consecutive starts of a document as runs; starts are in order."""
    fresh = np.ones(len(at), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(fresh)
    return doc[first], at[first], np.diff(np.append(first, len(at)))


def repeats(docs: DataFrame) -> DataFrame:
    """Rows ``doc, start, n`` for :func:`numbered` documents: every string of these starts also starts earlier."""
    shared = materialise(shared_pairs(anchors(docs), GROUP_ROWS), "anchors")
    found = materialise(repeated_starts(repeated_contexts(docs, shared)), "starts")
    sure = found.filter("string IS NULL").select("doc", "start", "n")
    split = found.filter("string IS NOT NULL")
    first = split.groupBy("string", "string2").agg(F.min(F.struct("doc", "start")).alias("first"))
    later = split.join(first, ["string", "string2"]).filter((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return sure.unionByName(later.select("doc", "start", "n"))


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows ``doc_id, n_bytes, spans, kept``: removed runs of bytes and what is left of every document."""
    runs = found.groupBy(F.col("doc").alias("of")).agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    runs = runs.select("of", F.col("runs.start").alias("starts"), F.col("runs.n").alias("sizes"))
    joined = docs.join(runs, docs.doc == runs.of, "left").select("doc_id", "text", "starts", "sizes")
    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans, kept = [], []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for text, starts, sizes in zip(texts, batch.column(2), batch.column(3), strict=True):
                merged: list[list[int]] = []
                if starts.is_valid:
                    a = starts.values.to_numpy()
                    b = a + sizes.values.to_numpy() + LENGTH - 1
                    order = np.argsort(a)
                    a, b = a[order], np.maximum.accumulate(b[order])
                    head = np.append(True, a[1:] > b[:-1])
                    merged = np.column_stack([a[head], b[np.append(np.flatnonzero(head)[1:] - 1, len(a) - 1)]]).tolist()
                left, done = [], 0
                for a, b in merged:
                    left.append(text[done:a])
                    done = b
                kept.append(b"".join([*left, text[done:]]) if merged else text)
                spans.append([{"start": a, "end": b} for a, b in merged])
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` of every document."""
    rows = numbered(docs)
    return cut_out(rows, repeats(rows))


def report(docs: DataFrame) -> DataFrame:
    """Counts and the digest of the kept bytes of every document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return deduplicate(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
