"""The trie of all conversation prefixes, by ROLLUP over columns of turn ids.

A conversation is cut into blocks of ``BLOCK`` turns, a column each. One ROLLUP over (block, node
before the block), turn 1, turn 2, ... aggregates the prefixes of every depth together; grouping_id
tells how deep a row reaches. The node before the block is named by two 64-bit sums (exclusive or)
of the hashes of its turns with their places, which a running window brings along; so all blocks of
all conversations go through the same aggregate, however long they are.

A node is owned by its smallest member, which owns all of its own nodes below as well. So the depth
from which a conversation owns its nodes says everything about subtrees: it repeats the words of the
turns before that depth, and it ends a leaf if nothing goes on there. Sums of these over the members
are the subtree's, and a second ROLLUP gives them without a walk along the tree.

Turns are in order of ``turn`` (null first), then role, then MD5 of role and text, which is also the
turn's id. Null roles and texts are empty, repeated rows stay, rows without a ``conv_id`` belong to no
conversation, other columns are not read, an empty table has no nodes. A conversation is ordered in
one task, without its texts and with spilling; the digest of the ids that end at a node is
sequential by nature and reads them in slices.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.session import materialise

# Turns of a block.
BLOCK = 4
# Ids of a slice: 2 to this power.
SLICE_BITS = 10
# A node to which more than this share of the attached conversations belong is looked up by broadcast; there are fewer than so many.
HOT_NODES = 256
# Conversations that share an opening, and turns of the opening, at most.
FAMILY, OPENING = 20, 3
WORD = r"[^\x20\x09-\x0D]+"
TURNS = [f"t{i + 1}" for i in range(BLOCK)]
KEY = ["depth", "ka", "kb"]


def turn_rows(turns: DataFrame) -> DataFrame:
    """Rows ``conv_id, pos, id, words`` (pos from 1) from ``conv_id, turn, role, text``."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    name = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    cut = turns.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), name.alias("id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id"))
    return cut.select("conv_id", place.cast("long").alias("pos"), "id", "words")


def members_of(rows: DataFrame) -> DataFrame:
    """Rows ``conv_id, len`` of conversations as they are."""
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("len"))


def shared_openings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turn rows and members of rebuilt conversations.

    Conversation c gets the first h turns of c - c % 20, h = crc32(c) % 4, then its own after its first h.
    """
    own = members_of(rows)
    convs = own.select(
        "conv_id", F.col("len").alias("n"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (OPENING + 1)).alias("h"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = materialise(convs.select("conv_id", "n", "base", "h", "taken"), "convs")
    heads = rows.filter(F.col("pos") <= OPENING).withColumnRenamed("conv_id", "base").join(convs, "base").filter("pos <= taken")
    tails = rows.join(convs, "conv_id").filter("pos > h").withColumn("pos", F.col("pos") - F.col("h") + F.col("taken"))
    rebuilt = heads.select("conv_id", "pos", "id", "words").unionByName(tails.select("conv_id", "pos", "id", "words"))
    return rebuilt, convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("len"))


def _blocks(rows: DataFrame, members: DataFrame) -> DataFrame:
    """A row for every block of every conversation; an empty one has one block without turns."""
    along = Window.partitionBy("conv_id").orderBy("pos")
    before = along.rowsBetween(Window.unboundedPreceding, -1)

    def earlier(seed: int) -> Column:
        return F.coalesce(F.bit_xor(F.xxhash64(F.lit(seed), "pos", "id")).over(before), F.lit(0).cast("long"))

    cut = rows.select(
        "conv_id", "pos", ((F.col("pos") - 1) / BLOCK).cast("long").alias("block"), earlier(1).alias("prior1"), earlier(2).alias("prior2"),
        F.coalesce(F.sum("words").over(before), F.lit(0)).alias("before"),
        *[F.lead("id", i).over(along).alias(t) for i, t in enumerate(TURNS)],
        F.array(*[F.coalesce(F.lead("words", i).over(along), F.lit(0)) for i in range(BLOCK)]).alias("words"))
    cut = cut.filter((F.col("pos") - 1) % BLOCK == 0).drop("pos").join(members, "conv_id")
    zero = F.lit(0).cast("long")
    empty = members.filter("len = 0").select(
        "conv_id", zero.alias("block"), zero.alias("prior1"), zero.alias("prior2"), zero.alias("before"),
        *[F.lit(None).cast("binary").alias(t) for t in TURNS], F.array_repeat(zero, BLOCK).alias("words"), "len")
    return cut.unionByName(empty)


def _rolled(blocks: DataFrame, sums: str) -> DataFrame:
    """Rows ``block, k, depth, ka, kb`` and the aggregates ``sums`` of every prefix; (ka, kb) names the node."""
    turns = ", ".join(TURNS)
    rolled = blocks.sparkSession.sql(
        f"SELECT block, prior1, prior2, {turns}, {BLOCK} - bit_count(grouping_id()) AS k, {sums} "
        f"FROM {{blocks}} GROUP BY ROLLUP((block, prior1, prior2), {turns})", blocks=blocks)
    # A row that reaches further than the conversations of its group do names no node; the node before a block is the last one of the block before.
    filled = sum((F.col(t).isNotNull().cast("int") for t in TURNS), F.lit(0))
    nodes = rolled.filter((F.col("k") >= 0) & (filled == F.col("k")) & ((F.col("k") > 0) | (F.col("block") == 0)))
    ka, kb = _names(F.col("k"))
    return nodes.withColumns({"depth": F.col("block") * BLOCK + F.col("k"), "ka": ka, "kb": kb}).drop("prior1", "prior2", *TURNS)


def _names(k: Column) -> list[Column]:
    """Two hashes of the node that the first k turns of a block lead to."""
    turns = [F.when(k > i, F.col(t)) for i, t in enumerate(TURNS)]
    return [F.xxhash64(F.lit(seed), "prior1", "prior2", *turns) for seed in (1, 2)]


def _first_words(k: Column) -> Column:
    """Words of the first k turns of a block."""
    return F.aggregate(F.slice("words", F.lit(1), F.greatest(F.lit(0), F.least(F.lit(BLOCK), k)).cast("int")), F.lit(0).cast("long"), lambda a, x: a + x)


def _at(depth: Column) -> tuple[Column, Column]:
    """Block that holds the node at a depth, and the node's turn in it."""
    block = F.greatest(F.lit(0).cast("long"), ((depth - 1) / BLOCK).cast("long"))
    return block, depth - block * BLOCK


def _named(blocks: DataFrame, depth: Column) -> DataFrame:
    """Rows ``conv_id, depth, ka, kb``: the node of every conversation at a depth of its own."""
    block, k = _at(depth)
    ka, kb = _names(k)
    return blocks.filter(F.col("block") == block).select("conv_id", depth.alias("depth"), ka.alias("ka"), kb.alias("kb"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the slices of each node, read in their order."""
    name, state = None, None
    for batch in batches:
        done = []
        for *key, ids in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
            if key != name:
                if state:
                    done.append((*name, state.hexdigest()))
                name, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], [*KEY, "ends_sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*name, state.hexdigest())], [*KEY, "ends_sha256"])


def _ends(blocks: DataFrame) -> DataFrame:
    """Digest of the ids that end at each node."""
    ends = _named(blocks, F.col("len")).withColumn("slice", F.shiftright("conv_id", SLICE_BITS))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    slices = ends.groupBy(*KEY, "slice").agg(ids.alias("ids"))
    ordered = slices.repartition(*KEY).sortWithinPartitions(*KEY, "slice").select(*KEY, "ids")
    return ordered.mapInArrow(_digest, "depth bigint, ka bigint, kb bigint, ends_sha256 string")


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """Every node of the trie of the conversations: from turn rows and ``conv_id, len``.

    Columns ``conv_id`` (smallest member), ``depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens`` (words that members after the first repeat in the subtree), ``ends_sha256``.
    """
    blocks = materialise(_blocks(rows, members), "blocks")
    first = _rolled(blocks, "min(conv_id) AS conv_id, max(len) AS longest")
    # The owner of a node without children is as long as the node is deep.
    owners = first.groupBy("conv_id").agg(F.min("depth").alias("own"), F.max((F.col("depth") == F.col("longest")).cast("long")).alias("leaf"))
    owned = blocks.join(owners, "conv_id", "left").withColumns({
        "own": F.coalesce("own", F.col("len") + 1), "leaf": F.coalesce("leaf", F.lit(0).cast("long"))})
    # Words of the turns before the own nodes.
    repeated = F.sum(_first_words(F.col("own") - 1 - F.col("block") * BLOCK)).over(Window.partitionBy("conv_id"))
    owned = materialise(owned.withColumn("repeated", repeated), "owned")
    nodes = materialise(_rolled(
        owned, "min(conv_id) AS conv_id, count(*) AS n_convs, sum(leaf) AS n_leaves, sum(repeated) AS repeated"), "nodes")

    # Where the own nodes of a conversation hang: below a node of another one.
    attached = materialise(_named(owned.filter("own BETWEEN 1 AND len"), F.col("own") - 1), "attached")
    branches = materialise(attached.groupBy(*KEY).agg(F.count(F.lit(1)).alias("branches")), "branches")
    above = nodes.select(*KEY, F.col("conv_id").alias("parent"))
    total = attached.count()
    hot = above.join(branches.filter(F.col("branches") > total / HOT_NODES), KEY).select(*KEY, "parent")
    looked = attached.join(F.broadcast(hot), KEY, "left")
    parents = looked.filter("parent IS NOT NULL").select("conv_id", "parent").unionByName(
        looked.filter("parent IS NULL").drop("parent").join(above, KEY).select("conv_id", "parent"))

    owner = owned.select("conv_id", "block", "before", "words", "len", "own", F.col("repeated").alias("owner_repeated"))
    joined = nodes.join(owner, ["conv_id", "block"]).join(branches, KEY, "left").join(_ends(owned), KEY, "left").join(parents, "conv_id", "left")
    above_words = F.when(F.col("depth") > 0, F.col("before") + _first_words(F.col("k") - 1)).otherwise(0)
    return joined.select(
        "conv_id", F.col("depth").cast("long").alias("depth"),
        F.when(F.col("depth") > F.col("own"), F.col("conv_id")).when(F.col("depth") > 0, F.col("parent")).alias("parent_conv_id"),
        "n_convs", (F.coalesce("branches", F.lit(0)) + (F.col("len") > F.col("depth")).cast("long")).alias("n_children"), "n_leaves",
        (F.col("repeated") - F.col("owner_repeated") - (F.col("n_convs") - 1) * above_words).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def report(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of ``conv_id, turn, role, text``."""
    return trie(*shared_openings(materialise(turn_rows(turns), "turns")))
