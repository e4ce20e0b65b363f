"""Mixing sources to target weights by entropy balancing, all in DataFrame functions.

Targets: sources in code point order, null last, weigh 3, 1, 2, 3, ... and share ``SHARE`` times the
words of all documents. A target stops at ``REPEATS`` times its source's words; what is over is
shared again by weight until no target is above.

Rates: of all document rates that meet a source's target and stay between 0 and ``REPEATS``, those
nearest to one copy each in relative entropy are the tilted ones, rate = REPEATS p with
p = e^(l x) / (1 + e^(l x)), x the size over the source's mean size. The dual, the sum of
REPEATS ln(1 + e^(l x)) less l times the target, is convex in the source's l; Newton steps, held in a
shrinking bracket, are taken for all sources at once. A rate depends on source and size alone, so an
iteration is one aggregate over the histogram of sizes.

Copies: a source's ``FIRST`` largest sizes are rounded one after another, from the largest down, to
whole copies; what the words taken so far miss is carried on, so smaller documents make up for larger
ones. The expected copies of all smaller sizes are added up and rounded, and the difference of two
neighbours is what a size gets. Inside a size the whole copies go to all and the rest to the documents
that are first by a hash of their id. A size that holds more than one in ``HOT_SIZES`` of all rows is
cut into slices by that hash, counted and ranked apart. Sums are whole numbers, decimals, or in a
fixed order, so reruns agree, however the table is partitioned.

A null text has size 0, and a document without words takes none. Null ids and repeated rows are rows
of their own (of rows that are alike any may get the copy), other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.session import materialise

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
WORD = r"[^\x20\x09-\x0D]+"
# Words of a target that the rates may miss it by, as a share of it, and steps until then at most.
TOLERANCE, STEPS = 1e-9, 60
# Sizes of a source that are rounded one by one.
FIRST = 1000
# Fewer than so many sizes are hot, and slices of each of them.
HOT_SIZES, SLICES = 4096, 256
# Repeats of a row above which they are written by several tasks.
MANY = 10_000
EXACT = "decimal(38,9)"


def sized(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, source, size, repeats``: rows that are alike are one row. No source is ``~``, others begin with ``=``."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("~"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("repeats"))


def numbered(sources: DataFrame) -> DataFrame:
    """``sources`` with ``weight``: ranked by ranges, so that no task holds them all."""
    ranged = sources.repartitionByRange("source").sortWithinPartitions("source")
    # The number holds the partition and, in its lower 33 bits, the place in it.
    placed = materialise(ranged.withColumn("place", F.monotonically_increasing_id()), "sources")
    part = F.shiftright("place", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    parts = parts.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    rank = F.col("earlier") + F.col("place").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int"))
    return placed.join(parts, part == F.col("part")).select(*sources.columns, weight.cast("long").alias("weight"))


def targets(sources: DataFrame) -> DataFrame:
    """``target`` of each source from ``source_size`` and ``weight``."""
    limit = F.col("source_size") * REPEATS
    total = F.sum("source_size")
    words, weights = sources.agg(total, F.sum("weight")).first()
    words, level, held = int(words or 0), None, -1
    free, left = weights, SHARE * words
    # A source at its limit stays there: what the others get per weight only grows.
    while free:
        level = left / free
        over = limit < F.col("weight") * level
        n, full, kept = sources.agg(F.count_if(over), F.sum(F.when(over, limit)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == held:
            break
        held, free, left = n, kept or 0, SHARE * words - int(full or 0)
    target = limit.cast("double") if level is None else F.least(limit.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", target)


def _tilt(x: Column, tilt: Column) -> Column:
    """e^(l x) / (1 + e^(l x)) without overflow."""
    small = F.exp(-F.abs(tilt * x))
    return F.when(tilt * x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def rates(histogram: DataFrame, sources: DataFrame) -> DataFrame:
    """``rate`` of each (source, size) of the histogram ``source, size, n``: Newton's iterations on the dual."""
    share = F.try_divide(F.col("target"), REPEATS * F.col("source_size"))
    # Closed ends: all copies, or none.
    fixed = F.when(share.isNull() | (share >= 1), F.lit(float(REPEATS))).when(share <= 0, F.lit(0.0))
    state = sources.select(
        "source", "target", (F.col("source_size") / F.col("documents")).alias("scale"), fixed.alias("fixed"),
        F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"),
        F.when(fixed.isNull(), F.ln(share / (1 - share)) * F.col("source_size") / F.col("documents") / F.col("mean")).alias("tilt"),
        fixed.isNotNull().alias("done"))
    state = materialise(state, "tilt")
    for _ in range(STEPS):
        open_ = state.filter("NOT done")
        if open_.isEmpty():
            break
        rows = histogram.join(open_, "source")
        x = F.col("size") / F.col("scale")
        p = _tilt(x, F.col("tilt"))
        sums = rows.groupBy("source").agg(
            F.sum((REPEATS * F.col("n") * F.col("size") * p).cast(EXACT)).cast("double").alias("words"),
            F.sum((REPEATS * F.col("n") * F.col("size") * x * p * (1 - p)).cast(EXACT)).cast("double").alias("slope"))
        gap, tilt = F.col("words") - F.col("target"), F.col("tilt")
        low, high = F.when(gap < 0, tilt).otherwise(F.col("low")), F.when(gap >= 0, tilt).otherwise(F.col("high"))
        step = tilt - gap / F.when(F.col("slope") > 0, F.col("slope"))
        # Where Newton's step leaves the bracket: its middle, or twice as far while it is open.
        further = F.coalesce((low + high) / 2, F.when(gap < 0, 2 * F.abs(tilt) + 1).otherwise(-2 * F.abs(tilt) - 1))
        inside = (step > F.coalesce(low, -4 * F.abs(tilt) - 4)) & (step < F.coalesce(high, 4 * F.abs(tilt) + 4))
        done = F.col("done") | (F.abs(gap) <= TOLERANCE * F.col("target"))
        state = materialise(state.join(sums, "source", "left").select(
            "source", "target", "scale", "fixed", low.alias("low"), high.alias("high"),
            F.when(done, tilt).when(inside, step).otherwise(further).alias("tilt"), done.alias("done")), "tilt")
    rate = F.coalesce("fixed", REPEATS * _tilt(F.col("size") / F.col("scale"), F.col("tilt")))
    return histogram.join(state.select("source", "scale", "fixed", "tilt"), "source").select("source", "size", "n", rate.alias("rate"))


def copies(rated: DataFrame) -> DataFrame:
    """Whole ``copies`` of each (source, size) from its ``n`` documents and their ``rate``."""
    falling = Window.partitionBy("source").orderBy(F.desc("size"))
    placed = rated.withColumn("place", F.row_number().over(falling))
    listed = placed.filter(F.col("place") <= FIRST).groupBy("source").agg(
        F.sort_array(F.collect_list(F.struct("size", "n", "rate")), asc=False).alias("sizes"))
    # Whole copies of the words wanted here, with what is left from larger sizes.
    whole = f"greatest(0L, least({REPEATS} * x.n, CAST(round((a.left + x.n * x.rate * x.size) / x.size) AS BIGINT)))"
    walked = F.expr(
        "aggregate(sizes, named_struct('left', 0D, 'copies', CAST(array() AS ARRAY<BIGINT>)), (a, x) -> named_struct("
        f"'left', a.left + x.n * x.rate * x.size - x.size * {whole}, 'copies', concat(a.copies, array({whole})))).copies")
    large = listed.select("source", F.explode(F.arrays_zip("sizes", walked.alias("copies"))).alias("z"))
    large = large.select("source", "z.sizes.size", "z.sizes.n", "z.copies")
    expected = (F.col("n") * F.col("rate")).cast(EXACT)
    upto = F.sum(expected).over(falling.rowsBetween(Window.unboundedPreceding, 0))
    small = placed.filter(F.col("place") > FIRST).select(
        "source", "size", "n", (F.round(upto) - F.round(upto - expected)).cast("long").alias("copies"))
    return large.unionByName(small)


def mix(docs: DataFrame) -> DataFrame:
    """Rows ``doc_id, source, size, source_size, target, copies, taken`` of all documents."""
    rows = materialise(sized(docs), "sized")
    histogram = materialise(rows.groupBy("source", "size").agg(F.sum("repeats").alias("n")), "histogram")
    words, squares = F.sum(F.col("size") * F.col("n")), F.sum((F.col("size") * F.col("size")).cast("decimal(20,0)") * F.col("n"))
    sources = histogram.groupBy("source").agg(
        words.alias("source_size"), F.sum("n").alias("documents"), F.try_divide(squares.cast("double"), words.cast("double")).alias("mean"))
    sources = materialise(targets(numbered(sources)), "targets")
    dealt = copies(rates(histogram.filter("size > 0"), sources))
    empty = histogram.filter("size = 0").select("source", "size", "n", F.lit(0).cast("long").alias("copies"))
    plan = dealt.unionByName(empty).join(sources.select("source", "source_size", "target"), "source").select(
        "source", "size", "n", "source_size", "target", F.expr("copies div n").alias("each"), F.expr("copies % n").alias("rest"))
    plan = materialise(plan, "plan")

    total = plan.agg(F.sum("n")).first()[0] or 0
    hot = plan.filter(F.col("n") > total / HOT_SIZES).select("source", "size", F.lit(True).alias("hot"))
    order = F.xxhash64("doc_id")
    sliced = rows.join(F.broadcast(hot), ["source", "size"], "left").withColumn(
        "slice", F.when(F.col("hot"), F.pmod(F.shiftrightunsigned(order, 32), F.lit(SLICES))).otherwise(0))
    before = Window.partitionBy("source", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = sliced.groupBy("source", "size", "slice").agg(F.sum("repeats").alias("rows"))
    counts = counts.select("source", "size", "slice", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    slices = counts.join(plan, ["source", "size"])
    inside = Window.partitionBy("source", "size", "slice").orderBy(order, "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    joined = sliced.drop("hot").join(slices, ["source", "size", "slice"])
    first = F.col("rest") - F.col("earlier") - F.coalesce(F.sum("repeats").over(inside), F.lit(0))
    ranked = joined.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("repeats", first)))

    # Rows that are alike are written out again, first those that get a copy more.
    few = ranked.filter(F.col("repeats") <= MANY).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "repeats")))
    many = ranked.filter(F.col("repeats") > MANY).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(repeats - 1) div {MANY}"))))
    many = many.repartition("doc_id", "source", "size", "block").withColumn(
        "i", F.explode(F.sequence(F.col("block") * MANY + 1, F.least("repeats", (F.col("block") + 1) * MANY)))).drop("block")
    copied = F.col("each") + (F.col("i") <= F.col("more")).cast("long")
    return few.unionByName(many).select(
        "doc_id", F.when(F.col("source") != "~", F.substr("source", F.lit(2))).alias("source"), "size", "source_size", "target",
        copied.alias("copies"), (copied * F.col("size")).alias("taken"))
