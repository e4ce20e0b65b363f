"""Classifier evaluation: reports, confusion, paired comparison, resampling, latency."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES
from drivepulse.operators.ranking import exact_quantiles

# Replicates of a published evaluation.
REPLICATES = 100_000
# Profiles of a block in the multinomial and binomial forms, and replicates that a task sums at once.
PROFILE_BLOCK = 4_096
REPLICATE_STEP = 1_000
# Profiles that travel to every task (24 bytes each), and words that a step draws (so few that its arrays stay in the cache).
POOL_PROFILES = 1_000_000
DRAW_STEP = 1 << 14
# Entries of a table by leading bits of a word (8 bytes each; none: draws are searched for), and the mark of entries that profiles share.
TABLE_PLACES, SHARED = 1 << 20, 1 << 62

TRUE, PRED = "true_label", "predicted_label"


def severity_counts(log: DataFrame, keys: Sequence[str] = (), score: str = "score") -> DataFrame:
    s = F.col(score)
    return log.groupBy(*keys).agg(
        F.count_if(s >= 0.7).alias("n_warning"),
        F.count_if((s >= 0.3) & (s < 0.7)).alias("n_caution"),
        F.count_if(s < 0.3).alias("n_normal"),
        F.count_if(F.col(TRUE) != F.col(PRED)).alias("n_wrong"),
    )


def accuracy(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg((F.col(TRUE) == F.col(PRED)).cast("double")).alias("accuracy")
    )


def confusion_cells(preds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts per (true, predicted): at most classes² rows per key after the map side."""
    return preds.groupBy(*keys, TRUE, PRED).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(preds: DataFrame, keys: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Rows true, one column per predicted class, zero-filled."""
    cells = confusion_cells(preds, keys)
    wide = cells.groupBy(*keys, TRUE).pivot(PRED, list(classes)).agg(F.sum("n"))
    return wide.fillna(0, subset=list(classes))


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom == 0, 0.0).otherwise(top / bottom)


def class_scores(
    preds: DataFrame, keys: Sequence[str] = (), classes: Sequence[str] = CLASSES, *, n: str | None = None
) -> DataFrame:
    """Precision, recall, F1 and support for every class of the list; absent ones are zero.

    Works on single predictions, or on counted cells when ``n`` names the count.
    One pass and one shuffle: the per-class sums are combined map-side.
    """
    weight = F.lit(1).cast("long") if n is None else F.col(n)

    def total(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, weight)), F.lit(0))

    t, p = F.col(TRUE), F.col(PRED)
    sums = preds.groupBy(*keys).agg(
        *[total((t == c) & (p == c)).alias(f"_hit_{c}") for c in classes],
        *[total(p == c).alias(f"_said_{c}") for c in classes],
        *[total(t == c).alias(f"_is_{c}") for c in classes],
    )
    per_class = F.array(
        *[
            F.struct(
                F.lit(c).alias("label"), F.col(f"_hit_{c}").alias("tp"),
                (F.col(f"_said_{c}") - F.col(f"_hit_{c}")).alias("fp"),
                (F.col(f"_is_{c}") - F.col(f"_hit_{c}")).alias("fn"),
            )
            for c in classes
        ]
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.select(*keys, F.explode_outer(per_class).alias("r")).select(*keys, "r.*").select(
        *keys, "label", "tp", "fp", "fn",
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        (tp + fn).alias("support"),
    )


def classification_report(preds: DataFrame, keys: Sequence[str] = (), classes: Sequence[str] = CLASSES) -> DataFrame:
    """Class rows plus accuracy, micro, macro and support-weighted averages."""
    per_class = class_scores(preds, keys, classes)
    n = F.sum("support")

    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), n)

    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    averages = per_class.groupBy(*keys).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("label"), _ratio(tp, n).alias("precision"), _ratio(tp, n).alias("recall"),
                     _ratio(tp, n).alias("f1"), n.alias("support")),
            F.struct(F.lit("micro avg").alias("label"), _ratio(tp, tp + fp).alias("precision"),
                     _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
                     n.alias("support")),
            F.struct(F.lit("macro avg").alias("label"), F.avg("precision").alias("precision"),
                     F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), n.alias("support")),
            F.struct(F.lit("weighted avg").alias("label"), weighted("precision").alias("precision"),
                     weighted("recall").alias("recall"), weighted("f1").alias("f1"), n.alias("support")),
        ).alias("rows")
    )
    flat = averages.select(*keys, F.explode_outer("rows").alias("r")).select(*keys, "r.*")
    return per_class.drop("tp", "fp", "fn").unionByName(flat)


def macro_f1(
    preds: DataFrame, keys: Sequence[str], classes: Sequence[str] = CLASSES, *, n: str | None = None
) -> DataFrame:
    return class_scores(preds, keys, classes, n=n).groupBy(*keys).agg(F.avg("f1").alias("macro_f1"))


def fold_summary(preds: DataFrame, keys: Sequence[str], fold: str = "fold") -> DataFrame:
    """Mean and spread of fold scores next to the score of the summed matrix.

    The samples are read once, into counted cells; ``std`` is the population
    deviation over the folds.
    """
    cells = confusion_cells(preds, [*keys, fold])
    hit = F.when(F.col(TRUE) == F.col(PRED), F.col("n")).otherwise(0)
    right = cells.groupBy(*keys, fold).agg((F.sum(hit) / F.sum("n")).alias("accuracy"))
    folds = macro_f1(cells, [*keys, fold], n="n").join(right, [*keys, fold])
    spread = folds.groupBy(*keys).agg(
        F.avg("macro_f1").alias("f1_mean"), F.stddev_pop("macro_f1").alias("f1_std"),
        F.avg("accuracy").alias("acc_mean"), F.stddev_pop("accuracy").alias("acc_std"),
    )
    whole = macro_f1(cells, keys, n="n").withColumnRenamed("macro_f1", "f1_cumulative")
    return spread.join(whole, list(keys))


def directed_confusion(cells: DataFrame, keys: Sequence[str], a: str = "DEMAG", b: str = "NORMAL", n: str = "n") -> DataFrame:
    """Recall of class ``a`` and the two directed error counts between ``a`` and ``b``.

    Works on counted cells (true, predicted, n), so published matrices fit as well.
    """
    t, p, c = F.col(TRUE), F.col(PRED), F.col(n)

    def total(cond: Column) -> Column:
        return F.sum(F.when(cond, c).otherwise(0))

    return cells.groupBy(*keys).agg(
        _ratio(total((t == a) & (p == a)), total(t == a)).alias("recall"),
        total((t == a) & (p == b)).alias("a_to_b"),
        total((t == b) & (p == a)).alias("b_to_a"),
    ).withColumn("both_ways", F.col("a_to_b") + F.col("b_to_a"))


def error_reduction(counts: DataFrame, model: str, base: str, other: str) -> DataFrame:
    """Percent change of each error count from model ``base`` to model ``other``."""
    def of(name: str, c: str) -> Column:
        return F.max(F.when(F.col(model) == name, F.col(c)))

    names = ("a_to_b", "b_to_a", "both_ways")
    return counts.agg(
        *[_ratio((of(base, c) - of(other, c)) * 100.0, of(base, c)).alias(f"{c}_reduction") for c in names]
    )


def ablation_table(scores: DataFrame, vehicles: Sequence[str], config: str = "config") -> DataFrame:
    """Configurations as rows, vehicles as columns, with the mean over vehicles."""
    wide = scores.groupBy(config).pivot("vehicle", list(vehicles)).agg(F.max("macro_f1"))
    total = sum((F.col(v) for v in vehicles[1:]), F.col(vehicles[0]))
    return wide.withColumn("mean", total / F.lit(float(len(vehicles))))


def paired_counts(a: DataFrame, b: DataFrame, on: str = "sample_id", keys: Sequence[str] = ()) -> DataFrame:
    """Discordant counts of two models on the same samples, per key.

    ``n10``: the first model alone is right; ``n01``: the second alone is right.
    """
    left = a.select(on, *keys, (F.col(TRUE) == F.col(PRED)).alias("_a"))
    right = b.select(on, (F.col(TRUE) == F.col(PRED)).alias("_b"))
    return left.join(right, on).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_a") & ~F.col("_b")).alias("n10"),
        F.count_if(~F.col("_a") & F.col("_b")).alias("n01"),
    )


def effect_size(counts: DataFrame) -> DataFrame:
    """Accuracy difference and the continuity-corrected McNemar statistic."""
    d = F.col("n10") - F.col("n01")
    m = F.col("n10") + F.col("n01")
    chi = F.when(m == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(d) - 1, F.lit(0)), 2) / m)
    return counts.withColumn("delta", _ratio(d, F.col("n"))).withColumn("mcnemar", chi)


def mcnemar_p(stats: DataFrame, statistic: str = "mcnemar") -> DataFrame:
    """Upper tail of chi-square with one degree of freedom (= erfc of sqrt(x/2))."""
    from math import erfc, sqrt

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: erfc(sqrt(v / 2.0)))

    return stats.withColumn("p_value", tail(F.col(statistic)))


def session_profiles(counts: DataFrame) -> DataFrame:
    """Sessions that look alike to a resampler: same difference and size, with their number."""
    return counts.select((F.col("n10") - F.col("n01")).alias("d"), F.col("n").alias("n")).groupBy("d", "n").agg(
        F.count(F.lit(1)).alias("sessions")
    )


def _mix32(word: np.ndarray) -> np.ndarray:
    """The mixing of :func:`drivepulse.functions.scalars.with_mix32` on arrays; products wrap at 32 bits."""
    high = word >> np.uint32(16)
    word = word ^ high
    word *= np.uint32(0x45D9F3B)
    word ^= np.right_shift(word, np.uint32(16), out=high)
    word *= np.uint32(0x45D9F3B)
    word ^= np.right_shift(word, np.uint32(16), out=high)
    return word


class _Pool:
    """Profiles in order of (d, n), each with the span of places of its sessions; small enough for every task."""

    def __init__(self, rows, seed: int):
        rows = sorted((r["d"], r["n"], r["sessions"]) for r in rows)
        self.d, self.n, sessions = (np.array(c, "int64") for c in zip(*rows, strict=True))
        self.upto, self.seed = np.cumsum(sessions), seed
        self.total, self._table, self._runs = int(self.upto[-1]), None, None

    def words(self, reps: np.ndarray, low: int, high: int) -> np.ndarray:
        """A word for every replicate and each number from ``low`` to ``high``."""
        keys = _mix32(reps.astype("uint32") ^ np.uint32(self.seed & 0xFFFFFFFF))
        return _mix32(keys[:, None] ^ np.arange(low, high, dtype="uint32")[None, :])

    def drawn(self, reps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of d and of n over as many draws with replacement as there are sessions."""
        over, under = np.zeros(len(reps), "int64"), np.zeros(len(reps), "int64")
        for low in range(0, self.total, DRAW_STEP):
            d, n = self._drawn(self.words(reps, low, min(low + DRAW_STEP, self.total)))
            over += d
            under += n
        return over, under

    def _drawn(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of d and n of each row of words, whose places are ``words * total >> 32``.

        Places rise with words, so a profile is a span of words. A table by the leading bits of a word holds
        its profile; only words of entries that two profiles share are searched for.
        """
        if self._table is None:
            ends = -(-(self.upto.astype(object) << 32) // self.total)
            self._ends = np.array(ends, "uint64")
            # Some 64 entries for each profile, while so many are allowed, leave few of them shared.
            bits = min(max(12, 6 + len(self.d).bit_length()), max(1, TABLE_PLACES).bit_length() - 1)
            begin = np.arange(1 << bits, dtype="uint64") << np.uint64(32 - bits)
            first, last = (np.searchsorted(self._ends, w, "right") for w in (begin, begin + np.uint64((1 << (32 - bits)) - 1)))
            # d and n of a profile in one number where sums of both fit it.
            self._packed = int(max(np.abs(self.d).max(), np.abs(self.n).max())) < 1 << 15 and int(self.n.min()) >= 0
            values = self.d * (1 << 32) + self.n if self._packed else np.arange(len(self.d))
            self._shift, self._values, self._table = np.uint64(32 - bits), values, np.where(first == last, values[first], SHARED)
        drawn = words.ravel()
        found = self._table.take(drawn >> np.uint32(self._shift)) if self._shift < 32 else np.full(drawn.shape, SHARED)
        several = np.flatnonzero(found == SHARED)
        found[several] = self._values[np.searchsorted(self._ends, drawn[several].astype("uint64"), "right")]
        found = found.reshape(words.shape)
        if not self._packed:
            return self.d[found].sum(axis=1), self.n[found].sum(axis=1)
        sums = found.sum(axis=1)
        return sums >> 32, sums & 0xFFFFFFFF

    def flipped(self, reps: np.ndarray) -> np.ndarray:
        """Sum of d with a sign for every session: a session's place is a bit, and counts of bits give the sums of signs."""
        out = np.zeros(len(reps), "int64")
        for low in range(0, self.total, 32 * DRAW_STEP):
            word, mask, d = self._masks(low, min(low + 32 * DRAW_STEP, self.total))
            bits = self.words(reps, low // 32, low // 32 + int(word[-1]) + 1)[:, word] & mask
            out += 2 * (np.bitwise_count(bits).astype("int64") @ d) - np.bitwise_count(mask).astype("int64") @ d
        return out

    def _masks(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of places from ``low`` to ``high`` that lie in one word and one profile: the word, its bits, d."""
        if self._runs is None or self._runs[0] != (low, high):
            inside = self.upto[np.searchsorted(self.upto, low, "right") : np.searchsorted(self.upto, high, "left")]
            first = np.unique(np.concatenate([np.arange(low, high, 32), inside]))
            last = np.append(first[1:], high)
            mask = (1 << (last - 1 - (first & ~31) + 1)) - (1 << (first & 31))
            d = self.d[np.searchsorted(self.upto, first, "right")]
            self._runs = (low, high), ((first - low) // 32, mask.astype("uint32"), d)
        return self._runs[1]


def _pool(counts: DataFrame, seed: int) -> _Pool | None:
    """The pool of the sessions; None when there are too many profiles or sessions for a task."""
    rows = session_profiles(counts).limit(POOL_PROFILES + 1).collect()
    if len(rows) > POOL_PROFILES or sum(r["sessions"] for r in rows) >= 1 << 31:
        return None
    return _Pool(rows, seed)


def _replicated(spark: SparkSession, pool: _Pool, first: int, replicates: int, sums, words: int) -> DataFrame:
    """Rows ``replicate, delta``; a task computes a run of replicates in arrays of ``words``, so no draw is a row and nothing is shuffled."""
    shared = spark.sparkContext.broadcast(pool)
    parts = max(1, min(replicates, 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        p = shared.value
        step = max(1, DRAW_STEP // words)
        for batch in batches:
            ids = batch["id"].to_numpy()
            for start in range(0, len(ids), step):
                reps = ids[start : start + step]
                over, under = sums(p, reps)
                yield pd.DataFrame({"replicate": reps, "delta": over / under})

    return spark.range(first, replicates, 1, parts).mapInPandas(run, "replicate long, delta double")


def bootstrap_draws(counts: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Replicate deltas by hashed draws with replacement.

    Sessions with equal (d, n) are interchangeable: in order of (d, n) each profile takes a span of
    places, and a draw is one place, found by the leading bits of its word. The profiles
    travel to all tasks while there are at most ``POOL_PROFILES`` of them and fewer than 2^31 sessions;
    beyond that :func:`bootstrap_multinomial` draws the same distribution from blocks of profiles.
    """
    spark = counts.sparkSession
    if counts.isEmpty():
        return spark.createDataFrame([], "replicate long, delta double")
    pool = _pool(counts, seed)
    if pool is None:
        return bootstrap_multinomial(counts, replicates, seed)
    return _replicated(spark, pool, 0, replicates, lambda p, reps: p.drawn(reps), pool.total)


def bootstrap_multinomial(counts: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """The same distribution with one multinomial draw per replicate over the profiles.

    Work is replicates × profiles, independent of the number of sessions. Profiles are dealt to blocks;
    how many draws of a replicate fall into a block follows from binomial splits of all draws, down a
    binary tree over the blocks whose nodes have seeds of their own, so that every block finds its share alone.
    """
    return _profile_replicates(counts, replicates, seed, "bootstrap")


def permutation_binomial(counts: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Sign-flip deltas with one binomial draw per profile and replicate, over blocks of profiles."""
    return _profile_replicates(counts, replicates, seed, "flip")


def _profile_replicates(counts: DataFrame, replicates: int, seed: int, kind: str) -> DataFrame:
    spark = counts.sparkSession
    profiles = session_profiles(counts)
    blocks = -(-profiles.count() // PROFILE_BLOCK)
    profiles = profiles.withColumn("_block", F.pmod(F.xxhash64("d", "n"), F.lit(max(1, blocks))).cast("int"))
    upto = np.zeros(blocks + 1, dtype="int64")
    for row in profiles.groupBy("_block").agg(F.sum("sessions").alias("c")).collect():  # one row per block
        upto[row["_block"] + 1] = row["c"]
    upto = np.cumsum(upto)
    shared = spark.sparkContext.broadcast(upto)
    # Few blocks are handed out several times, each time for some of the replicates.
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    chunks = max(1, min(-(-replicates // REPLICATE_STEP), -(-2 * parts // max(1, blocks))))
    listed = profiles.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("d", "n", "sessions"))).alias("_p")).select(
        "_block", "_p.d", "_p.n", "_p.sessions",
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("_chunk"))

    def draws(rep: int, block: int) -> int:
        """Draws of a replicate that fall into a block."""
        low, high, here = 0, len(upto) - 1, int(shared.value[-1])
        while high - low > 1:
            middle = (low + high) // 2
            left, whole = (int(shared.value[x] - shared.value[low]) for x in (middle, high))
            split = np.random.default_rng([seed, rep + 1, blocks + low, high]).binomial(here, left / whole if whole else 0.0)
            low, high, here = (low, middle, int(split)) if block < middle else (middle, high, here - int(split))
        return here

    first = 0 if kind == "bootstrap" else -1

    def draw(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                block, chunk = int(row[0]), int(row[4])
                d, n, c = (np.asarray(x, dtype="int64") for x in row[1:4])
                share, whole = c / c.sum(), int((c * n).sum())
                begin, end = (first + (replicates - first) * k // chunks for k in (chunk, chunk + 1))
                for start in range(begin, end, REPLICATE_STEP):
                    reps = range(start, min(start + REPLICATE_STEP, end))
                    over, under = [], []
                    for rep in reps:
                        rng = np.random.default_rng([seed, rep + 1, block])
                        if rep < 0:
                            times, size = c, whole
                        elif kind == "bootstrap":
                            times = rng.multinomial(draws(rep, block), share)
                            size = int((times * n).sum())
                        else:
                            times, size = 2 * rng.binomial(c, 0.5) - c, whole
                        over.append(int((times * d).sum()))
                        under.append(size)
                    yield pd.DataFrame({"replicate": list(reps), "_d": over, "_n": under})

    dealt = listed.repartition(min(parts, max(1, blocks) * chunks), "_block", "_chunk")
    sums = dealt.mapInPandas(draw, "replicate long, _d long, _n long")
    return sums.groupBy("replicate").agg((F.sum("_d") / F.sum("_n")).alias("delta"))


def bootstrap_interval(deltas: DataFrame, margin: float = 0.01) -> DataFrame:
    """95 % interval, one-sided 5 % bound and the non-inferiority verdict."""
    out = deltas.agg(
        F.percentile("delta", F.lit(0.025)).alias("ci_low"),
        F.percentile("delta", F.lit(0.975)).alias("ci_high"),
        F.percentile("delta", F.lit(0.05)).alias("one_sided_low"),
    )
    return out.withColumn("non_inferior", F.col("one_sided_low") > -margin)


def permutation_deltas(counts: DataFrame, replicates: int = REPLICATES, seed: int = 42) -> DataFrame:
    """Sign-flip replicates by hash: each session has a bit, and counts of bits give a profile's sum of signs.

    Replicate -1 is the unflipped sum, so the observed value needs no second pass. Profiles travel to
    the tasks as in :func:`bootstrap_draws`; beyond its bounds :func:`permutation_binomial` takes over.
    """
    spark = counts.sparkSession
    if counts.isEmpty():
        return spark.createDataFrame([], "replicate long, delta double")
    pool = _pool(counts, seed)
    if pool is None:
        return permutation_binomial(counts, replicates, seed)

    def sums(p: _Pool, reps: np.ndarray):
        size = np.diff(p.upto, prepend=0)
        return np.where(reps < 0, int((size * p.d).sum()), p.flipped(reps)), int((size * p.n).sum())

    return _replicated(spark, pool, -1, replicates, sums, -(-pool.total // 32))


def permutation_p(deltas: DataFrame) -> DataFrame:
    """Two-sided p: share of flipped differences at least as large as the observed one.

    ``deltas`` holds one row per replicate, a number fixed by the caller.
    """
    flipped = F.collect_list(F.when(F.col("replicate") >= 0, F.abs("delta")))
    out = deltas.agg(F.max(F.when(F.col("replicate") < 0, F.col("delta"))).alias("observed"), flipped.alias("_f"))
    reached = F.filter("_f", lambda d: d >= F.abs("observed") - F.lit(1e-12))
    return out.select("observed", (F.size(reached) / F.size("_f")).alias("p_value"))


def design_effect(sizes: DataFrame) -> DataFrame:
    """Effective sample size from per-session sums ``n, s, ss`` of a 0/1 outcome.

    One-way analysis of variance: the intraclass correlation follows from the mean
    squares between and within sessions.
    """
    t = sizes.agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
        F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") * F.col("n")).alias("n2"),
    )
    k, n = F.col("k"), F.col("n")
    msb = (F.col("b") - F.col("s") * F.col("s") / n) / (k - 1)
    msw = (F.col("ss") - F.col("b")) / (n - k)
    m0 = (n - F.col("n2") / n) / (k - 1)
    out = t.withColumn("mean_size", n / k).withColumn("icc", (msb - msw) / (msb + (m0 - 1) * msw))
    effect = F.lit(1.0) + (F.col("mean_size") - 1) * F.greatest("icc", F.lit(0.0))
    return out.withColumn("design_effect", effect).select(
        "mean_size", "icc", "design_effect", (F.col("n") / F.col("design_effect")).alias("effective_n")
    )


def latency_summary(
    log: DataFrame, keys: Sequence[str], ms: str = "ms", *, batch: str | None = None, budget_ms: float = 10_000.0, width: float = 1.0
) -> DataFrame:
    """p50, p95, p99 and max per key, per-item medians and the budget ratio, all exact."""
    quant = exact_quantiles(log, keys, ms, (0.5, 0.95, 0.99), width=width)
    wide = quant.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    )
    top = log.groupBy(*keys).agg(F.max(ms).alias("max"), F.count(ms).alias("n"))
    out = wide.join(top, list(keys))
    if batch is not None:
        out = out.withColumn("p50_per_item", F.col("p50") / F.col(batch))
        return out.withColumn("budget_ratio", F.lit(budget_ms) / F.col("p50_per_item"))
    return out.withColumn("budget_ratio", F.lit(budget_ms) / F.col("p50"))


def balanced_weights(samples: DataFrame, label: str = "cls", classes: int | None = None) -> DataFrame:
    """n / (k · n_c) per class, from one small aggregate."""
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("n_c"))
    n = counts.agg(F.sum("n_c")).scalar()
    k = counts.agg(F.count(F.lit(1))).scalar() if classes is None else F.lit(classes)
    return counts.select(label, "n_c", (n / (k * F.col("n_c"))).alias("weight"))


def group_inventory(samples: DataFrame, by: str, group: str, label: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Samples and distinct groups per ``by`` and distinct groups per class."""
    # One row per group with a mark per class: plain sums follow, no distinct aggregates.
    groups = samples.groupBy(by, group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.max(F.when(F.col(label) == c, 1).otherwise(0)).alias(f"_has_{c}") for c in classes],
    )
    return groups.groupBy(by).agg(
        F.sum("_n").alias("n_samples"),
        F.count(group).alias("n_groups"),
        *[F.sum(f"_has_{c}").alias(c) for c in classes],
    )
