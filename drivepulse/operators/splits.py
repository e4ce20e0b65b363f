"""Leak-safe splits, audits and balanced sampling by hashed ranks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES
from drivepulse.functions.scalars import hash_word
from drivepulse.operators.ranking import dense_position

WORD_SLICE = 1 << 20  # 4096 slices over the 32-bit hash range
# Leading binary digits of a class count that tell profiles apart; smaller counts are exact.
PROFILE_BITS = 5
# Groups that one task assigns one after another.
FOLD_BLOCK = 10_000


def group_labels(samples: DataFrame, *, group: str, label: str, by: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """One row per group with its first label in a stated order."""
    return samples.groupBy(*by, group).agg(F.min_by(label, F.col(order or label)).alias(label))


def holdout_trials(
    groups: DataFrame, *, by: str, group: str, label: str, test_size: float = 0.2, base_seed: int = 42, trials: int = 10,
) -> DataFrame:
    """Every group under every seed with its side; all seeds in one plan."""
    seeds = F.array(*[F.lit(base_seed + i) for i in range(trials)])
    tried = groups.withColumn("seed", F.explode(seeds)).withColumn("_h", hash_word(F.col("seed"), F.col(group)))
    ranked = dense_position(
        tried, [by, "seed"], ["_h", group], slice_by=F.floor(F.col("_h") / WORD_SLICE), name="_rank", size="_n"
    )
    side = F.when(F.col("_rank") < F.ceil(F.col("_n") * F.lit(test_size)), "val").otherwise("train")
    return ranked.select(by, "seed", group, label, side.alias("side"))


def trial_report(trials: DataFrame, *, by: str, label: str, classes: Sequence[str] = CLASSES, val_min_classes: int = 1) -> DataFrame:
    """Counts, class coverage and acceptance of every (by, seed)."""
    train, val = F.col("side") == "train", F.col("side") == "val"
    known = F.col(label).isin(*classes)
    out = trials.groupBy(by, "seed").agg(
        F.count_if(train).alias("n_train_groups"),
        F.count_if(val).alias("n_val_groups"),
        # At most one entry per known class.
        F.size(F.collect_set(F.when(train & known, F.col(label)))).cast("long").alias("n_train_classes"),
        F.size(F.collect_set(F.when(val & known, F.col(label)))).cast("long").alias("n_val_classes"),
    )
    ok = (F.col("n_train_classes") == len(classes)) & (F.col("n_val_classes") >= val_min_classes)
    return out.withColumn("accepted", ok)


def group_holdout(
    groups: DataFrame, *, by: str, group: str, label: str, classes: Sequence[str] = CLASSES, test_size: float = 0.2,
    base_seed: int = 42, trials: int = 10, val_min_classes: int = 1,
) -> DataFrame:
    """Hold-out by group: the smallest accepted seed per ``by`` wins.

    Fewer than five groups, or no accepted seed, is an error, raised when the result is read.
    Seeds are chosen where the report is; nothing reaches the driver.
    """
    tried = holdout_trials(
        groups, by=by, group=group, label=label, test_size=test_size, base_seed=base_seed, trials=trials,
    )
    report = trial_report(tried, by=by, label=label, classes=classes, val_min_classes=val_min_classes)
    few = F.min(F.col("n_train_groups") + F.col("n_val_groups")) < 5
    seed = F.min(F.when(F.col("accepted"), F.col("seed")))
    lost = F.concat(F.lit("no accepted split after "), F.lit(trials), F.lit(" seeds for "), F.col(by).cast("string"))
    small = F.concat(F.lit(f"{by}="), F.col(by).cast("string"), F.lit(": fewer than five groups"))
    chosen = report.groupBy(by).agg(few.alias("_few"), seed.alias("_seed"))
    checked = F.when(F.col("_few"), F.raise_error(small)).when(F.col("_seed").isNull(), F.raise_error(lost)).otherwise(F.col("_seed"))
    seeds = chosen.select(by, checked.alias("seed"))
    return tried.join(seeds, [by, "seed"], "left_semi")


def shared_groups(splits: DataFrame, *, by: str, group: str) -> DataFrame:
    """Groups that occur on both sides."""
    train = splits.filter(F.col("side") == "train").select(by, group)
    val = splits.filter(F.col("side") == "val").select(by, group)
    return train.intersect(val)


def assert_no_leak(splits: DataFrame, *, by: str, group: str) -> None:
    found = shared_groups(splits, by=by, group=group).orderBy(by, group).take(5)
    if found:
        raise AssertionError(f"groups on both sides: {[tuple(r) for r in found]}")


def stratified_folds(samples: DataFrame, *, group: str, label: str, k: int = 3) -> DataFrame:
    """Fold per group: groups of a class by size, dealt to folds back and forth.

    A group goes to exactly one fold; its class is its first label by name.
    """
    groups = samples.groupBy(group).agg(F.min(label).alias(label), F.count(F.lit(1)).alias("size"))
    keyed = groups.withColumn("_neg", -F.col("size")).withColumn("_h", hash_word(F.col(group)))
    slices = F.struct("_neg", F.floor(F.col("_h") / WORD_SLICE).alias("s"))
    placed = dense_position(keyed, [label], ["_neg", "_h", group], slice_by=slices, name="_r")
    step = F.col("_r") % k
    fold = F.when(F.floor(F.col("_r") / k) % 2 == 0, step).otherwise(F.lit(k - 1) - step)
    return placed.select(group, label, "size", fold.cast("int").alias("fold"))


def _leading(count: Column, bits: int = PROFILE_BITS) -> Column:
    """``count`` with all but its leading binary digits set to zero."""
    low = F.greatest(F.length(F.bin(count)) - bits, F.lit(0))
    unit = F.pow(F.lit(2.0), low).cast("long")
    return count - count % unit


def _assign(block: pd.DataFrame, classes: int, k: int) -> np.ndarray:
    """Fold of every row, one after another: where the squared class shares of the folds grow least.

    Ties go to the fold with fewer rows, then round the folds from one that changes with the block.
    """
    counts = block[[f"_n{c}" for c in range(classes)]].to_numpy(np.int64)
    weight = np.maximum(counts.sum(0), 1).astype(float)
    weight = weight * weight
    size, shift = block["size"].to_numpy(), int(block["_block"].iloc[0]) % k
    held, rows, turn = np.zeros((k, classes), np.int64), np.zeros(k, np.int64), (np.arange(k) + shift) % k
    fold = np.zeros(len(block), np.int32)
    for i, own in enumerate(counts):
        cost = np.zeros(k)
        for c in np.flatnonzero(own):
            cost += own[c] * (2 * held[:, c] + own[c]) / weight[c]
        f = np.lexsort([turn, rows, cost])[0]
        held[f] += own
        rows[f] += size[i]
        fold[i] = f
    return fold


def class_balanced_folds(
    samples: DataFrame, *, group: str, label: str, classes: Sequence[str] = CLASSES, k: int = 3, block: int = FOLD_BLOCK
) -> DataFrame:
    """Fold per group where a group may hold several classes: ``group, size, fold``.

    A group is its vector of class counts. Groups with the same profile (counts to their leading
    digits) are interchangeable: whole rounds of k are dealt back and forth, which leaves the folds
    even. The rest, fewer than k groups of a profile, go one after another, large ones first, to the
    fold where the squared class shares grow least, in blocks of ``block`` groups that each start
    from even folds. Rows with a null or another label count in ``size`` only; a null group is a group.
    """
    counts = [F.count_if(F.col(label) == c).alias(f"_n{i}") for i, c in enumerate(classes)]
    vectors = samples.groupBy(group).agg(F.count(F.lit(1)).alias("size"), *counts)
    profile = [f"_p{i}" for i in range(len(classes))]
    keyed = vectors.withColumn("_h", hash_word(F.col(group))).withColumns(
        {p: _leading(F.col(f"_n{i}")) for i, p in enumerate(profile)}
    )
    by_hash = F.floor(F.col("_h") / WORD_SLICE)
    ranked = dense_position(keyed, profile, ["_h", group], slice_by=by_hash, name="_r", size="_m").drop(*profile)
    whole = F.col("_r") < F.col("_m") - F.col("_m") % k
    step = F.col("_r") % k
    dealt = F.when(F.floor(F.col("_r") / k) % 2 == 0, step).otherwise(F.lit(k - 1) - step)
    even = ranked.filter(whole).select(group, "size", dealt.cast("int").alias("fold"))

    rest = ranked.filter(~whole).drop("_r", "_m").withColumns({"_all": F.lit(0), "_neg": -F.length(F.bin("size"))})
    # Sizes by binary digits and hashes by slice: at most 64 x 4096 slices.
    order = dense_position(rest, ["_all"], ["_neg", "_h", group], slice_by=F.struct("_neg", by_hash.alias("s")), name="_i")
    blocks = order.withColumn("_block", F.floor(F.col("_i") / block))
    kind = samples.schema[group].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_i")
        return pd.DataFrame({group: rows[group], "size": rows["size"], "fold": _assign(rows, len(classes), k)})

    odd = blocks.drop("_all", "_neg", "_h").groupBy("_block").applyInPandas(run, f"`{group}` {kind}, size bigint, fold int")
    return even.unionByName(odd)


def record_split(samples: DataFrame, key: str, *, train_share: float = 0.8, seed: int = 42) -> DataFrame:
    """Split single records regardless of their group (leaks by design; for comparison)."""
    limit = int(round(train_share * 10_000))
    bucket = hash_word(F.lit(seed), F.col(key)) % 10_000
    return samples.withColumn("side", F.when(bucket < limit, "train").otherwise("val"))


def leak_audit(samples: DataFrame, group: str) -> DataFrame:
    """How many validation groups also occur in training."""
    sides = samples.groupBy(group).agg(
        F.max((F.col("side") == "train").cast("int")).alias("t"), F.max((F.col("side") == "val").cast("int")).alias("v")
    )
    return sides.agg(
        F.sum("v").alias("val_groups"), F.sum(F.col("t") * F.col("v")).alias("also_in_train")
    )


def balanced_sample(
    samples: DataFrame, *, cell: Sequence[str], drive: str, key: str, cap: int = 4000, seed: int = 42
) -> DataFrame:
    """At most ``cap`` samples per cell, taken round by round from its drives.

    A sample's place inside its drive decides its round, so no drive dominates.
    """
    keyed = samples.withColumn("_h", hash_word(F.lit(seed), F.col(key)))
    # Filters on the rank alone let Spark keep only the first rows of a drive or cell before the shuffle.
    inner = Window.partitionBy(*cell, drive).orderBy("_h", key)
    rounds = keyed.withColumn("_round", F.row_number().over(inner)).filter(F.col("_round") <= cap)
    outer = Window.partitionBy(*cell).orderBy("_round", "_h", key)
    return rounds.withColumn("_at", F.row_number().over(outer)).filter(F.col("_at") <= cap).drop("_h", "_round", "_at")


def seeded_pick(samples: DataFrame, key: str, *, seed: int = 42) -> DataFrame:
    """One pseudo-random row, null columns when there is none."""
    pick = F.min_by(F.struct(*samples.columns), F.struct(hash_word(F.lit(seed), F.col(key)), F.col(key))).alias("r")
    return samples.agg(pick).select("r.*")


def class_sets(splits: DataFrame, *, by: str, label: str, classes: Sequence[str] = CLASSES) -> DataFrame:
    """Sorted class lists per side and whether the training side covers all classes."""
    def listed(side: str):
        return F.array_sort(F.collect_set(F.when(F.col("side") == side, F.col(label))))

    full = F.array(*[F.lit(c) for c in classes])
    out = splits.groupBy(by).agg(listed("train").alias("_t"), listed("val").alias("_v"))
    return out.select(
        by,
        F.array_join("_t", ",").alias("train_classes"),
        F.array_join("_v", ",").alias("val_classes"),
        ((F.size(F.array_except(full, "_t")) == 0) & (F.size(F.array_except("_t", full)) == 0)).alias("train_complete"),
        F.array_join(F.array_sort(F.array_except(full, "_v")), ",").alias("val_missing"),
    )


def standardiser(chunks: DataFrame, *, fold: str, channel: str, array: str = "x") -> DataFrame:
    """Mean and population deviation per (fold, channel), fitted on the other folds only.

    Each array is reduced to its moments in place; the shuffle carries one row per
    (fold, channel) and task, and folds are combined on that small table.
    """
    from drivepulse.functions.matrices import moments

    m = chunks.select(fold, channel, moments(F.col(array)).alias("m"))
    part = m.groupBy(fold, channel).agg(
        F.sum("m.n").alias("n"),
        F.sum(F.col("m.n") * F.col("m.mean")).alias("s"),
        F.sum(F.col("m.n") * (F.col("m.std") * F.col("m.std") + F.col("m.mean") * F.col("m.mean"))).alias("q"),
    )
    left = part.select(F.col(fold).alias("_held"), F.col(channel).alias("_channel")).distinct()
    joined = left.join(part, (F.col("_channel") == F.col(channel)) & (F.col("_held") != F.col(fold)))
    fit = joined.groupBy("_held", "_channel").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    return fit.select(
        F.col("_held").alias(fold), F.col("_channel").alias(channel), mean.alias("mean"),
        F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std"),
    )


def standardise(chunks: DataFrame, fitted: DataFrame, *, fold: str, channel: str, array: str = "x") -> DataFrame:
    """Apply a fitted table; a constant channel keeps scale 1."""
    scale = F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return (
        chunks.join(fitted, [fold, channel])
        .withColumn("_s", scale)
        .withColumn(array, F.transform(array, lambda v: (v - F.col("mean")) / F.col("_s")))
        .drop("mean", "std", "_s")
    )
