"""Toxicity by class-conditional Kneser-Ney models of character n-grams.

A toxic and an ordinary model give each word a likelihood, sign by sign after the four signs before
it. Both interpolate their own discounted counts with one shared lower-order distribution, built
from continuation counts (in how many contexts a shorter n-gram occurs), so that an expression that
neither class knows well gets the same backoff from both and says nothing. The shared counts come
from all documents, the class counts from the labelled rows. A text is described by its
log-likelihood ratio per sign, by its most toxic word, by how far its toxic words exceed some bars
and by its length; a logistic curve over these turns them into a score, fitted with equal weight for
both classes, so that 0.5 is where either is as likely as among equally many of both.

Signs have 12 bits, so that a 5-gram is one 60-bit integer; code points from U+1000 on share 3,071 of
them, so n-grams of such scripts may coincide. All counting and the probabilities are Spark
aggregations over such integers. What scoring needs is the log ratio of every n-gram that a labelled
row holds, and of every context: sorted by the n-gram itself and looked up exactly, so an n-gram
outside them gets its context's ratio, and without a known context the shared backoff of both classes,
whose ratio is 0. This table grows with the labelled rows, of which ``SAMPLE_ROWS`` is the bound, at 12
bytes for an n-gram; it holds one row for each different one, however often it occurs.

Class counts use about ``SAMPLE_ROWS`` labelled rows of each class (all, if fewer), chosen by hashed
id. Two halves of these rows give two models; each row used to fit the curve is scored by the model
that has not seen it. Scoring uses the counts of both halves.

Null and empty texts and texts without letters have no evidence and all features 0. Repeated label
rows of one id count once, toxic if any says so. Repeated documents are scored one by one. Without
labelled rows of both classes every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from drivepulse.llm.common import ragged, run_sums, slices, training_row
from drivepulse.session import materialise

SAMPLE_ROWS = 20_000
DISCOUNT = 0.75
ORDER = 5
BITS = 12
# Bars over which a word's log ratio is evidence of its own.
EXCESS = (1.0, 2.0, 3.0)
FEATURES = 7
THRESHOLD = 0.7
LETTERS = re.compile(r"[^\W\d_]+")
HALVES = ("t0", "o0", "t2", "o2")


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """5-grams of all words (begin and end marked by signs 1 and 2) and offsets of the words into them."""
    lengths = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    codes = np.where(codes < 1 << BITS, codes, 1024 + codes % 3071)
    sizes = lengths + ORDER
    ends = np.cumsum(sizes)
    signs = np.ones(int(ends[-1]) if len(ends) else 0, np.int64)
    signs[ragged(ends - sizes + ORDER - 1, lengths)] = codes
    signs[ends - 1] = 2
    last = ragged(ends - lengths - 1, lengths + 1)
    value = np.zeros(len(last), np.int64)
    for back in range(ORDER - 1, -1, -1):
        value = value << BITS | signs[last - back]
    return value, np.concatenate([[0], np.cumsum(lengths + 1)])


def vocabulary(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Different words, the number of each word of the texts, and offsets of the texts."""
    known: dict[str, int] = {}
    ids, sizes = [], []
    for text in texts:
        words = LETTERS.findall(text.lower())
        sizes.append(len(words))
        ids.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words)))
    return list(known), np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)])


def labelled(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, toxic, half`` of all documents; toxic and half (0 or 2) are null outside the labelled sample."""
    marks = labels.filter(training_row() & F.col("toxic").isin(0, 1)).groupBy(F.col("doc_id").alias("key")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = F.lit(0)
    for toxic, n in marks.groupBy("toxic").count().collect():
        share = F.when(F.col("toxic") == toxic, F.lit(min(1.0, rows / n))).otherwise(share)
    chosen = marks.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))
    chosen = chosen.withColumn("half", (F.crc32(F.col("key").cast("string")) % 3).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # About 2 x rows ids by construction: a broadcast of bounded size.
    return texts.join(F.broadcast(chosen), texts.doc_id == chosen.key, "left").select("doc_id", "text", "toxic", "half")


def count_grams(rows: DataFrame) -> DataFrame:
    """Counts of every 5-gram: texts of the classes in both halves (each word of a text once), all 0 where only other
    documents have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["gram", *HALVES]
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            gram, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
            counts = np.concatenate([c for _, c in found])
            return gram, np.stack([np.bincount(at, counts[:, k], len(gram)) for k in range(4)], 1)

        for batch in slices(batches, size=8 << 20):
            words, flat, at = vocabulary(batch.column(1).to_pylist())
            if not words:
                continue
            toxic, half = (batch.column(k).fill_null(-1).to_numpy() for k in (2, 3))
            kind = np.where(toxic < 0, -1, (half == 2) * 2 + (toxic == 0))
            # In how many texts of each class a word is: a text that repeats an odd word counts once.
            per_word = np.repeat(np.arange(len(kind)), np.diff(at))
            chosen = kind[per_word] >= 0
            pairs = np.unique(per_word[chosen].astype(np.int64) * len(words) + flat[chosen])
            of, word = kind[pairs // len(words)], pairs % len(words)
            uses = np.stack([np.bincount(word[of == k], minlength=len(words)) for k in range(4)], 1).astype(float)
            gram, offsets = grams(words)
            found.append((gram, np.repeat(uses, np.diff(offsets), 0)))
            found[:] = [merged()]
        if found:
            gram, counts = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(gram), *(pa.array(counts[:, k].astype(np.int64)) for k in range(4))], names)

    counted = rows.select("doc_id", "text", "toxic", "half").mapInArrow(run, "gram bigint, t0 bigint, o0 bigint, t2 bigint, o2 bigint")
    return counted.groupBy("gram").agg(*(F.sum(c).alias(c) for c in HALVES))


def shared_backoff(counts: DataFrame) -> DataFrame:
    """``tail, p``: probability of the last sign of a 4-gram after its first three, by continuation counts."""
    levels, tail = [], counts.select(F.col("gram").alias("g"))
    for size in range(ORDER - 1, 0, -1):
        tail = tail.groupBy(F.pmod("g", F.lit(1 << BITS * size)).alias("g")).agg(F.count("*").alias("n"))
        levels.append(tail)
    lower = None
    for level in reversed(levels):
        w = Window.partitionBy(F.shiftright("g", BITS))
        total, kinds = F.sum("n").over(w), F.count("*").over(w)
        size = ORDER - 1 - levels.index(level)
        if lower is None:
            below, base = level, F.lit(1 / (1 << BITS))
        else:
            below = level.withColumn("k", F.pmod("g", F.lit(1 << BITS * (size - 1)))).join(lower, "k")
            base = F.col("q")
        # n is 1 at least, so the discount never exceeds a count.
        p = (F.col("n") - DISCOUNT + DISCOUNT * kinds * base) / total
        lower = below.select(F.col("g").alias("k"), p.alias("q"))
    return lower.select(F.col("k").alias("tail"), F.col("q").alias("p"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """``gram, context`` and the log ratios of three models: each half alone and both; ``c*`` for an unseen next sign."""
    seen = counts.filter(sum(F.col(c) for c in HALVES) > 0)
    rows = seen.withColumn("tail", F.pmod("gram", F.lit(1 << BITS * (ORDER - 1)))).join(shared_backoff(counts), "tail")
    w = Window.partitionBy("context")
    rows = rows.withColumn("context", F.shiftright("gram", BITS))
    columns = []
    for name, toxic, ordinary in (("a", F.col("t0"), F.col("o0")), ("b", F.col("t2"), F.col("o2")), ("ab", F.col("t0") + F.col("t2"), F.col("o0") + F.col("o2"))):
        def model(n):
            total, kinds = F.sum(n).over(w), F.sum((n > 0).cast("int")).over(w)
            # A discount of one: what only one text has is left to the shared backoff.
            left = F.when(total > 0, kinds / total).otherwise(1.0)
            own = F.when(total > 0, F.greatest(n - 1.0, F.lit(0.0)) / total).otherwise(0.0)
            return F.ln(own + left * F.col("p")), F.ln(left)

        (p_t, l_t), (p_o, l_o) = model(toxic), model(ordinary)
        columns += [(p_t - p_o).alias(name), (l_t - l_o).alias(f"c{name}")]
    return rows.select("gram", "context", *columns)


@dataclass
class Model:
    """Log ratios of sorted n-grams and contexts, and the curve over the features."""

    grams: np.ndarray
    gram: np.ndarray
    contexts: np.ndarray
    context: np.ndarray
    curve: np.ndarray | None = None
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None


NAMES = ("a", "b", "ab")


def fit_ratios(rows: DataFrame) -> dict[str, Model]:
    """The three models; the driver receives one row for each different n-gram and context of the labelled rows."""
    ratios = materialise(log_ratios(materialise(count_grams(rows), "grams")), "ratios")

    def table(rows: DataFrame, key: str) -> tuple[np.ndarray, list[np.ndarray]]:
        found = rows.toArrow()
        keys = found.column(key).to_numpy()
        order = np.argsort(keys)
        return keys[order], [found.column(c).to_numpy()[order] for c in found.column_names if c != key]

    grams, of_gram = table(ratios.select("gram", *(F.col(c).cast("float") for c in NAMES)), "gram")
    # A context has one ratio, which all of its n-grams carry.
    each = ratios.groupBy("context").agg(*(F.max(f"c{c}").cast("float").alias(f"c{c}") for c in NAMES))
    contexts, of_context = table(each, "context")
    return {c: Model(grams, of_gram[i], contexts, of_context[i]) for i, c in enumerate(NAMES)}


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of every wanted key, not a number where there is none."""
    out = np.full(len(wanted), np.nan)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        here = keys[at] == wanted
        out[here] = values[at[here]]
    return out


def features(texts: list[str], model: Model) -> np.ndarray:
    """For every text: log ratio per sign, log ratio of its most toxic word, excess of its toxic words over each bar,
    the excess over the middle bar against the length, and the length."""
    out = np.zeros((len(texts), FEATURES))
    words, flat, at = vocabulary(texts)
    if not words:
        return out
    gram, offsets = grams(words)
    # Sorted, repeated ones once: neighbours are looked up side by side.
    asked, back = np.unique(gram, return_inverse=True)
    ratio = look_up(model.grams, model.gram, asked)
    unseen = np.isnan(ratio)
    ratio[unseen] = look_up(model.contexts, model.context, asked[unseen] >> BITS)
    ratio = np.nan_to_num(ratio, nan=0.0)[back]
    word = run_sums(ratio, offsets)
    size = np.diff(offsets)
    some = np.flatnonzero(np.diff(at))
    value = word[flat]
    out[:, 0] = run_sums(value, at) / np.maximum(1, run_sums(size[flat], at))
    out[some, 1] = np.clip(np.maximum.reduceat(value, at[:-1][some]), -20, 20)
    excess = [run_sums(np.maximum(0, value - bar), at) for bar in EXCESS]
    out[:, 2:5] = np.log1p(np.stack(excess, 1))
    number = np.diff(at)
    out[:, 5] = excess[1] / np.sqrt(np.maximum(1, number))
    out[:, 6] = np.log1p(number)
    return out


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton steps over standardised features; both classes weigh the same, however rare one is."""
    centre, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.column_stack([(x - centre) / scale, np.ones(len(x))])
    weights = np.zeros(z.shape[1])
    share = len(y) / (2 * np.maximum(1, np.bincount(y, minlength=2)))[y]
    keep = ridge * len(x) / 100 * np.append(np.ones(x.shape[1]), 0)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        slope = z.T @ (share * (p - y)) + keep * weights
        bend = (z * (share * p * (1 - p))[:, None]).T @ z + np.diag(keep) + 1e-9 * np.eye(len(weights))
        change = np.linalg.solve(bend, slope)
        weights -= change
        if np.abs(change).max() < 1e-6:
            break
    return weights, centre, scale


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model, or None without labelled rows of both classes."""
    marked = labelled(docs, labels, rows)
    models = fit_ratios(marked)
    sc = docs.sparkSession.sparkContext
    crossed = sc.broadcast({0: models["b"], 2: models["a"]})
    names = [f"x{k}" for k in range(FEATURES)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            half = batch.column(3).to_numpy()
            x = np.zeros((batch.num_rows, FEATURES))
            for h, model in crossed.value.items():
                here = np.flatnonzero(half == h)
                if len(here):
                    x[here] = features(batch.column(1).take(pa.array(here)).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([batch.column(2), *(pa.array(x[:, k]) for k in range(FEATURES))], ["toxic", *names])

    known = marked.filter("half IS NOT NULL").mapInArrow(run, "toxic int, " + ", ".join(f"{c} double" for c in names)).toArrow()
    x = np.column_stack([known.column(c).to_numpy() for c in names]).reshape(-1, FEATURES)
    y = known.column("toxic").to_numpy()
    if len(set(y.tolist())) < 2:
        return None
    order = np.lexsort([y, *x.T])  # the same sums whatever order the rows came in
    model = models["ab"]
    model.curve, model.centre, model.scale = fit_curve(x[order], y[order])
    return model


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows ``doc_id, score, predicted`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in slices(batches, size=8 << 20):
            p = np.zeros(batch.num_rows)
            if model is not None:
                z = (features(batch.column(1).to_pylist(), model) - model.centre) / model.scale
                p = 1 / (1 + np.exp(-np.clip(z @ model.curve[:-1] + model.curve[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    scored = texts.mapInArrow(run, "doc_id bigint, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
