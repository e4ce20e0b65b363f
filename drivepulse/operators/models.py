"""Training per slot, model store, batch scoring, fusion and staged decisions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from drivepulse.functions.domains import CLASSES
from drivepulse.functions.scalars import argmax0, decode_label, let, lookup, pick, softmax
from drivepulse.operators.evaluation import macro_f1


def train(
    features: DataFrame, *, label: str = "cls", column: str = "features", c: float = 1.0, balanced: bool = True, max_iter: int = 1000
) -> LogisticRegressionModel:
    """Multinomial L2 logistic regression on an array column of label ids.

    The penalty is per sample in MLlib, so 1/(C · Σw) equals the usual C.
    """
    counts = {r[0]: r[1] for r in features.groupBy(label).count().collect()}  # one row per class
    if not counts:
        raise ValueError("no samples to train on")
    # Balanced weights n / (k · n_c) add up to n, as unit weights do.
    total = sum(counts.values())
    shares = {int(k): total / (len(counts) * n) for k, n in counts.items()}
    data = features.select(
        F.col(label).cast("double").alias("label"),
        array_to_vector(F.col(column).cast("array<double>")).alias("v"),
        (lookup(shares, F.col(label).cast("int")) if balanced else F.lit(1.0)).alias("w"),
    )
    lr = LogisticRegression(
        featuresCol="v", labelCol="label", family="multinomial", regParam=1.0 / (c * total), elasticNetParam=0.0,
        standardization=False, maxIter=max_iter, weightCol="w",
    )
    return lr.fit(data)


def train_slots(
    features: DataFrame, slots: Sequence[str], *, slot: str = "sensor", parallel: int = 3, **kw
) -> dict[str, LogisticRegressionModel]:
    """One model per slot; a few slots train at the same time."""
    def one(name: str):
        return name, train(features.filter(F.col(slot) == name), **kw)

    with ThreadPool(parallel) as pool:
        return dict(pool.map(one, slots))


class ModelStore:
    """Models in folders ``slot=…`` below a shared root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._loaded: dict[str, LogisticRegressionModel] = {}

    def _path(self, slot: str) -> str:
        return f"{self.root}/slot={slot}"

    def save(self, models: Mapping[str, LogisticRegressionModel]) -> None:
        """Each slot has a folder and an entry of its own; entries of other slots stay."""
        for slot, model in models.items():
            model.write().overwrite().save(self._path(slot))
            self._loaded[slot] = model
            row = [(model.numFeatures, model.numClasses)]
            self.spark.createDataFrame(row, "features int, classes int").write.mode("overwrite").parquet(
                f"{self.root}/models/slot={slot}"
            )

    def table(self) -> DataFrame:
        return self.spark.read.schema("features int, classes int, slot string").parquet(f"{self.root}/models")

    def load(self, slot: str) -> LogisticRegressionModel:
        if slot not in self._loaded:
            try:
                known = {r["slot"]: r for r in self.table().collect()}  # one row per model
            except AnalysisException:
                raise FileNotFoundError(f"no models below {self.root}") from None
            if slot not in known:
                raise KeyError(f"unknown slot {slot!r}, have {sorted(known)}")
            model = LogisticRegressionModel.load(self._path(slot))
            if model.numFeatures != known[slot]["features"]:
                raise ValueError(f"model of slot {slot!r} does not match its entry")
            self._loaded[slot] = model
        return self._loaded[slot]

    def load_all(self, slots: Sequence[str]) -> dict[str, LogisticRegressionModel]:
        return {s: self.load(s) for s in slots}


def coefficient_table(spark: SparkSession, models: Mapping[str, LogisticRegressionModel]) -> DataFrame:
    """One row per slot with weights per class: rows and size are fixed by the slots."""
    rows = [
        (s, [list(map(float, r)) for r in m.coefficientMatrix.toArray()], [float(v) for v in m.interceptVector])
        for s, m in models.items()
    ]
    return spark.createDataFrame(rows, "slot string, weights array<array<double>>, intercepts array<double>")


def linear_probabilities(
    features: DataFrame, coefficients: DataFrame, *, slot: str = "sensor", column: str = "features", out: str = "probs"
) -> DataFrame:
    """Softmax of the linear scores of each row's slot, all slots in one pass.

    The planner knows the bytes of the coefficients and broadcasts them where they are few; else
    adaptive execution splits hot slots.
    """
    table = coefficients.withColumnRenamed("slot", slot)

    def dot(w: Column, x: Column) -> Column:
        return F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)

    def scores(x: Column) -> Column:
        return F.zip_with("weights", "intercepts", lambda w, b: dot(w, x) + b)

    logits = let(F.col(column).cast("array<double>"), scores)
    return features.join(table, slot).withColumn(out, softmax(logits)).drop("weights", "intercepts")


def score_models(features: DataFrame, models: Mapping[str, LogisticRegressionModel], *, slot: str = "sensor", column: str = "features") -> DataFrame:
    """Scoring with the stored models themselves, slot by slot."""
    parts = []
    for name, model in models.items():
        rows = features.filter(F.col(slot) == name).withColumn("v", array_to_vector(F.col(column).cast("array<double>")))
        # The stored model remembers its input column only.
        scored = model.copy({model.featuresCol: "v"}).transform(rows)
        parts.append(
            scored.select(*features.columns, vector_to_array("probability").alias("probs"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def verdicts(scored: DataFrame, *, slot: str = "sensor", probs: str = "probs", prefix: str = "pilot_") -> DataFrame:
    """Predicted label, top probability, anomaly score, class map and model key."""
    p = F.col(probs)
    return scored.withColumns(
        {
            "predicted_id": argmax0(p),
            "predicted_label": decode_label(argmax0(p)),
            "top_prob": F.array_max(p),
            "anomaly_score": F.lit(1.0) - F.get(p, F.lit(0)),
            "class_probs": F.map_from_arrays(F.array(*[F.lit(c) for c in CLASSES]), p),
            "model_key": F.concat(F.lit(prefix), F.lower(slot)),
        }
    )


def late_fusion(scored: DataFrame, *, session: Sequence[str], probs: str = "probs", classes: Sequence[str] = CLASSES) -> DataFrame:
    """Mean of the sensors' probabilities per session, then the best class."""
    means = [F.avg(F.get(probs, F.lit(i))).alias(f"_p{i}") for i in range(len(classes))]
    fused = scored.groupBy(*session).agg(F.count(F.lit(1)).alias("n_sensors"), *means)
    merged = F.array(*[F.col(f"_p{i}") for i in range(len(classes))])
    return fused.select(*session, "n_sensors", merged.alias(probs)).withColumn(
        "predicted_label", pick(classes, argmax0(F.col(probs)))
    )


def two_stage(scored: DataFrame, *, probs: str = "probs", specialist: str = "p_demag", limit: float = 0.5) -> DataFrame:
    """Where the general model says NORMAL or DEMAG, a DEMAG/NORMAL specialist decides."""
    first = decode_label(argmax0(F.col(probs)))
    second = F.when(F.col(specialist) > limit, "DEMAG").otherwise("NORMAL")
    return scored.withColumn("first_label", first).withColumn(
        "predicted_label", F.when(F.col("first_label").isin("NORMAL", "DEMAG"), second).otherwise(F.col("first_label"))
    )


def probe(features: DataFrame, column: str, *, label: str = "cls", fold: str = "fold", held: Sequence[int] = (0,), max_iter: int = 100) -> DataFrame:
    """Macro-F1 of a linear model on one number: a shortcut check. Each held fold is scored by a model of the others."""
    single = features.withColumn("features", F.array(F.col(column).cast("double")))
    fitted = {str(k): train(single.filter(F.col(fold) != k), label=label, max_iter=max_iter) for k in held}
    table = coefficient_table(features.sparkSession, fitted)
    test = single.filter(F.col(fold).isin(*held)).withColumn("_held", F.col(fold).cast("string"))
    scored = linear_probabilities(test, table, slot="_held").withColumn("slot", F.lit("probe")).select(
        "slot", decode_label(F.col(label).cast("int")).alias("true_label"),
        decode_label(argmax0(F.col("probs"))).alias("predicted_label"),
    )
    return macro_f1(scored, ["slot"])


def centroid_coefficients(features: DataFrame, *, slot: str = "sensor", label: str = "cls", column: str = "features", width: int, classes: int = 5) -> DataFrame:
    """Nearest-centroid weights: logit = μ·x − |μ|²/2, from one grouped average.

    A closed-form linear model with the same table layout as the trained ones.
    """
    means = features.groupBy(F.col(slot).alias("slot"), F.col(label).alias("_c")).agg(
        F.array(*[F.avg(F.get(column, F.lit(i))) for i in range(width)]).alias("w")
    )
    gathered = means.groupBy("slot").agg(F.array_sort(F.collect_list(F.struct("_c", "w"))).alias("rows"))
    half = F.transform("rows", lambda r: F.aggregate(r["w"], F.lit(0.0), lambda a, v: a + v * v) * -0.5)
    return gathered.filter(F.size("rows") == classes).select(
        "slot", F.transform("rows", lambda r: r["w"]).alias("weights"), half.alias("intercepts")
    )
