"""The accept/reject gate: fit, apply, report, save and load.

There are two: ``Gate``, a Spark ML pipeline, and ``WeightGate``, a table of one weight a feature. A feature of the latter is a
word's place among ``features`` by its md5, so it is the same in every engine; a text holds each of its features once, in
equal parts of length 1, and the bias -1. It is fitted by a fixed number of full-batch gradient steps: a step is one pass
over the rows, whose tasks add up their share of the gradient, so a row for each task and feature is all that is shuffled
and the rows stay where they are. Weights number at most ``features`` and are shipped to the tasks; nothing else is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop.functions.text import word_tokens
from askloop.operators.metrics import class_report
from askloop.operators.prompts import gate_input
from askloop.session import materialize


@dataclass(frozen=True)
class GateConfig:
    features: int = 1 << 18
    # Strengths of regularisation tried; the one with the best development accuracy is kept.
    penalties: tuple[float, ...] = (0.0, 0.01, 0.1)
    max_iter: int = 50
    # Class weights for a weighted fit.
    weight_reject: float = 1.0
    weight_accept: float = 1.0


@dataclass(frozen=True)
class StepConfig:
    """Settings of a ``WeightGate``."""

    features: int = 1 << 18
    steps: int = 50
    rate: float = 4.0
    penalty: float = 1e-4
    weight_reject: float = 1.0
    weight_accept: float = 1.0


class _Judge:
    """What gates have in common: they judge a rollout turn by ``apply``, with their text template, and report on labelled text."""

    setting: str

    def judge(self, df: DataFrame, turn: int) -> DataFrame:
        """The gate as the judge of a rollout turn."""
        text = gate_input(F.col("task_content"), F.col("raw_answer"), F.col("rationale"), self.setting)
        return self.apply(df.withColumn("_input", text), "_input").drop("_input")

    def evaluate(self, df: DataFrame, label: str = "label") -> DataFrame:
        """Accuracy and per-class precision, recall and F1 on labelled text."""
        judged = self.apply(df)
        return class_report(judged.withColumn("_said", F.col("gate_output").cast("int").cast("string")), label, "_said")


class Gate(_Judge):
    """A fitted gate. ``setting`` is the text template it was trained with and must be applied with."""

    def __init__(self, model: PipelineModel, setting: str = "exploration"):
        self.model, self.setting, self.name = model, setting, model.uid

    def apply(self, df: DataFrame, text: str = "input") -> DataFrame:
        """Add ``gate_output`` and both class confidences to rows with an input text."""
        scored = self.model.transform(df.withColumn("_text", F.coalesce(text, F.lit(""))))
        share = vector_to_array("probability")
        return scored.select(
            *df.columns,
            (F.col("prediction") == 1.0).alias("gate_output"),
            share[0].alias("confidence_0"),
            share[1].alias("confidence_1"),
        )

    def save(self, base_path: str, experiment: str) -> None:
        self.model.write().overwrite().save(f"{base_path}/{experiment}/{self.setting}")

    @classmethod
    def load(cls, base_path: str, experiment: str, setting: str = "exploration") -> Gate:
        return cls(PipelineModel.load(f"{base_path}/{experiment}/{setting}"), setting)


def fit_gate(
    train: DataFrame, dev: DataFrame, config: GateConfig | None = None, setting: str = "exploration"
) -> tuple[Gate, float]:
    """Fit on ``input``/``label`` text and return the gate with the best development accuracy, and that accuracy."""
    config = config or GateConfig()

    def prepared(df: DataFrame) -> DataFrame:
        klass = F.col("label").cast("double")
        weight = F.when(klass == 1.0, config.weight_accept).otherwise(config.weight_reject)
        return df.select(F.coalesce("input", F.lit("")).alias("_text"), klass.alias("_class"), weight.alias("_weight"))

    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[\p{L}\p{N}_]+", gaps=False)
    counts = HashingTF(inputCol="_words", outputCol="_counts", numFeatures=config.features)
    weights = IDF(inputCol="_counts", outputCol="features")
    featured = Pipeline(stages=[words, counts, weights]).fit(prepared(train))
    # The features are the input of every fit and every iteration.
    fit_on = featured.transform(prepared(train)).select("features", "_class", "_weight").persist()
    test_on = featured.transform(prepared(dev)).select("features", "_class").persist()
    best, best_accuracy = None, -1.0
    for penalty in config.penalties:
        learner = LogisticRegression(labelCol="_class", weightCol="_weight", regParam=penalty, maxIter=config.max_iter)
        model = learner.fit(fit_on)
        hits = F.avg((F.col("prediction") == F.col("_class")).cast("double"))
        accuracy = model.transform(test_on).agg(hits.alias("a")).first()["a"] or 0.0
        if accuracy > best_accuracy:
            best, best_accuracy = model, accuracy
    fit_on.unpersist()
    test_on.unpersist()
    return Gate(PipelineModel(stages=[*featured.stages, best]), setting), best_accuracy


# --- A gate as a table ------------------------------------------------------------------------------------------------

BIAS = -1
#: Features of a batch that are worked on at a time.
STRETCH = 1 << 18
WEIGHTS = "feature bigint, weight double, features bigint"


def word_features(text: Column, features: int) -> Column:
    """The different features of a text's words."""
    place = F.transform(word_tokens(F.coalesce(text, F.lit(""))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint"))
    return F.array_distinct(F.transform(place, lambda p: p % F.lit(features)))


def _stretches(held: pa.ListArray) -> Iterator[slice]:
    """Some texts in stretches of about ``STRETCH`` features, a text at least, so that memory does not grow with a batch."""
    ends = np.cumsum(held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    low = 0
    while low < len(ends):
        before = ends[low - 1] if low else 0
        high = max(low + 1, int(np.searchsorted(ends, before + STRETCH, "right")))
        yield slice(low, high)
        low = high


def _margins(held: pa.ListArray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts the margins, and of their features the numbers, the values and the texts."""
    sizes = held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    feature, text = held.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(held)), sizes)
    value = 1 / np.sqrt(sizes[text])
    return bias + np.bincount(text, value * weights[feature], len(held)), feature, value, text


def _accepted(held: pa.ListArray, weights: np.ndarray, bias: float) -> pa.Array:
    """How surely some texts are accepted."""
    margins = [_margins(held[some], weights, bias)[0] for some in _stretches(held)]
    return pa.array(_sigmoid(np.concatenate([np.zeros(0), *margins])))


class WeightGate(_Judge):
    """A gate of one weight a feature, as (feature, weight); a feature without a row weighs nothing."""

    def __init__(self, weights: dict[int, float], features: int, setting: str = "exploration", name: str = "weights"):
        self.weights, self.features, self.setting, self.name = weights, features, setting, name

    def dense(self) -> np.ndarray:
        out = np.zeros(self.features)
        kept = {f: w for f, w in self.weights.items() if f != BIAS}
        out[list(kept)] = list(kept.values())
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        rows = pa.table({"feature": list(self.weights), "weight": list(self.weights.values()), "features": [self.features] * len(self.weights)})
        return spark.createDataFrame(rows.cast(pa.schema([("feature", pa.int64()), ("weight", pa.float64()), ("features", pa.int64())])))

    def apply(self, df: DataFrame, text: str = "input") -> DataFrame:
        """Add ``gate_output`` and both class confidences to rows with an input text. Rows stay where they are."""
        weights, bias = self.dense(), self.weights.get(BIAS, 0.0)

        @F.arrow_udf("double")
        def accepts(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for part in parts:
                yield _accepted(part, weights, bias)

        scored = df.withColumn("_one", accepts(word_features(F.col(text), self.features)))
        one = F.col("_one")
        return scored.select(*df.columns, (one > 0.5).alias("gate_output"), (1 - one).alias("confidence_0"), one.alias("confidence_1"))

    def save(self, spark: SparkSession, base_path: str, experiment: str) -> None:
        self.table(spark).coalesce(1).write.mode("overwrite").parquet(f"{base_path}/{experiment}/{self.setting}")

    @classmethod
    def load(cls, spark: SparkSession, base_path: str, experiment: str, setting: str = "exploration") -> WeightGate:
        """The gate saved under the experiment's name; at most ``features`` rows and the bias are read."""
        rows = spark.read.schema(WEIGHTS).parquet(f"{base_path}/{experiment}/{setting}").collect()
        return cls({r.feature: r.weight for r in rows}, rows[0].features, setting, experiment)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def _gradient(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    """A task's share of the gradient, as (feature, slope), from its (features, class, vote)."""
    slope, lean, seen = np.zeros(len(weights)), 0.0, np.zeros(len(weights), bool)
    for batch in batches:
        held, klass, vote = batch.column(0), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for some in _stretches(held):
            margins, feature, value, text = _margins(held[some], weights, bias)
            error = vote[some] * (_sigmoid(margins) - klass[some])
            slope += np.bincount(feature, value * error[text], len(weights))
            seen[feature] = True
            lean += error.sum()
    held = np.flatnonzero(seen)
    yield pa.record_batch({
        "feature": pa.array([BIAS, *held.tolist()], pa.int64()), "slope": pa.array([lean, *slope[held].tolist()], pa.float64())
    })


def fit_steps(train: DataFrame, config: StepConfig | None = None, setting: str = "exploration", name: str = "weights") -> WeightGate:
    """Fit on ``input``/``label`` text: ``steps`` steps of size ``rate`` down the weighted mean of the logistic loss.

    The penalty draws every weight, the bias too, towards nothing. Rows without a label have no vote; without any labelled
    row all weights are 0.
    """
    config = config or StepConfig()
    klass = F.col("label").cast("double")
    vote = F.when(klass == 1.0, config.weight_accept).otherwise(config.weight_reject)
    rows = train.filter(klass.isNotNull()).select(word_features(F.col("input"), config.features).alias("features"), klass.alias("class"), vote.alias("vote"))
    rows = materialize(rows, "gate-rows")
    total = rows.agg(F.sum("vote")).first()[0]
    gate = WeightGate({BIAS: 0.0}, config.features, setting, name)
    for _ in range(config.steps if total else 0):
        weights, bias = gate.dense(), gate.weights[BIAS]
        parts = rows.mapInArrow(lambda batches: _gradient(batches, weights, bias), "feature bigint, slope double")
        slopes = parts.groupBy("feature").agg(F.sum("slope").alias("slope")).collect()
        gate.weights = {
            r.feature: (1 - config.rate * config.penalty) * gate.weights.get(r.feature, 0.0) - config.rate * r.slope / total for r in slopes
        }
    return gate
