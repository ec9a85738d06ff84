"""The stages as jobs: read a table, run an operator, write the result and append to the run log.

Tables are Parquet folders; use ``askloop.sources.tables`` for CSV at the edges. Each job returns the table it wrote,
read back, which is the input of the next. A rollout writes its turns straight under ``out_path`` and is resumed by
running it again with the same ``run_id``; without one each call is a run of its own. Reports have a row for each data set
and replace what the log holds of the same run and stage.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from askloop.operators import baselines, metrics, trainset
from askloop.operators.gate import Gate, GateConfig, StepConfig, WeightGate, fit_gate, fit_steps
from askloop.operators.rollout import RolloutConfig, run_gated, run_graded, settled
from askloop.sources.tables import append_metrics, read_qa, read_qa_slice


def _write(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    fields = [f for f in df.schema if f.name not in partitions] + [df.schema[p] for p in partitions]
    return df.sparkSession.read.schema(StructType(fields)).parquet(path)


def _log(report: DataFrame, log_path: str | None, run_id: str, stage: str, by: str | None = None) -> None:
    if log_path:
        append_metrics(metrics.to_long(report, run_id, stage, by), log_path)


def generate(
    spark: SparkSession, qa_path: str, out_path: str, model, config: RolloutConfig,
    log_path: str | None = None, start: int = 0, end: int | None = None,
) -> DataFrame:
    """Graded rollout over a slice of all stored questions, counted through the whole source, with its statistics logged."""
    config = settled(replace(config, base_path=out_path), "graded")
    questions = read_qa_slice(spark, qa_path, start, end) if start or end is not None else read_qa(spark, qa_path)
    generated = run_graded(questions, model, config)
    if log_path:
        by, run_id = ["dataset"], config.run_id
        _log(generated.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows")), log_path, run_id, "generated")
        _log(metrics.turn_by_verdict(generated, by), log_path, run_id, "verdict, turn", "turn")
        _log(metrics.first_turn_metrics(generated, config.setting, "verdict", by), log_path, run_id, "zero-shot")
        _log(metrics.accuracy(generated, "verdict", by), log_path, run_id, "system")
    return generated


def prepare_training(
    generated: DataFrame, out_path: str, log_path: str | None = None, run_id: str = "training",
    share: float = trainset.DEV_SHARE, seed: int = trainset.SEED,
) -> DataFrame:
    """Balance the classes of a graded rollout and split its questions into train and dev."""
    training = generated.withColumnRenamed("verdict", "gate_verdict")
    balanced = _write(trainset.balance(training, seed=seed), f"{out_path}/balanced")
    split = _write(trainset.group_split(balanced, share=share, seed=seed), f"{out_path}/sides", "side")
    for name, table in (("generated", training), ("balanced", balanced)):
        _log(_class_report(trainset.class_distribution(table, by=("dataset",))), log_path, run_id, name)
    for side in ("train", "dev"):
        _log(_class_report(trainset.class_distribution(split.filter(F.col("side") == side), by=("dataset",))), log_path, run_id, side)
    return split


def _class_report(counts: DataFrame) -> DataFrame:  # counts by data set and class
    def count(*labels: int):
        return F.coalesce(F.sum(F.when(F.col("gate_verdict").isin(*labels), F.col("n"))), F.lit(0)).cast("bigint")

    return counts.groupBy("dataset").agg(count(0, 1).alias("n_rows"), count(0).alias("n_reject"), count(1).alias("n_accept"))


def join_training(
    sets: list[DataFrame], out_path: str, log_path: str | None = None, run_id: str = "joint"
) -> DataFrame:
    """Union of several data sets' training tables, by side."""
    joint = _write(trainset.join_sets(*sets), out_path, "side")
    sizes = joint.groupBy("side", "dataset").agg(F.count(F.lit(1)).alias("n_rows"))
    for side in ("train", "dev"):
        _log(sizes.filter(F.col("side") == side).select("dataset", "n_rows"), log_path, run_id, side)
    return joint


def train_gate(
    split: DataFrame, base_path: str, experiment: str, setting: str = "exploration",
    config: GateConfig | StepConfig | None = None, eval_only: bool = False, log_path: str | None = None,
) -> Gate | WeightGate:
    """Fit a gate and save it under the experiment's name, or load the saved one; log its development report.

    A ``StepConfig`` asks for a table of weights, anything else for a Spark ML pipeline.
    """
    rows = trainset.to_instruct(split, setting=setting, keep=("side",))
    train, dev = (rows.filter(F.col("side") == side) for side in ("train", "dev"))
    spark = split.sparkSession
    if isinstance(config, StepConfig):
        if not eval_only:
            fit_steps(train, config, setting, experiment).save(spark, base_path, experiment)
        gate = WeightGate.load(spark, base_path, experiment, setting)
    elif eval_only:
        gate = Gate.load(base_path, experiment, setting)
    else:
        gate, _ = fit_gate(train, dev, config, setting)
        gate.save(base_path, experiment)
    _log(gate.evaluate(dev), log_path, experiment, "gate")
    return gate


def infer(
    spark: SparkSession, qa_path: str, out_path: str, model, gate, config: RolloutConfig, log_path: str | None = None
) -> DataFrame:
    """Gated rollout over the questions, with all its evaluation tables logged."""
    config = settled(replace(config, base_path=out_path), "gated")
    predictions = run_gated(read_qa(spark, qa_path), model, gate, config)
    if log_path:
        by, run_id = ["dataset"], config.run_id
        _log(metrics.custom_evaluation(predictions, by), log_path, run_id, "evaluation,", "scope")
        _log(metrics.turn_by_gate(predictions, by), log_path, run_id, "gate, turn", "turn")
        _log(metrics.turn_by_correct(predictions, by), log_path, run_id, "correct, turn", "turn")
        _log(metrics.group_sizes(predictions, by), log_path, run_id, "questions, turns", "turns")
        _log(metrics.first_turn_metrics(predictions, config.setting, by=by), log_path, run_id, "zero-shot")
        _log(evaluate(predictions, by), log_path, run_id, "comparison")
    return predictions


def evaluate(predictions: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Zero-shot (first turn) against final (last turn) accuracy and formula score."""
    return metrics.compare_report(predictions, by)


def zero_shot(
    spark: SparkSession, qa_path: str, out_path: str, model, question_type: str = "OEQ", abstain: bool = False,
    log_path: str | None = None, run_id: str = "zero-shot",
) -> DataFrame:
    done = baselines.zero_shot(read_qa(spark, qa_path), model, question_type, abstain, path=out_path)
    _log(metrics.zero_shot_report(done, by=["dataset"]), log_path, run_id, "zero-shot")
    return done


def self_critic(
    spark: SparkSession, qa_path: str, out_path: str, model, log_path: str | None = None, run_id: str = "self-critic"
) -> DataFrame:
    done = baselines.self_critic(read_qa(spark, qa_path), model, path=out_path)
    scores = metrics.answer_set_scores(baselines.answer_sets(done), by=["dataset"])
    for number in (1, 2, 3):
        chosen = scores.filter(F.col("answer_no") == number).select("dataset", "accuracy", "formula_avg")
        _log(chosen, log_path, run_id, f"answer {number}")
    return done
