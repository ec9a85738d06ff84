"""Baselines without a rollout: one call, or a fixed chain of answer, critique and improvement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.functions.parsing import final_answer, final_paren_number
from askloop.functions.text import exact_match, normalize_answer
from askloop.operators.prompts import CRITIC_STEPS, MAX_TOKENS, SAMPLING, initial_content, with_prompt
from askloop.schemas import KEYS
from askloop.session import materialize


def zero_shot(
    qa: DataFrame, model, question_type: str = "OEQ", abstain: bool = False, prompts: DataFrame | None = None,
    path: str | None = None,
) -> DataFrame:
    """Ask once, with or without the choice to abstain, and grade. Written once (to ``path``): the model is asked once."""
    asked = qa.select(
        *KEYS,
        "question",
        "gold",
        F.lit(question_type).alias("question_type"),
        initial_content(F.col("question"), "zero_shot").alias("task_content"),
    )
    asked = with_prompt(asked, "abstain" if abstain else "first", "zero_shot", prompts)
    answered = model.respond(asked, 0)
    answer = F.lower(final_answer(F.col("response"), F.col("question_type")))
    graded = answered.select(
        *KEYS,
        "question",
        "gold",
        normalize_answer(answer).alias("answer"),
        exact_match(answer, F.col("gold")).alias("correct"),
    )
    return materialize(graded, "zero-shot", path)


def critic_settings() -> dict[str, Column]:
    temperature, top_p = SAMPLING["self_critic", "critic"]
    return {"temperature": F.lit(temperature), "top_p": F.lit(top_p), "max_tokens": F.lit(MAX_TOKENS)}


def self_critic(qa: DataFrame, model, compat: bool = False, path: str | None = None) -> DataFrame:
    """Five chained calls; the first, third and fifth give an answer each.

    The transcript ends before the last response. Each call is written before the next one is built on it, the last one
    in its final form (to ``path``).
    """
    settings = critic_settings()
    state = qa.select(*KEYS, "question", "gold", initial_content(F.col("question"), "self_critic").alias("task_content"))
    for call, text, answer_no in CRITIC_STEPS:
        if call > 1:
            grown = F.concat("task_content", F.lit("\n"), F.coalesce("response", F.lit("")), F.lit("\n" + text))
            state = state.withColumn("task_content", grown).drop("response")
        else:
            state = state.withColumn("task_content", F.concat("task_content", F.lit(text)))
        state = model.respond(state.withColumns(settings), call).drop(*settings)
        if answer_no:
            number = final_paren_number(F.coalesce("response", F.lit("")), compat)
            answer = F.when(number.isNotNull(), normalize_answer(number))
            state = state.withColumn(f"answer_{answer_no}", answer).withColumn(
                f"correct_{answer_no}",
                F.when(F.col(f"answer_{answer_no}").isNull(), 0).otherwise(
                    exact_match(F.col(f"answer_{answer_no}"), F.col("gold"))
                ),
            )
        if call < len(CRITIC_STEPS):
            state = materialize(state, f"self-critic-{call}")
    answers = [f"{name}_{n}" for name in ("answer", "correct") for n in (1, 2, 3)]
    done = state.select(*KEYS, "question", "gold", *answers, F.col("task_content").alias("transcript"))
    return materialize(done, "self-critic", path)


def answer_sets(df: DataFrame) -> DataFrame:
    """The three answers of a self-critic row as three rows ``dataset, split, id, answer_no, answer, correct``."""
    stacked = "stack(3, 1, answer_1, correct_1, 2, answer_2, correct_2, 3, answer_3, correct_3)"
    return df.selectExpr(*KEYS, "gold", f"{stacked} as (answer_no, answer, correct)")
