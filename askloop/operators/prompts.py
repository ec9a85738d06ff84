"""Task contents, chat messages, retry contexts and the prompt tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop.functions.parsing import GOLD_MARKS
from askloop.functions.text import normalize_answer

SETTINGS = ["gradual", "exploration", "zero_shot"]
QUESTION_TYPES = ["MCQ", "MATH", "OEQ"]

PROMPTS = (
    "setting string, question_type string, phase string, system string, "
    "temperature double, top_p double, max_tokens int"
)

# Sampling settings per (setting, phase) as (temperature, top_p), and the longest response.
SAMPLING = {
    ("gradual", "first"): (0.6, 0.9),
    ("gradual", "force"): (0.6, 0.9),
    ("exploration", "first"): (0.1, 0.9),
    ("exploration", "retry"): (0.6, 0.7),
    ("exploration", "force"): (0.1, 0.9),
    ("zero_shot", "first"): (0.1, 0.9),
    ("zero_shot", "abstain"): (0.1, 0.9),
    ("self_critic", "critic"): (0.0, 0.9),
}
MAX_TOKENS = 256
# Prompts are written into the plan; a user's table may hold this many question types for one phase of one setting.
MOST_TYPES = 1_000

# Fixed value: the instruction in front of every gate input, which a trained gate expects word for word.
GATE_INSTRUCTION = (
    "Instruction: Predict if the following answer to the question and context should be accepted, 1, or rejected, 0,"
    " based on the rationale."
)

# The prompt texts are ours; a user passes another table with the PROMPTS schema to replace them.
_FORMAT = (
    "\nReply in exactly this form and add nothing else:\nAnswer: [your answer{alternative}]\n"
    "Rationale: [your reasons, on one line]\n"
)
_TASK = {
    "MCQ": "Pick the best of the numbered choices and answer with its number. Say briefly why.",
    "MATH": (
        "Work the problem out step by step. Example: Q: A box holds 4 rows of 6 eggs and 5 eggs break. How many are "
        "whole? A: 4 * 6 = 24 eggs, and 24 - 5 = 19. The answer is 19. "
        "End with one sentence of the form 'The answer is __'."
    ),
    "OEQ": "Answer the question and say briefly why.",
}
_RETRY = (
    " Earlier attempts are shown, each followed by 'Wrong answer! Try again.' They were wrong even where they looked "
    "right: take a different line of reasoning and do not repeat them."
)
_STEPWISE = " Go step by step, and let every step support the final answer."
_ABSTAIN = {"MCQ": "none of the above", "MATH": "unsure", "OEQ": "unsure"}
_FORCE = {
    "MCQ": "The correct answer is given at the end. Repeat its number, then explain why it is correct.",
    "MATH": "The correct answer is {answer}. Explain the steps that lead to it and end with 'The answer is {answer}.'",
    "OEQ": "The correct answer is '{answer}'. Repeat it word for word as your answer, then explain why it is correct.",
}

GENERIC_FEEDBACK = (
    "Env: That response was not good enough. Use what was found so far and try a new line of reasoning."
)
REPEAT_FEEDBACK = (
    "Env: The same response was already given and is not accepted. Change the answer, or at least how it is put, and "
    "reason along a different line."
)

_CRITIC_ASK = (
    "Explain your reasoning, choose exactly one of the options above, and end your response with its number in "
    "parentheses, as (answer)."
)
_CRITIC_REVIEW = "Look over your previous answer and name the problems with it."
_CRITIC_IMPROVE = (
    "Use the problems you named to improve your answer. Choose exactly one of the options above and end your response "
    "with its number in parentheses, as (answer)."
)
# The five calls of the self-critic chain: (call, text added before it, number of the answer it gives).
CRITIC_STEPS = [
    (1, _CRITIC_ASK, 1),
    (2, _CRITIC_REVIEW, None),
    (3, _CRITIC_IMPROVE, 2),
    (4, _CRITIC_REVIEW, None),
    (5, _CRITIC_IMPROVE, 3),
]


def _system_text(setting: str, question_type: str, phase: str) -> str:
    if phase == "force":
        text = _FORCE[question_type]
    else:
        text = _TASK[question_type]
        if setting == "gradual" and question_type != "MATH":
            text += _STEPWISE
        if phase == "retry":
            text += _RETRY
    other = f" or '{_ABSTAIN[question_type]}' if you do not know" if phase == "abstain" else ""
    if question_type == "MATH":
        return text + (f" You may also answer{other}." if other else "")
    return text + _FORMAT.format(alternative=other)


def _prompt_rows() -> list[tuple]:
    return [
        (setting, question_type, phase, _system_text(setting, question_type, phase), *sampling, MAX_TOKENS)
        for (setting, phase), sampling in SAMPLING.items()
        if setting in SETTINGS
        for question_type in QUESTION_TYPES
    ]


def default_prompts(spark: SparkSession) -> DataFrame:
    """One row per (setting, question_type, phase): system text with an optional ``{answer}`` slot, and sampling.

    The table to start from when writing one's own.
    """
    return spark.createDataFrame(_prompt_rows(), PROMPTS)


def with_prompt(df: DataFrame, phase: str, setting: str, prompts: DataFrame | None = None) -> DataFrame:
    """Add ``system``, ``temperature``, ``top_p`` and ``max_tokens`` for the question type of each row.

    One phase of one setting has a row per question type, so the choice is a few literals in the projection. Two rows
    for one type, or more than ``MOST_TYPES`` rows, are an error.
    """
    names = ["system", "temperature", "top_p", "max_tokens"]
    if prompts is None:
        rows = [row[1:2] + row[3:] for row in _prompt_rows() if (row[0], row[2]) == (setting, phase)]
    else:
        table = prompts.filter((F.col("setting") == setting) & (F.col("phase") == phase)).select("question_type", *names)
        rows = table.head(MOST_TYPES + 1)
    if len(rows) > MOST_TYPES or len({row[0] for row in rows}) < len(rows):
        raise ValueError(f"{setting}, {phase}: one prompt for each question type and at most {MOST_TYPES} are needed")
    chosen = df.withColumns({name: _choose(rows, k + 1) for k, name in enumerate(names)})
    gold = F.coalesce(F.get(F.col("gold"), F.lit(0)), F.lit(""))
    return chosen.withColumn("system", F.replace(F.col("system"), F.lit("{answer}"), gold))


def _choose(rows: list, place: int) -> Column:
    options = [F.when(F.col("question_type") == row[0], F.lit(row[place])) for row in rows]
    return F.coalesce(*options, F.lit(None))


def initial_content(question: Column, setting: str) -> Column:
    """The first user message: fixed formats."""
    if setting == "zero_shot":
        return F.concat(F.lit("Question: "), question, F.lit("\n"))
    if setting == "self_critic":
        return F.concat(F.lit("Q: "), question, F.lit("\n"))
    return F.concat(F.lit("Q: "), question, F.lit(" \n"))


def chat_messages(system: Column | None, content: Column) -> Column:
    """``array<struct<role, content>>``; without a system text the user message stands alone."""
    user = F.struct(F.lit("user").alias("role"), content.alias("content"))
    if system is None:
        return F.array(user)
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), user)


def gradual_context(turn: Column, answer: Column, rationale: Column, previous: Column) -> Column:
    """What a rejected turn adds to the task content: the answer, the reasons and feedback.

    The feedback is stronger if the answer equals the one of the turn before ("" before the first turn).
    """
    answer, rationale = F.coalesce(answer, F.lit("")), F.coalesce(rationale, F.lit(""))
    repeated = normalize_answer(answer) == normalize_answer(F.coalesce(previous, F.lit("")))
    number = turn.cast("string")
    return F.concat(
        F.lit("LLM Answer "), number, F.lit(": "), answer,
        F.lit("\nLLM Rationale "), number, F.lit(": "), rationale,
        F.lit("\n"), F.when(repeated, REPEAT_FEEDBACK).otherwise(GENERIC_FEEDBACK), F.lit("\n"),
    )


def exploration_context(response: Column) -> Column:
    return F.concat(F.lit("Previous LLM Response: "), response, F.lit("\nWrong answer! Try again.\n"))


def gold_context(question_type: Column, gold: Column) -> Column:
    """The injected gold answer before a forced turn."""
    choice, other = GOLD_MARKS
    mark = F.when(question_type == "MCQ", choice).otherwise(other)
    first = F.coalesce(F.get(gold, F.lit(0)), F.lit(""))
    return F.concat(F.lit("\n"), mark, F.lit(" "), first, F.lit("\n"))


def gate_input(
    content: Column, answer: Column, rationale: Column, setting: str = "exploration", instruction: str = GATE_INSTRUCTION
) -> Column:
    """Gate text. Training and inference should pass the same ``setting``, or their labels differ."""
    label = "LLM " if setting == "gradual" else ""

    def shown(text: Column) -> Column:
        return F.coalesce(text, F.lit(""))

    return F.concat(
        F.lit(f"{instruction}\n"), shown(content),
        F.lit(f" \n{label}Answer: "), shown(answer),
        F.lit(f"\n{label}Rationale: "), shown(rationale),
    )
