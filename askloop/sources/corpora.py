"""Source records of public question sets to ``row_index, dataset, split, id, question, gold``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.operators.sampling import number_rows
from askloop.operators.trainset import SEED, shuffled_index

# Fixed value: answer letters in index order.
LETTERS = "ABCDE"


def letter_index(letter: Column) -> Column:
    """"A" to "E" as the text of their index, null for anything else."""
    at = F.when(F.length(letter) == 1, F.instr(F.lit(LETTERS), letter))
    return F.when(at > 0, (at - 1).cast("string"))


def choices_text(choices: Column, quoted_index: bool = False) -> Column:
    """``\\nChoices: [0: 'a', 1: 'b'].``; with ``quoted_index`` the numbers are quoted too."""
    mark = "'" if quoted_index else ""
    shown = F.transform(
        choices,
        lambda c, i: F.concat(F.lit(mark), i.cast("string"), F.lit(f"{mark}: '"), c, F.lit("'")),
    )
    return F.concat(F.lit("\nChoices: ["), F.concat_ws(", ", shown), F.lit("]."))


def _qa(df: DataFrame, dataset: str, split: str, **columns: Column) -> DataFrame:
    index = F.col("row_index").cast("bigint")
    return df.select(
        index.alias("row_index"),
        F.lit(dataset).alias("dataset"),
        F.lit(split).alias("split"),
        *[c.alias(n) for n, c in columns.items()],
    )


def normalise_mcq(df: DataFrame, dataset: str, split: str, question: str = "question") -> DataFrame:
    """Multiple choice with lettered answers. ``row_index`` is kept from the source."""
    return _qa(
        df, dataset, split,
        id=F.col("id"),
        question=F.concat(question, choices_text(F.col("choices.text"))),
        gold=F.array(letter_index(F.col("answerKey"))),
    )


def normalise_pair(df: DataFrame, dataset: str, split: str) -> DataFrame:
    """A goal with two solutions; the id is the row number in the split."""
    return _qa(
        df, dataset, split,
        id=F.col("row_index").cast("string"),
        question=F.concat("goal", choices_text(F.array("sol1", "sol2"), quoted_index=True)),
        gold=F.array(F.col("label").cast("string")),
    )


def normalise_cloze(df: DataFrame, dataset: str, split: str) -> DataFrame:
    """A sentence with a blank and two fillers; every underscore becomes the mask, the id is the row number."""
    sentence = F.replace(F.col("sentence"), F.lit("_"), F.lit("[MASK]"))
    return _qa(
        df, dataset, split,
        id=F.col("row_index").cast("string"),
        question=F.concat(sentence, choices_text(F.array("option1", "option2"))),
        gold=F.array((F.col("answer").cast("int") - 1).cast("string")),
    )


def number_shuffled(df: DataFrame, key: list[str], seed: int = SEED) -> DataFrame:
    """Number source records in a seeded shuffle order, as for a training split."""
    return shuffled_index(df, seed, key, [])


def number_in_order(df: DataFrame, order: str) -> DataFrame:
    """Number source records 0, 1, 2, … in the order of a unique column, as for a development split."""
    return number_rows(df, [order], [])


def split_sizes(qa: DataFrame) -> DataFrame:
    return qa.groupBy("dataset", "split").agg(F.count(F.lit(1)).alias("n"))
