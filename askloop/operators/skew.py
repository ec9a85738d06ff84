"""Joining a per-question table back to the rows when one question may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.schemas import KEYS

SALTS = 16


def salt(turn: Column) -> Column:
    """A question's turns dealt out to ``SALTS`` parts."""
    return F.pmod(turn.cast("bigint"), F.lit(SALTS)).cast("int")


def join_per_question(df: DataFrame, per_question: DataFrame, turn: str = "turn", how: str = "inner") -> DataFrame:
    """Add the columns of ``per_question`` (one narrow row a question) to every row, or keep the rows without one (``left_anti``).

    The join key is the question and a salt from the turn, so a hot question's rows go to ``SALTS`` partitions; the
    narrow side is repeated for each salt. Nothing is counted or fetched to decide this.
    """
    salts = F.explode(F.array(*[F.lit(s) for s in range(SALTS)])).alias("_salt")
    salted = per_question.select("*", salts)
    return df.withColumn("_salt", salt(F.col(turn))).join(salted, [*KEYS, "_salt"], how).drop("_salt")
