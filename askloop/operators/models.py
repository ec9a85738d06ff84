"""Where responses come from: a batch model in Python workers, or a table of recorded responses."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloop.operators.prompts import chat_messages
from askloop.schemas import KEYS
from askloop.session import materialize

# model(list of message lists, settings) -> list of responses
BatchModel = Callable[[list[list[dict[str, str]]], dict[str, Any]], list[str]]

_loaded: dict[str, Any] = {}


def load_once(token: str, load: Callable[[], Any]) -> Any:
    """One model per plug-in instance and Python worker process, however many batches and tasks it serves."""
    if token not in _loaded:
        _loaded[token] = load()
    return _loaded[token]


class Model:
    """Answers ``system``/``task_content`` rows through a user callable, in batches of ``batch_size``.

    ``load`` runs on the executors and returns the callable. Rows are sorted by length inside each partition, so a
    batch holds texts of similar length and wastes little padding. ``partitions`` spreads the rows evenly over that
    many tasks first: worth a shuffle of the open questions where the model is slow, as later turns are small tables.
    """

    def __init__(
        self,
        load: Callable[[], BatchModel],
        name: str = "reasoner",  # stands for the model in run records
        batch_size: int = 8,
        partitions: int | None = None,
    ):
        self.load, self.name, self.batch_size, self.partitions = load, name, batch_size, partitions
        self.token = uuid.uuid4().hex

    def respond(self, df: DataFrame, turn: int) -> DataFrame:
        load, token, size = self.load, self.token, self.batch_size
        system = F.col("system") if "system" in df.columns else None
        asked = df.withColumn("messages", chat_messages(system, F.col("task_content")))
        if self.partitions:
            asked = asked.repartition(self.partitions, *KEYS)
        asked = asked.sortWithinPartitions(F.length("task_content"))
        settings = [c for c in ("temperature", "top_p", "max_tokens") if c in df.columns]

        def answer(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = load_once(token, load)
            for frame in frames:
                # Rows of one batch share their sampling settings.
                groups = frame.groupby(settings, dropna=False, sort=False) if settings else [((), frame)]
                for values, group in groups:
                    setting = dict(zip(settings, values))
                    for start in range(0, len(group), size):
                        batch = group.iloc[start : start + size]
                        chats = [
                            [{"role": m["role"], "content": m["content"]} for m in chat] for chat in batch["messages"]
                        ]
                        yield batch.drop(columns="messages").assign(response=model(chats, setting))

        schema = T.StructType([*df.schema.fields, T.StructField("response", T.StringType())])
        return asked.mapInPandas(answer, schema)


class _Recorded:
    """A table of recorded turns, written by turn when first asked, so that each turn of a rollout reads its own folder only."""

    reads_content = False

    def __init__(self, table: DataFrame, name: str):
        self.table, self.name, self.stored = table, name, None

    def of_turn(self, turn: int) -> DataFrame:
        if self.stored is None:
            self.stored = materialize(self.table, "recorded", partition_by=["turn"])
        return self.stored.filter(F.col("turn") == turn)


class Replay(_Recorded):
    """Answers from recorded responses ``dataset, split, id, turn, response``; a turn without a record has none."""

    def __init__(self, responses: DataFrame, name: str = "replay"):
        super().__init__(responses, name)

    def respond(self, df: DataFrame, turn: int) -> DataFrame:
        return df.join(self.of_turn(turn).select(*KEYS, "response"), KEYS, "left")


class ReplayGate(_Recorded):
    """Accepts or rejects from recorded gate outputs ``dataset, split, id, turn, gate_output [, confidences]``."""

    def __init__(self, outputs: DataFrame, name: str = "replay"):
        super().__init__(outputs, name)

    def judge(self, df: DataFrame, turn: int) -> DataFrame:
        recorded = self.of_turn(turn)
        known = [
            F.col(c) if c in recorded.columns else F.lit(None).cast("double").alias(c)
            for c in ("confidence_0", "confidence_1")
        ]
        judged = df.join(recorded.select(*KEYS, "gate_output", *known), KEYS, "left")
        return judged.withColumn("gate_output", F.coalesce("gate_output", F.lit(False)))


class RuleGate:
    """Accepts where a column expression over the turn's columns holds."""

    def __init__(self, accept: Column):
        self.accept, self.name = accept, str(accept)

    def judge(self, df: DataFrame, turn: int) -> DataFrame:
        unknown = F.lit(None).cast("double")
        return df.withColumns(
            {
                "gate_output": F.coalesce(self.accept, F.lit(False)),
                "confidence_0": unknown,
                "confidence_1": unknown,
            }
        )
