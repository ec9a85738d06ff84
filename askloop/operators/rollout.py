"""Turn-by-turn rollouts: ask, parse, judge, and carry only the rejected questions to the next turn.

A turn is written as ``run_id=…/turn=…/mark=…/bucket=…``: its questions fall into ``buckets`` by a hash of their key, and each
bucket is one Spark job with one row in the run's record, beside the base folder. The bucket is what a crash can cost: a run
is resumed at its first unwritten bucket, and a model is never asked twice for a written one. The row holds a fingerprint of
everything that steers the run (questions, settings, model and gate names, prompts), the mark of the turn, the mark of the turn
before and how many questions stay open. A run is only resumed with an equal fingerprint, and a turn only counts if it was built
on the turn before. Folders of another mark were overtaken and are never read.

A turn stores only what it adds to a question's content, so its size does not grow with the turns. The content is put together
again, in the order of the turns, for the models and gates that read it and for who reads the result.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from askloop.functions.parsing import answer_and_rationale
from askloop.functions.text import exact_match, normalize_answer
from askloop.operators.prompts import (
    exploration_context,
    gold_context,
    gradual_context,
    initial_content,
    with_prompt,
)
from askloop.operators.skew import join_per_question
from askloop.schemas import KEYS
from askloop.session import materialize, shared_root

# Default number of turns per (kind, setting).
DEFAULT_TURNS = {
    ("graded", "gradual"): 4,
    ("graded", "exploration"): 3,
    ("gated", "gradual"): 5,
    ("gated", "exploration"): 4,
}

_KEPT = ["question_type", "gold", "added", "previous", "response"]


@dataclass(frozen=True)
class RolloutConfig:
    setting: str = "gradual"
    question_type: str = "OEQ"
    max_turns: int | None = None
    force_rationale: bool = True
    run_id: str | None = None
    base_path: str | None = None
    # Parts of a turn that are written one after the other; a run that is resumed keeps its first number.
    buckets: int = 1

    @property
    def first_turn(self) -> int:
        return 1 if self.setting == "gradual" else 0


RECORD = "turn int, bucket int, buckets int, n_open bigint, fingerprint string, mark string, before string, at double"


@dataclass
class _Turn:
    """What the record says of a turn: by bucket, how many questions stay open."""

    fingerprint: str
    mark: str
    before: str
    buckets: int
    n_open: dict[int, int] = field(default_factory=dict)

    @property
    def finished(self) -> bool:
        return len(self.n_open) == self.buckets


def _base(spark: SparkSession, config: RolloutConfig) -> str:
    return (config.base_path or f"{shared_root(spark)}/rollouts").rstrip("/")


def _turn_path(base: str, run_id: str, turn: int, mark: str) -> str:
    return f"{base}/run_id={run_id}/turn={turn}/mark={mark}"


def _record_path(base: str, run_id: str) -> str:
    return f"{base}-records/run_id={run_id}"


def _record(spark: SparkSession, base: str, run_id: str) -> dict[int, _Turn]:
    """Each turn as last begun. The record has one row a written bucket."""
    try:
        rows = spark.read.schema(RECORD).parquet(_record_path(base, run_id)).orderBy("at").collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    turns: dict[int, _Turn] = {}
    for r in rows:
        if r.turn not in turns or turns[r.turn].mark != r.mark:
            turns[r.turn] = _Turn(r.fingerprint, r.mark, r.before, r.buckets)
        turns[r.turn].n_open[r.bucket] = r.n_open
    return turns


def _begun(record: dict[int, _Turn], first: int) -> dict[int, _Turn]:
    """The turns from ``first`` on that are each built on the one before, the last one perhaps in part."""
    turns, before = {}, ""
    for turn in range(first, first + len(record)):
        if turn not in record or record[turn].before != before:
            break
        turns[turn] = record[turn]
        if not record[turn].finished:
            break
        before = record[turn].mark
    return turns


def _fingerprint(questions: DataFrame, config: RolloutConfig, kind: str, names: list[str], prompts: DataFrame | None) -> str:
    """Of the open questions as a set, the settings, the plug-ins' names and the prompts."""

    def content(df: DataFrame) -> list:
        each = F.xxhash64(F.to_json(F.struct(*df.columns)))
        return list(df.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum(each.cast("decimal(20,0)"))).first())

    steering = [config.setting, config.question_type, config.max_turns, config.force_rationale]
    told = [kind, *names, *steering, content(questions), content(prompts) if prompts is not None else None]
    return sha256(repr(told).encode()).hexdigest()


def _open_questions(qa: DataFrame, config: RolloutConfig, buckets: int) -> DataFrame:
    question_type = F.col("question_type") if "question_type" in qa.columns else F.lit(config.question_type)
    return qa.select(
        *KEYS,
        question_type.alias("question_type"),
        "gold",
        initial_content(F.col("question"), config.setting).alias("added"),
        F.lit("").alias("previous"),
        F.pmod(F.xxhash64(*KEYS), F.lit(buckets)).cast("int").alias("bucket"),
    )


def _next_questions(done: DataFrame, accepted: Column, config: RolloutConfig, turn: int, inject_gold: bool) -> DataFrame:
    """Questions still open after ``turn``, with what it adds to their content."""
    parsed = answer_and_rationale(F.col("response"), F.col("question_type"))
    if inject_gold:
        grown = gold_context(F.col("question_type"), F.col("gold"))
    elif config.setting == "gradual":
        grown = gradual_context(F.lit(turn), parsed["answer"], parsed["rationale"], F.col("previous"))
    else:
        grown = exploration_context(F.coalesce("response", F.lit("")))
    return done.filter(~accepted).select(
        *KEYS,
        "question_type",
        "gold",
        grown.alias("added"),
        F.col("answer").alias("previous"),
        "bucket",
    )


def _put_together(parts: str | Column) -> Column:
    """The content from the (turn, added) of a question's turns."""
    return F.array_join(F.transform(F.sort_array(parts), lambda p: p["added"]), "")


def _with_content(questions: DataFrame, earlier: list[DataFrame]) -> DataFrame:
    """Open questions with their whole content: what all earlier turns added, in order, and what is added now."""
    if not earlier:
        return questions.withColumn("task_content", F.col("added"))
    said = reduce(DataFrame.unionAll, [t.select(*KEYS, F.lit(k).alias("turn"), "added") for k, t in enumerate(earlier)])
    still = said.join(questions.select(*KEYS), KEYS, "left_semi")
    before = still.groupBy(*KEYS).agg(_put_together(F.collect_list(F.struct("turn", "added"))).alias("_before"))
    whole = questions.join(before, KEYS, "left")
    return whole.withColumn("task_content", F.concat(F.coalesce("_before", F.lit("")), F.coalesce("added", F.lit("")))).drop("_before")


def _with_contents(run: DataFrame, columns: list[str]) -> DataFrame:
    """All turns with their contents. Who does not read the content does not pay for it: the join falls away."""
    parts = run.groupBy(*KEYS).agg(F.collect_list(F.struct("turn", "added")).alias("_parts"))
    content = _put_together(F.filter("_parts", lambda p: p["turn"] <= F.col("turn")))
    return run.join(parts, KEYS, "left").select(*KEYS, "turn", content.alias("task_content"), "answer", "rationale", "gold", *columns)


def _run(qa, model, config: RolloutConfig, prompts, last_free: int, last: int, judge, accepted: Column, columns, plugins):
    """``judge(df, turn)`` adds the verdict columns named in ``columns``; ``accepted`` closes a question."""
    spark = qa.sparkSession
    base, run_id = _base(spark, config), config.run_id
    record = _record(spark, base, run_id)
    buckets = next((t.buckets for t in record.values()), config.buckets)
    questions = _open_questions(qa, config, buckets)
    fingerprint = _fingerprint(questions.drop("bucket"), config, columns[0], [p.name for p in plugins], prompts)
    if any(t.fingerprint != fingerprint for t in record.values()):
        raise ValueError(f"run {run_id} under {base} has other questions, settings, plug-ins or prompts")
    begun, mark, tables, schema = _begun(record, config.first_turn), "", [], None
    reads_content = any(getattr(p, "reads_content", True) for p in plugins)
    for turn in range(config.first_turn, last + 1):
        if turn == config.first_turn:
            phase = "first"
        elif turn > last_free:
            phase = "force"
        else:
            phase = "first" if config.setting == "gradual" else "retry"

        this = begun.get(turn) or _Turn(fingerprint, uuid.uuid4().hex, mark, buckets)
        path, mark = _turn_path(base, run_id, turn, this.mark), this.mark
        for bucket in [b for b in range(buckets) if b not in this.n_open]:
            begun = {t: begun[t] for t in begun if t <= turn}  # later turns are built anew too
            part = questions.filter(F.col("bucket") == bucket)
            if reads_content:
                part = _with_content(part, [t.filter(F.col("bucket") == bucket) for t in tables])
            asked = with_prompt(part, phase, config.setting, prompts)
            answered = model.respond(asked, turn).drop("system", "temperature", "top_p", "max_tokens")
            parsed = answered.withColumn("_p", answer_and_rationale(F.col("response"), F.col("question_type")))
            parsed = parsed.withColumns({"raw_answer": F.col("_p.answer"), "rationale": F.col("_p.rationale")}).drop("_p")
            judged = judge(parsed, turn).withColumn("answer", normalize_answer(F.col("raw_answer")))
            written = materialize(judged.select(*KEYS, *_KEPT, "answer", "rationale", *columns), "turn", f"{path}/bucket={bucket}")
            this.n_open[bucket] = written.filter(~accepted).count()  # a narrow scan of the verdicts
            row = (turn, bucket, buckets, this.n_open[bucket], fingerprint, mark, this.before, time.time())
            told = [F.lit(v).cast(f.split()[1]).alias(f.split()[0]) for v, f in zip(row, RECORD.split(", "))]
            spark.range(1, numPartitions=1).select(*told).write.mode("append").parquet(_record_path(base, run_id))

        schema = schema or spark.read.parquet(f"{path}/bucket=0").schema.add("bucket", IntegerType())
        tables.append(spark.read.schema(schema).parquet(path))
        if not sum(this.n_open.values()):  # nothing was rejected
            break
        questions = _next_questions(tables[-1], accepted, config, turn, inject_gold=turn == last_free and last > last_free)

    turns = [t.withColumn("turn", F.lit(k)) for k, t in enumerate(tables, config.first_turn)]
    return _with_contents(reduce(DataFrame.unionAll, turns), columns)


def read_run(spark: SparkSession, base_path: str, run_id: str) -> DataFrame:
    """The turns of a run's record under ``base_path``; of a turn in work the buckets that are written."""
    base = base_path.rstrip("/")
    record = _record(spark, base, run_id)
    if not record:
        raise ValueError(f"there is no record of run {run_id} under {base}")
    begun = _begun(record, min(record))
    paths = [f"{_turn_path(base, run_id, t, begun[t].mark)}/bucket={b}" for t in begun for b in sorted(begun[t].n_open)]
    run = spark.read.option("basePath", f"{base}/run_id={run_id}").parquet(*paths)
    return _with_contents(run, [c for c in ("verdict", "gate_output", "correct", "confidence_0", "confidence_1") if c in run.columns])


def settled(config: RolloutConfig | None, kind: str) -> RolloutConfig:
    config = config or RolloutConfig()
    return replace(
        config,
        max_turns=DEFAULT_TURNS[kind, config.setting] if config.max_turns is None else config.max_turns,
        run_id=config.run_id or f"{kind}-{config.setting}-{uuid.uuid4().hex}",
    )


def run_graded(qa: DataFrame, model, config: RolloutConfig | None = None, prompts: DataFrame | None = None) -> DataFrame:
    """Roll out with the gold answers as judge; optionally one more turn that explains the given gold answer.

    ``qa`` has one row per (dataset, split, id). Give ``run_id`` to resume a broken run at its first unwritten bucket.
    """
    config = settled(config, "graded")
    last_free = config.max_turns
    last = last_free + 1 if config.force_rationale else last_free

    def judge(df: DataFrame, turn: int) -> DataFrame:
        return df.withColumn("verdict", exact_match(F.col("raw_answer"), F.col("gold")))

    return _run(qa, model, config, prompts, last_free, last, judge, F.col("verdict") == 1, ["verdict"], [model])


def run_gated(
    qa: DataFrame, model, gate, config: RolloutConfig | None = None, prompts: DataFrame | None = None
) -> DataFrame:
    """Roll out with a gate as judge. Correctness is recorded and never steers the rollout."""
    config = settled(config, "gated")

    def judge(df: DataFrame, turn: int) -> DataFrame:
        return gate.judge(df, turn).withColumn("correct", exact_match(F.col("raw_answer"), F.col("gold")))

    columns = ["gate_output", "correct", "confidence_0", "confidence_1"]
    turns = config.max_turns
    return _run(qa, model, config, prompts, turns, turns, judge, F.col("gate_output"), columns, [model, gate])


def truncate_replay(df: DataFrame, accept: Column) -> DataFrame:
    """Of all recorded turns keep those up to and including the first accepted one of each question.

    The first accepted turn is a minimum, which combines map-side, and is joined back; a question with very many
    turns gathers in no task. The metrics take ``accept`` themselves and need no truncated table.
    """
    first = df.groupBy(*KEYS).agg(F.min(F.when(accept, F.col("turn"))).alias("_stop"))
    kept = join_per_question(df, first)
    return kept.filter(F.col("_stop").isNull() | (F.col("turn") <= F.col("_stop"))).drop("_stop")


def with_previous_answer(df: DataFrame) -> DataFrame:
    """Add the answer of the turn before ("" on the first turn).

    Turns of a question are consecutive, so the turn before is an equi join on the question and turn, whose key is
    unique: no window gathers a whole question.
    """
    before = df.select(*KEYS, (F.col("turn") + 1).alias("turn"), F.col("answer").alias("previous"))
    return df.join(before, [*KEYS, "turn"], "left").withColumn("previous", F.coalesce("previous", F.lit("")))


def row_slice(qa: DataFrame, start: int = 0, end: int | None = None) -> DataFrame:
    """Rows ``start`` to ``end - 1`` by their stored index, which counts within a data set and split.

    The bounds reach the Parquet scan. Without them all rows are taken.
    """
    rows = qa if not start else qa.filter(F.col("row_index") >= start)
    return rows if end is None else rows.filter(F.col("row_index") < end)
