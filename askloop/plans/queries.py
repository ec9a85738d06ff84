"""One runnable query per operator over the driver's tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloop import jobs
from askloop.functions import encoding, parsing, text
from askloop.operators import baselines, gate, metrics, models, prompts, redundancy, rollout, trainset
from askloop.plans import fixtures as fx
from askloop.schemas import QA, RAW_MCQ
from askloop.session import materialize, shared_root
from askloop.sources import corpora, tables

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(column):
    return F.round(column, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison across engines."""
    return df.select(
        *[r6(F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema]
    )


def joined(values, mark: str = "|"):
    return F.concat_ws(mark, values)


# --- Text and parsing -----------------------------------------------------------------------------------------------


@query
def norm_answers(spark: SparkSession, sf: str) -> DataFrame:
    return fx.table(spark, sf, "documents").select("doc_id", text.normalize_answer(F.col("text")).alias("normal"))


@query
def exact_match(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat(F.lit("The "), F.upper("answer"), F.lit("!"))
    return fx.predictions(spark, sf).select(
        "dataset", "id", "turn", text.exact_match(shown, F.col("gold")).alias("hit")
    )


@query
def token_f1(spark: SparkSession, sf: str) -> DataFrame:
    """Each document against the two documents after it, whole texts; the last two have fewer. A text is made a bag once."""
    bags = materialize(fx.table(spark, sf, "documents").select("doc_id", text.word_bag(F.col("text")).alias("bag")), "bags")
    ahead = [bags.select((F.col("doc_id") - k).alias("doc_id"), F.col("bag").alias(f"bag{k}")) for k in (1, 2)]
    told = bags.join(ahead[0], "doc_id", "left").join(ahead[1], "doc_id", "left")
    golds = F.array_compact(F.array(*[F.when(F.col(f"bag{k}").isNotNull(), text.bag_f1(F.col("bag"), F.col(f"bag{k}"))) for k in (1, 2)]))
    return told.select("doc_id", r6(F.coalesce(F.array_max(golds), F.lit(0.0))).alias("f1"))


@query
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens and word tokens of each document."""
    words, marks = text.tokens(F.col("text")), text.word_tokens(F.col("text"))
    return fx.table(spark, sf, "documents").select(
        "doc_id",
        F.size(words).cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
        F.size(marks).cast("bigint").alias("n_word_tokens"),
    )


@query
def abstentions(spark: SparkSession, sf: str) -> DataFrame:
    counts = fx.predictions(spark, sf).groupBy("dataset", "answer").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "dataset", "answer", "n",
        text.is_abstention(F.col("answer")).alias("abstains"),
        text.is_abstention(F.col("answer"), compat=True).alias("abstains_compat"),
    )


@query
def raw_membership(spark: SparkSession, sf: str) -> DataFrame:
    return fx.predictions(spark, sf).select(
        "dataset", "id", "turn", text.raw_membership(F.col("answer"), F.col("gold")).alias("member")
    )


@query
def confidence_format(spark: SparkSession, sf: str) -> DataFrame:
    one = (F.col("user_id") % 100) / 100
    return fx.table(spark, sf, "events").select("event_id", text.confidence_text(1 - one, one).alias("confidences"))


@query
def parse_responses(spark: SparkSession, sf: str) -> DataFrame:
    return fx.responses(spark, sf).select(
        "dataset", "id", "turn", parsing.answer_and_rationale(F.col("response"), F.lit("OEQ")).alias("p")
    ).select("dataset", "id", "turn", "p.answer", "p.rationale")


@query
def extract_numbers(spark: SparkSession, sf: str) -> DataFrame:
    number = parsing.extract_number(F.col("response"))
    return fx.math_responses(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", number.alias("number"))


@query
def assistant_output(spark: SparkSession, sf: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 5 != 0, "system\n\nhelp assistant\n\n \n").otherwise("system\n\n")
    raw = F.concat(head, F.col("text"), F.lit("\n \n\nend \n"))
    return fx.table(spark, sf, "documents").select("doc_id", parsing.assistant_output(raw).alias("output"))


@query
def search_query(spark: SparkSession, sf: str) -> DataFrame:
    return fx.quoted_events(spark, sf).select("event_id", parsing.search_query(F.col("query_text")).alias("found"))


@query
def final_paren_number(spark: SparkSession, sf: str) -> DataFrame:
    return fx.quoted_events(spark, sf).select(
        "event_id",
        parsing.final_paren_number(F.col("choice_text")).alias("number"),
        parsing.final_paren_number(F.col("choice_text"), compat=True).alias("number_compat"),
    )


@query
def literal_lists(spark: SparkSession, sf: str) -> DataFrame:
    return fx.quoted_events(spark, sf).select(
        "event_id", joined(parsing.literal_list(F.col("list_text"))).alias("gold_text")
    )


# --- Question sets --------------------------------------------------------------------------------------------------


def _flat(qa: DataFrame) -> DataFrame:
    return qa.select("row_index", "dataset", "split", "id", "question", joined(F.col("gold")).alias("gold_text"))


@query
def normalise_mcq(spark: SparkSession, sf: str) -> DataFrame:
    plain = corpora.normalise_mcq(fx.raw_mcq(spark, sf), "mcq", "train")
    stem = corpora.normalise_mcq(fx.raw_mcq(spark, sf, "question_stem"), "stem", "dev", "question_stem")
    return _flat(plain.unionByName(stem))


@query
def normalise_pair(spark: SparkSession, sf: str) -> DataFrame:
    numbered = corpora.number_in_order(fx.raw_pair(spark, sf), "source_index")
    return _flat(corpora.normalise_pair(numbered, "pair", "train"))


@query
def normalise_cloze(spark: SparkSession, sf: str) -> DataFrame:
    """Train rows are numbered in a seeded shuffle order, dev rows in source order."""
    raw = fx.raw_cloze(spark, sf)
    train = corpora.number_shuffled(raw.filter("source_index % 5 != 0"), ["source_index"])
    dev = corpora.number_in_order(raw.filter("source_index % 5 = 0"), "source_index")
    both = corpora.normalise_cloze(train, "cloze", "train").unionByName(corpora.normalise_cloze(dev, "cloze", "dev"))
    return _flat(both)


@query
def split_sizes(spark: SparkSession, sf: str) -> DataFrame:
    raw = fx.raw_cloze(spark, sf).withColumn("row_index", F.col("source_index"))
    qa = corpora.normalise_cloze(raw.filter("source_index % 5 != 0"), "cloze", "train").unionByName(
        corpora.normalise_cloze(raw.filter("source_index % 5 = 0"), "cloze", "dev")
    )
    return corpora.split_sizes(qa)


@query
def row_slice(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(rollout.row_slice(fx.qa(spark, sf), 10, 60))


@query
def global_slice(spark: SparkSession, sf: str) -> DataFrame:
    """A slice that begins in one data set and ends in another, each stored in several files."""
    paths, ordered = [], ["row_index"]
    for asked in (fx.qa(spark, sf), corpora.normalise_pair(corpora.number_in_order(fx.raw_pair(spark, sf), "source_index"), "pair", "train")):
        paths.append(_scratch(spark, "slice-source"))
        asked.repartitionByRange(4, *ordered).sortWithinPartitions(*ordered).write.parquet(paths[-1])
    cut = tables.read_slice(spark, paths, QA, 30, 150)
    return cut.select("position", "dataset", "split", "id", "question", joined(F.col("gold")).alias("gold_text"))


@query
def first_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(trainset.first_rows(fx.qa(spark, sf), 25))


# --- Tables ---------------------------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


@query
def qa_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Questions written to the exchanged CSV form and read back."""
    path = _scratch(spark, "qa-csv")
    tables.write_csv(fx.qa(spark, sf), path, "qa", indexed=True)
    read = tables.read_csv(spark, path, "qa", "conv", indexed=True, split="dev")
    return _flat(read)


@query
def csv_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """Turns, whose rationales span lines, in one CSV file for each data set, read back from byte ranges."""
    turns, parts = fx.training(spark, sf), []
    for dataset, split in (("conv", "dev"), ("events", "train")):
        path = _scratch(spark, f"ranges-csv-{dataset}")
        tables.write_csv(turns.filter(F.col("dataset") == dataset).coalesce(1), path, "training")
        parts.append(tables.read_csv(spark, path, "training", dataset, split=split, by_ranges=True))
    return parts[0].unionByName(parts[1]).select("dataset", "split", "id", "turn", "task_content", "answer", "rationale", "gate_verdict")


@query
def predictions_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Gated turns written to the exchanged CSV form, a file set for each data set, and read back."""
    shares = fx.gate_outputs(spark, sf).drop("gate_output")
    turns = fx.predictions(spark, sf).join(shares, ["dataset", "split", "id", "turn"], "left")
    parts = []
    for dataset, split in (("conv", "dev"), ("events", "train")):
        path = _scratch(spark, f"predictions-csv-{dataset}")
        tables.write_csv(turns.filter(F.col("dataset") == dataset), path, "predictions")
        parts.append(tables.read_csv(spark, path, "predictions", dataset, split=split))
    read = parts[0].unionByName(parts[1])
    return rounded(read.withColumn("gold", joined(F.col("gold"))).withColumnRenamed("gold", "gold_text"))


@query
def qa_by_split(spark: SparkSession, sf: str) -> DataFrame:
    """Questions stored by data set and split; one partition read back."""
    path = _scratch(spark, "qa")
    raw = fx.raw_cloze(spark, sf).withColumn("row_index", F.col("source_index"))
    cloze = corpora.normalise_cloze(raw, "cloze", "train")
    tables.write_qa(fx.qa(spark, sf).unionByName(cloze), path)
    return _flat(tables.read_qa(spark, path).filter("dataset = 'cloze'"))


@query
def results_by_run(spark: SparkSession, sf: str) -> DataFrame:
    """Two appended runs stay apart."""
    path = _scratch(spark, "results")
    turns = fx.predictions(spark, sf)
    tables.append_results(turns, path, "all")
    tables.append_results(rollout.truncate_replay(turns, F.col("gate_output")), path, "truncated")
    stored = spark.read.parquet(path).groupBy(F.col("run_id").cast("string").alias("run_id"), "turn")
    return stored.agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("n_correct"))


@query
def metrics_log(spark: SparkSession, sf: str) -> DataFrame:
    path = _scratch(spark, "metrics")
    turns = fx.predictions(spark, sf)
    tables.append_metrics(metrics.to_long(metrics.accuracy(turns, by=["dataset"]), "r1", "accuracy"), path)
    sizes = metrics.group_sizes(turns, by=["dataset"]).groupBy("dataset")
    tables.append_metrics(metrics.to_long(sizes.agg(
        F.count(F.lit(1)).alias("n_sizes"), F.sum("n_questions").alias("n_questions")), "r1", "sizes"), path)
    return tables.read_metrics(spark, path).select("run_id", "dataset", "stage", "metric", r6("value").alias("value"))


@query
def metrics_log_rerun(spark: SparkSession, sf: str) -> DataFrame:
    """A job that is run twice under one run id, and once under another, leaves one set of rows a run."""
    path = _scratch(spark, "metrics")
    for run_id in ("r1", "r1", "r2"):
        report = metrics.accuracy(fx.predictions(spark, sf), by=["dataset"])
        tables.append_metrics(metrics.to_long(report, run_id, "accuracy"), path)
        tables.append_metrics(metrics.to_long(metrics.turn_by_gate(fx.predictions(spark, sf), by=["dataset"]), run_id, "gate, turn", "turn"), path)
    return tables.read_metrics(spark, path).select("run_id", "dataset", "stage", "metric", r6("value").alias("value"))


def _training_csv(spark: SparkSession, turns: DataFrame, name: str) -> str:
    path = _scratch(spark, name)
    tables.write_csv(turns, path, "training")
    return path


@query
def split_files(spark: SparkSession, sf: str) -> DataFrame:
    """Training files as one table: conversations as train, with val drawn from them, events as test."""
    turns = fx.training(spark, sf)
    train = _training_csv(spark, turns.filter("dataset = 'conv'"), "train-csv")
    test = _training_csv(spark, turns.filter("dataset = 'events'"), "test-csv")
    parted = tables.load_splits(spark, train, None, test, dataset="joint")
    return parted.select("dataset", "split", "id", "turn", "answer", "gate_verdict")


@query
def tagged_sides(spark: SparkSession, sf: str) -> DataFrame:
    """Three parts in one table, told apart by side."""
    turns = fx.training(spark, sf)
    parts = [turns.filter(F.col("turn") % 3 == k) for k in range(3)]
    return trainset.tag_sides(*parts).groupBy("side", "dataset", "gate_verdict").agg(F.count(F.lit(1)).alias("n"))


@query
def files_by_name(spark: SparkSession, sf: str) -> DataFrame:
    """One file set for each data set, found by the name pattern."""
    base = _scratch(spark, "by-name")
    turns = fx.generated(spark, sf)
    for name in ("conv", "events"):
        tables.write_csv(turns.filter(F.col("dataset") == name), f"{base}/exp_{name}_generated_train.csv", "generated")
    read = tables.read_many(spark, base, "exp", ["conv", "events"], "train", "generated")
    return read.select("dataset", "split", "id", "turn", "answer", "verdict")


@query
def raw_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nested source records landed as JSON lines, read with their schema and normalised."""
    path = _scratch(spark, "raw")
    fx.raw_mcq(spark, sf).write.json(path)
    raw = tables.read_raw(spark, path, f"row_index bigint, {RAW_MCQ}")
    return _flat(corpora.normalise_mcq(raw, "mcq", "train"))


@query
def sets_by_side(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows written by side; the development side read back."""
    path = _scratch(spark, "sets")
    tables.write_sets(trainset.group_split(fx.training(spark, sf)), path)
    dev = spark.read.parquet(path).filter("side = 'dev'")
    return dev.groupBy("dataset", "gate_verdict").agg(F.count(F.lit(1)).alias("n"))


# --- Prompts --------------------------------------------------------------------------------------------------------


@query
def initial_messages(spark: SparkSession, sf: str) -> DataFrame:
    """First messages in every setting; the self-critic has no system message."""
    out = None
    for setting in ("gradual", "exploration", "zero_shot", "self_critic"):
        asked = fx.qa(spark, sf).withColumns(
            {
                "question_type": F.element_at(F.array(F.lit("MCQ"), F.lit("MATH"), F.lit("OEQ")), (F.col("row_index") % 3 + 1).cast("int")),
                "content": prompts.initial_content(F.col("question"), setting),
            }
        )
        if setting == "self_critic":
            chat = asked.withColumn("m", prompts.chat_messages(None, F.col("content")))
        else:
            asked = prompts.with_prompt(asked, "first", setting)
            chat = asked.withColumn("m", prompts.chat_messages(F.col("system"), F.col("content")))
        part = chat.select(F.lit(setting).alias("setting"), "id", F.posexplode("m").alias("pos", "m")).select(
            "setting", "id", "pos", "m.role", "m.content"
        )
        out = part if out is None else out.unionByName(part)
    return out


@query
def force_prompts(spark: SparkSession, sf: str) -> DataFrame:
    """Forced-rationale system texts with the gold answer written in, with their sampling settings."""
    kinds = F.element_at(F.array(F.lit("MCQ"), F.lit("MATH"), F.lit("OEQ")), (F.col("row_index") % 3 + 1).cast("int"))
    asked = prompts.with_prompt(fx.qa(spark, sf).withColumn("question_type", kinds), "force", "exploration")
    return asked.select("id", "question_type", "system", "temperature", "top_p", "max_tokens")


@query
def sampling_settings(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling of every setting and phase, as its questions get it."""
    kinds = F.element_at(F.array(F.lit("MCQ"), F.lit("MATH"), F.lit("OEQ")), (F.col("row_index") % 3 + 1).cast("int"))
    asked, parts = fx.qa(spark, sf).withColumn("question_type", kinds), []
    for setting, phase in prompts.SAMPLING:
        if setting == "self_critic":
            settings = baselines.critic_settings()
            told = asked.withColumns(settings)
        else:
            told = prompts.with_prompt(asked, phase, setting)
        named = told.withColumns({"setting": F.lit(setting), "phase": F.lit(phase)})
        counted = named.groupBy("setting", "phase", "question_type", "temperature", "top_p", "max_tokens")
        parts.append(counted.agg(F.count(F.lit(1)).alias("n")))
    return metrics.union_reports(*parts)


@query
def gradual_context(spark: SparkSession, sf: str) -> DataFrame:
    turns = rollout.with_previous_answer(fx.conversation_turns(spark, sf))
    grown = prompts.gradual_context(F.col("turn"), F.col("answer"), F.col("rationale"), F.col("previous"))
    return turns.select("id", "turn", "previous", grown.alias("context"))


@query
def exploration_context(spark: SparkSession, sf: str) -> DataFrame:
    return fx.responses(spark, sf).select("id", "turn", prompts.exploration_context(F.col("response")).alias("context"))


@query
def gold_injection(spark: SparkSession, sf: str) -> DataFrame:
    kinds = F.when(F.col("row_index") % 2 == 0, "MCQ").otherwise("OEQ")
    return fx.qa(spark, sf).select("id", prompts.gold_context(kinds, F.col("gold")).alias("context"))


@query
def gate_input(spark: SparkSession, sf: str) -> DataFrame:
    columns = [F.col(c) for c in ("task_content", "answer", "rationale")]
    return fx.predictions(spark, sf).select(
        "dataset", "id", "turn",
        prompts.gate_input(*columns).alias("plain"), prompts.gate_input(*columns, setting="gradual").alias("gradual"),
    )


# --- Rollouts -------------------------------------------------------------------------------------------------------


@query
def replay_truncate(spark: SparkSession, sf: str) -> DataFrame:
    kept = rollout.truncate_replay(fx.predictions(spark, sf), F.col("gate_output"))
    return kept.select("dataset", "id", "turn", "answer", "gate_output", "correct")


_GRADED = ["id", "turn", "task_content", "answer", "rationale", "verdict"]
_GATED = ["id", "turn", "task_content", "answer", "rationale", "gate_output", "correct", "confidence_1"]


def _graded(spark: SparkSession, sf: str, setting: str, kind: str) -> DataFrame:
    first = 1 if setting == "gradual" else 0
    config = rollout.RolloutConfig(setting=setting, question_type=kind)
    return rollout.run_graded(fx.qa(spark, sf), models.Replay(fx.responses(spark, sf, first)), config).select(*_GRADED)


@query
def graded_rollout_gradual(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf, "gradual", "MCQ")


@query
def graded_rollout_exploration(spark: SparkSession, sf: str) -> DataFrame:
    return _graded(spark, sf, "exploration", "OEQ")


class _Breaks(models.Replay):
    """Recorded responses from a reasoner that breaks down on its ``calls``-th call."""

    calls = 6

    def respond(self, df: DataFrame, turn: int) -> DataFrame:
        self.calls -= 1
        if not self.calls:
            raise ConnectionError("the reasoner is gone")
        return super().respond(df, turn)


@query
def resumed_rollout(spark: SparkSession, sf: str) -> DataFrame:
    """A rollout that breaks down in the second bucket of its second turn, and is resumed there."""
    config = rollout.RolloutConfig("exploration", "OEQ", run_id="resumed", base_path=_scratch(spark, "rollout"), buckets=4)
    asked, recorded = fx.qa(spark, sf), fx.responses(spark, sf)
    try:
        rollout.run_graded(asked, _Breaks(recorded), config)
    except ConnectionError:
        return rollout.run_graded(asked, models.Replay(recorded), config).select(*_GRADED)
    raise AssertionError("the first run should have ended early")


@query
def rollout_two_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Questions of two splits that share their ids; one in three has a wrong recorded response."""
    raw = fx.raw_cloze(spark, sf)
    parts = []
    for split, where in (("train", "source_index % 5 <> 0"), ("dev", "source_index % 5 = 0")):
        numbered = corpora.number_in_order(raw.filter(where), "source_index")
        parts.append(corpora.normalise_cloze(numbered, "cloze", split))
    both = parts[0].unionByName(parts[1])
    said = F.when(F.col("row_index") % 3 == 0, "neither").otherwise(F.col("gold")[0])
    recorded = both.select(
        "dataset", "split", "id", F.lit(0).alias("turn"),
        F.concat(F.lit("Answer: "), said, F.lit("\nRationale: so")).alias("response"),
    )
    config = rollout.RolloutConfig("exploration", "OEQ", max_turns=0, force_rationale=False)
    done = rollout.run_graded(both, models.Replay(recorded), config)
    return rounded(metrics.accuracy(done, "verdict", by=["dataset", "split"], with_f1=False))


@query
def generate_job(spark: SparkSession, sf: str) -> DataFrame:
    """The generation job from stored questions to its log."""
    base = _scratch(spark, "generate")
    tables.write_qa(fx.qa(spark, sf), f"{base}/qa")
    config = rollout.RolloutConfig("exploration", "OEQ")
    jobs.generate(spark, f"{base}/qa", f"{base}/turns", models.Replay(fx.responses(spark, sf)), config, f"{base}/log")
    return tables.read_metrics(spark, f"{base}/log").select("dataset", "stage", "metric", r6("value").alias("value"))


def _gated(spark: SparkSession, sf: str, setting: str) -> DataFrame:
    first = 1 if setting == "gradual" else 0
    model = models.Replay(fx.responses(spark, sf, first))
    judge = models.ReplayGate(fx.gate_outputs(spark, sf, first))
    config = rollout.RolloutConfig(setting=setting)
    return rounded(rollout.run_gated(fx.qa(spark, sf), model, judge, config).select(*_GATED))


@query
def gated_rollout_gradual(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf, "gradual")


@query
def gated_rollout_exploration(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf, "exploration")


@query
def infer_job(spark: SparkSession, sf: str) -> DataFrame:
    """The inference job with a recorded gate: its counts by turn and its opening turn, from its log."""
    base = _scratch(spark, "infer")
    tables.write_qa(fx.qa(spark, sf), f"{base}/qa")
    config = rollout.RolloutConfig("exploration", "OEQ")
    model, judge = models.Replay(fx.responses(spark, sf)), models.ReplayGate(fx.gate_outputs(spark, sf))
    jobs.infer(spark, f"{base}/qa", f"{base}/turns", model, judge, config, f"{base}/log")
    log = tables.read_metrics(spark, f"{base}/log").filter("stage NOT LIKE 'evaluation%' AND stage <> 'comparison'")
    return log.select("dataset", "stage", "metric", r6("value").alias("value"))


def _counting_model():
    """A stand-in for a language model: answers with the number of lines of the user message."""

    def answer(chats, settings):
        return [f"Answer: {chat[-1]['content'].count(chr(10)) % 4}\nRationale: {chat[0]['role']}" for chat in chats]

    return answer


@query
def reasoner_call(spark: SparkSession, sf: str) -> DataFrame:
    """One batch-model call in Python workers, parsed and graded."""
    asked = fx.qa(spark, sf).withColumns(
        {"task_content": prompts.initial_content(F.col("question"), "gradual"), "question_type": F.lit("OEQ")}
    )
    asked = prompts.with_prompt(asked.drop("question", "row_index"), "first", "gradual")
    answered = models.Model(_counting_model, "counting").respond(asked, 1)
    parsed = parsing.answer_and_rationale(F.col("response"), F.col("question_type"))
    return answered.select("id", "gold", "temperature", parsed.alias("p")).select(
        "id", "temperature", "p.answer", "p.rationale", text.exact_match(F.col("p.answer"), F.col("gold")).alias("verdict")
    )


@query
def zero_shot(spark: SparkSession, sf: str) -> DataFrame:
    done = baselines.zero_shot(fx.qa(spark, sf), models.Replay(fx.responses(spark, sf)), "MCQ", abstain=True)
    return rounded(metrics.zero_shot_report(done))


def _critic_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Five recorded calls a question: of the conversation's turns modulo 5, the latest; some give no number."""
    number = F.concat(F.lit("I choose ("), (F.col("size") % 4).cast("string"), F.lit(")"))
    call = (F.col("turn") % 5 + 1).cast("int").alias("turn")
    latest = fx.table(spark, sf, "conversations").select("conv_id", call, F.col("turn").alias("_turn"), F.length("text").alias("size"))
    return latest.groupBy("conv_id", "turn").agg(F.max_by("size", "_turn").alias("size")).select(
        F.lit("conv").alias("dataset"),
        F.lit("dev").alias("split"),
        F.col("conv_id").cast("string").alias("id"),
        "turn",
        F.when(F.col("size") % 5 == 0, "I cannot tell").otherwise(number).alias("response"),
    )


@query
def self_critic(spark: SparkSession, sf: str) -> DataFrame:
    done = baselines.self_critic(fx.qa(spark, sf), models.Replay(_critic_responses(spark, sf)))
    return rounded(metrics.answer_set_scores(baselines.answer_sets(done)))


@query
def self_critic_transcript(spark: SparkSession, sf: str) -> DataFrame:
    done = baselines.self_critic(fx.qa(spark, sf), models.Replay(_critic_responses(spark, sf)), compat=True)
    return done.select("id", "answer_1", "answer_2", "answer_3", "correct_1", "correct_2", "correct_3", "transcript")


# --- Training sets --------------------------------------------------------------------------------------------------


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return trainset.class_distribution(fx.training(spark, sf), by=("dataset",))


@query
def class_balance(spark: SparkSession, sf: str) -> DataFrame:
    return trainset.balance(fx.training(spark, sf)).select("dataset", "id", "turn", "gate_verdict", "shuffle_key")


@query
def first_training_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of a balanced training table in its seeded order."""
    balanced = trainset.balance(fx.training(spark, sf))
    return trainset.first_rows(balanced, 50, "shuffle_key").select("dataset", "id", "turn", "shuffle_key")


@query
def group_split(spark: SparkSession, sf: str) -> DataFrame:
    return trainset.group_split(fx.training(spark, sf)).select("dataset", "id", "turn", "gate_verdict", "side")


@query
def joint_trainset(spark: SparkSession, sf: str) -> DataFrame:
    """Balance and split the joined data sets, each on its own, in one pass; report the sizes."""
    parts = [fx.conversation_turns(spark, sf), fx.event_turns(spark, sf)]
    training = [p.withColumnRenamed("correct", "gate_verdict").drop("gate_output") for p in parts]
    balanced = materialize(trainset.balance(trainset.join_sets(*training)), "balanced")
    split = trainset.group_split(balanced)
    return trainset.class_distribution(split, by=("dataset", "side"))


@query
def instruct_text(spark: SparkSession, sf: str) -> DataFrame:
    plain = trainset.to_instruct(fx.training(spark, sf), keep=("dataset", "id", "turn"))
    compat = trainset.to_instruct(fx.training(spark, sf), compat=True, keep=("dataset", "id", "turn"))
    both = [plain.withColumn("form", F.lit("plain")), compat.withColumn("form", F.lit("compat"))]
    return trainset.join_sets(*both)


@query
def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return trainset.build_vocabulary(fx.table(spark, sf, "documents"), "text")


def _encoded(spark: SparkSession, sf: str) -> DataFrame:
    docs = fx.gate_texts(spark, sf).select(
        "id", F.col("rationale").alias("input"), text.label_text(F.col("gate_verdict")).alias("label")
    )
    words = materialize(trainset.build_vocabulary(docs, "input"), "vocabulary")
    return trainset.encode_pad(docs, trainset.VocabularyTokenizer(words), ["id"])


@query
def encode_pad(spark: SparkSession, sf: str) -> DataFrame:
    return _encoded(spark, sf).select("id", *[joined(F.col(c), " ").alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query
def collated(spark: SparkSession, sf: str) -> DataFrame:
    """Word lists of documents padded to the longest of their batch of eight documents."""
    words = text.tokens(F.col("text"))
    ones = F.transform(words, lambda _: F.lit(1))
    docs = fx.table(spark, sf, "documents").select(
        "doc_id", F.expr("doc_id div 8").alias("batch"), F.transform(words, lambda w: F.length(w) + 5).alias("input_ids"),
        ones.alias("attention_mask"), F.array(F.lit(3), F.lit(1)).alias("labels"),
    )
    padded = encoding.collate(docs, "batch", trainset.PAD)
    total = F.aggregate("input_ids", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return padded.select(
        "doc_id", F.size("input_ids").cast("bigint").alias("width"), total.alias("total"), joined(F.col("labels"), " ").alias("labels"),
        F.size(F.filter("attention_mask", lambda m: m == 1)).cast("bigint").alias("n_words"),
    )


@query
def label_recodes(spark: SparkSession, sf: str) -> DataFrame:
    labels = _encoded(spark, sf).select(
        encoding.restore_pad(F.col("labels"), trainset.PAD).alias("restored"),
        encoding.binary_targets(F.col("labels"), trainset.ZERO, trainset.ONE).alias("targets"),
    )
    shown = labels.select(joined(F.col("restored"), " ").alias("restored"), joined(F.col("targets"), " ").alias("targets"))
    return shown.groupBy("restored", "targets").agg(F.count(F.lit(1)).alias("n"))


# --- Gate -----------------------------------------------------------------------------------------------------------


def _gate_rows(spark: SparkSession, sf: str) -> DataFrame:
    balanced = trainset.balance(fx.gate_texts(spark, sf), label="toxic")
    split = materialize(trainset.group_split(balanced, label="toxic"), "gate-rows")
    return trainset.to_instruct(split, label="toxic", keep=("id", "side"))


@query
def gate_fit_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the training side, apply to the development side. Rows only: a fit has no SQL twin."""
    rows = _gate_rows(spark, sf)
    config = gate.GateConfig(features=1 << 12, penalties=(0.01, 0.1), max_iter=20)
    fitted, _ = gate.fit_gate(rows.filter("side = 'train'"), rows.filter("side = 'dev'"), config)
    judged = fitted.apply(rows.filter("side = 'dev'"))
    return judged.select("id", "label", "gate_output", r6("confidence_0").alias("confidence_0"), r6("confidence_1").alias("confidence_1"))


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    return fx.gate_texts(spark, sf).select("id", F.col("rationale").alias("input"), F.col("toxic").cast("string").alias("label"))


_STEPS = gate.StepConfig(features=1 << 12, steps=6, rate=4.0, penalty=0.001, weight_accept=3.0)


@query
def gate_fit_steps(spark: SparkSession, sf: str) -> DataFrame:
    """The weights of a gate after a few full-batch steps over all labelled texts."""
    fitted = gate.fit_steps(_labelled(spark, sf), _STEPS)
    return fitted.table(spark).select("feature", r6("weight").alias("weight"))


def _held_out(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    last = F.substring("id", -1, 1)
    return rows.filter(last != "7"), rows.filter(last == "7")


@query
def gate_apply(spark: SparkSession, sf: str) -> DataFrame:
    """Outputs and confidences on the texts that the gate was not fitted on."""
    train, rest = _held_out(_labelled(spark, sf))
    judged = gate.fit_steps(train, _STEPS).apply(rest)
    return judged.select("id", "label", "gate_output", r6("confidence_0").alias("confidence_0"), r6("confidence_1").alias("confidence_1"))


@query
def gate_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """A gate saved under its experiment's name, loaded, applied to texts it has not seen, and reported on by class."""
    train, rest = _held_out(_labelled(spark, sf))
    base = _scratch(spark, "gates")
    gate.fit_steps(train, _STEPS).save(spark, base, "exp1")
    return rounded(gate.WeightGate.load(spark, base, "exp1").evaluate(rest))


@query
def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    """Per-class report of a recorded gate that sometimes says neither class."""
    turns = fx.predictions(spark, sf).select(
        F.col("correct").cast("string").alias("label"),
        F.when(F.col("answer") == "unsure", "?").otherwise(F.col("gate_output").cast("int").cast("string")).alias("said"),
    )
    return rounded(metrics.class_report(turns, "label", "said"))


# --- Evaluation -----------------------------------------------------------------------------------------------------


_TURN = ["dataset", "id", "turn", "answer", "rationale", "correct", "gate_output"]


@query
def last_turn(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.last_turn(fx.predictions(spark, sf).select("split", *_TURN)).drop("split")


@query
def first_turn(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.first_turn(fx.predictions(spark, sf).select("split", *_TURN)).drop("split")


@query
def accuracy(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(fx.predictions(spark, sf), by=["dataset"], overall=True))


@query
def accuracy_generated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.accuracy(fx.generated(spark, sf), "verdict", by=["dataset"]))


@query
def f1_score(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.f1_score(fx.predictions(spark, sf), by=["dataset"]))


@query
def formula_gated(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.formula_gated(fx.predictions(spark, sf), by=["dataset"], overall=True))


@query
def formula_zero_shot(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.formula_zero_shot(fx.predictions(spark, sf), by=["dataset"]))


@query
def formula_zero_shot_compat(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.formula_zero_shot(fx.predictions(spark, sf), by=["dataset"], compat=True))


@query
def gate_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.gate_confusion(fx.predictions(spark, sf), by=["dataset"]))


@query
def custom_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics.custom_evaluation(fx.predictions(spark, sf), by=["dataset"]))


@query
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.value_counts(fx.predictions(spark, sf), ["gate_output", "correct"], by=["dataset"])


@query
def group_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.group_sizes(fx.predictions(spark, sf), by=["dataset"])


@query
def turn_by_gate(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.turn_by_gate(fx.predictions(spark, sf), by=["dataset"])


@query
def turn_by_correct(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.turn_by_correct(fx.predictions(spark, sf), by=["dataset"])


@query
def turn_by_verdict(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.turn_by_verdict(fx.generated(spark, sf), by=["dataset"])


@query
def first_turn_metrics(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.predictions(spark, sf)
    opening = [
        metrics.first_turn_metrics(turns, setting).withColumn("setting", F.lit(setting))
        for setting in ("exploration", "gradual")
    ]
    return rounded(metrics.union_reports(*opening))


@query
def compare_report(spark: SparkSession, sf: str) -> DataFrame:
    turns = fx.predictions(spark, sf)
    return rounded(metrics.compare_report(turns, by=["dataset"], accept=F.col("gate_output")))


@query
def compare_report_recorded(spark: SparkSession, sf: str) -> DataFrame:
    """First against last recorded turns, all turns counting."""
    return rounded(metrics.compare_report(fx.predictions(spark, sf), by=["dataset"]))


@query
def distinct_questions(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.distinct_questions(fx.predictions(spark, sf))


@query
def answer_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.redundancy_histogram(redundancy.answer_redundancy(fx.predictions(spark, sf)))


@query
def answer_redundancy_share(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(redundancy.redundancy_share(redundancy.answer_redundancy(fx.predictions(spark, sf)), "n_rows"))


def _rationales(spark: SparkSession, sf: str) -> DataFrame:
    talk = fx.conversation_turns(spark, sf).select("dataset", "split", "id", "turn", "answer", "rationale")
    return talk.unionByName(fx.document_turns(spark, sf))


@query
def rationale_redundancy(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.rationale_redundancy(_rationales(spark, sf)).drop("split")


@query
def rationale_redundancy_min(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.rationale_redundancy(_rationales(spark, sf), 30, overlap="min").drop("split")


@query
def rationale_redundancy_share(spark: SparkSession, sf: str) -> DataFrame:
    counts = redundancy.rationale_redundancy(_rationales(spark, sf))
    return rounded(redundancy.redundancy_share(counts, "n_rationales"))


@query
def rationale_redundancy_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return redundancy.redundancy_histogram(redundancy.rationale_redundancy(_rationales(spark, sf)))


@query
def system_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: recorded turns cut at the first accepted one, then scored."""
    turns = fx.predictions(spark, sf)
    return rounded(metrics.system_report(turns, by=["dataset"], accept=F.col("gate_output")))
