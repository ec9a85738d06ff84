import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloop.operators import baselines, metrics, models, prompts
from askloop.operators.rollout import (
    RolloutConfig,
    read_run,
    run_gated,
    run_graded,
    truncate_replay,
    with_previous_answer,
)
from askloop.schemas import PREDICTIONS, QA, RESPONSES

QUESTIONS = [(i, "d" if i % 2 else "e", "dev", f"q{i}", f"What is {i}?", [str(i % 4), "x"]) for i in range(23)]


def reply(content, system=""):
    """A deterministic stand-in for a language model: the answer moves with the length of the conversation."""
    return said(content, system)[0]


def said(content, system=""):
    """The reply, and what it says: answer and rationale as written, the normal answer, its last number."""
    n, size = (len(content) + len(system)) % 5, len(content)
    if n == 4:
        return f"I do not know {size}", "Answer not found", "Rationale not found", "answer not found", str(size)
    return f"Answer: The {n}!\nRationale: because {size}\nmore", f"The {n}!", f"because {size}", str(n), str(size)


def load_model():
    return lambda chats, settings: [reply(c[-1]["content"], c[0]["content"] if len(c) > 1 else "") for c in chats]


def accepts(content, answer, rationale):
    return len(content + answer) % 3 == 0


def accept_column():
    return F.length(F.concat("task_content", "raw_answer")) % 3 == 0


def simulate(setting, kind, max_turns, force, gated):
    """One question at a time, in plain Python."""
    system = {p: prompts._system_text(setting, kind, p) for s, p in prompts.SAMPLING if s == setting}
    out = []
    for _, dataset, _, qid, question, gold in QUESTIONS:
        content, previous = f"Q: {question} \n", ""
        first = 1 if setting == "gradual" else 0
        for turn in range(first, max_turns + (2 if force else 1)):
            if turn > max_turns:
                phase = "force"
            else:
                phase = "first" if setting == "gradual" or turn == first else "retry"
            response, answer, rationale, normal, last = said(content, system[phase].replace("{answer}", gold[0]))
            if kind == "MATH":
                answer, rationale, normal = last, response, last
            right = int(normal in gold)
            accepted = accepts(content, answer, rationale) if gated else bool(right)
            out.append((dataset, qid, turn, content, normal, rationale, accepted, right))
            if accepted:
                break
            if force and turn == max_turns:
                mark = "Ground-truth Answer" if kind == "MCQ" else "Use this exact correct answer"
                content += f"\n{mark}: {gold[0]}\n"
            elif setting == "gradual":
                feedback = prompts.REPEAT_FEEDBACK if normal == previous else prompts.GENERIC_FEEDBACK
                content += f"LLM Answer {turn}: {answer}\nLLM Rationale {turn}: {rationale}\n{feedback}\n"
            else:
                content += f"Previous LLM Response: {response}\nWrong answer! Try again.\n"
            previous = normal
    return sorted(out)


@pytest.fixture(scope="module")
def qa(spark):
    return spark.createDataFrame(QUESTIONS, QA)


@pytest.mark.parametrize("setting", ["gradual", "exploration"])
@pytest.mark.parametrize("kind,force", [("MCQ", True), ("MATH", True), ("OEQ", False)])
def test_graded_rollout(qa, setting, kind, force):
    config = RolloutConfig(setting, kind, max_turns=3, force_rationale=force)
    done = run_graded(qa, models.Model(load_model, "reply", 3), config)
    got = [(r.dataset, r.id, r.turn, r.task_content, r.answer, r.rationale, r.verdict == 1, r.verdict) for r in done.collect()]
    assert sorted(got) == simulate(setting, kind, 3, force, gated=False)


@pytest.mark.parametrize("setting", ["gradual", "exploration"])
def test_gated_rollout(qa, setting):
    config = RolloutConfig(setting, "OEQ", max_turns=3)
    done = run_gated(qa, models.Model(load_model, "reply", 3), models.RuleGate(accept_column()), config)
    got = [(r.dataset, r.id, r.turn, r.task_content, r.answer, r.rationale, r.gate_output, r.correct) for r in done.collect()]
    assert sorted(got) == simulate(setting, "OEQ", 3, False, gated=True)


def test_stops_when_all_are_accepted(qa):
    done = run_gated(qa, models.Model(load_model, "reply"), models.RuleGate(F.lit(True)), RolloutConfig("exploration"))
    assert {r.turn for r in done.select("turn").distinct().collect()} == {0}
    assert done.count() == len(QUESTIONS)


def load_random_model():
    return lambda chats, settings: [f"Answer: {uuid.uuid4()}\nRationale: r" for _ in chats]


def load_broken_model():
    def fail(chats, settings):
        raise RuntimeError("asked again")

    return fail


def test_a_model_is_asked_once_and_a_run_is_resumed(spark, qa, tmp_path):
    config = RolloutConfig("gradual", "OEQ", max_turns=2, force_rationale=False, run_id="r", base_path=str(tmp_path))
    done = run_graded(qa, models.Model(load_random_model, "random"), config)
    once = sorted(done.collect())
    assert sorted(done.collect()) == once
    # Every turn is there, so another run with the same id only reads.
    again = run_graded(qa, models.Model(load_broken_model, "random"), config)
    assert sorted(again.collect()) == once
    assert read_run(spark, str(tmp_path), "r").count() == len(once) == 2 * len(QUESTIONS)
    assert read_run(spark, str(tmp_path), "r").count() == len(once)
    # A turn without a record is not finished: it is asked again.
    record = tmp_path.parent / f"{tmp_path.name}-records" / "run_id=r"
    table = spark.read.parquet(str(record)).filter("turn = 1").toPandas()
    for part in record.glob("*"):
        part.unlink()
    for part in record.glob(".*"):
        part.unlink()
    spark.createDataFrame(table).write.mode("append").parquet(str(record))
    with pytest.raises(Exception, match="asked again"):
        run_graded(qa, models.Model(load_broken_model, "random"), config)


def test_runs_in_one_folder_stay_apart(spark, qa, tmp_path):
    config = RolloutConfig("exploration", "OEQ", max_turns=1, run_id="r", base_path=str(tmp_path))
    model = models.Model(load_model, "reply")
    run_gated(qa.filter("row_index < 10"), model, models.RuleGate(accept_column()), config)
    with pytest.raises(ValueError, match="other questions"):
        run_gated(qa.filter("row_index >= 10"), model, models.RuleGate(accept_column()), config)
    with pytest.raises(ValueError, match="other questions"):
        run_gated(qa.filter("row_index < 10"), model, models.RuleGate(F.lit(True)), config)
    # Without a name each run is its own.
    free = RolloutConfig("exploration", "OEQ", max_turns=1, base_path=str(tmp_path))
    done = [run_gated(qa.filter(f"row_index {op} 10"), model, models.RuleGate(accept_column()), free) for op in ("<", ">=")]
    assert [d.select("id").distinct().count() for d in done] == [10, 13]


def test_models_of_one_name_stay_apart(spark, qa):
    asked = qa.select("dataset", "split", "id", F.col("question").alias("task_content"))
    one, two = (models.Model(lambda w=w: lambda chats, settings: [w] * len(chats)) for w in ("one", "two"))
    assert {r.response for r in one.respond(asked, 0).collect()} == {"one"}
    assert {r.response for r in two.respond(asked, 0).collect()} == {"two"}


def test_splits_stay_apart(spark):
    rows = [(i, "d", s, str(i), f"{s} {i}?", [str(i % 4)]) for s in ("train", "dev") for i in range(20)]
    both = spark.createDataFrame(rows, QA)
    replay = both.select("dataset", "split", "id", F.lit(0).alias("turn"), F.concat(F.lit("Answer: "), F.col("gold")[0], F.lit(" Rationale: r")).alias("response"))
    done = run_graded(both, models.Replay(replay), RolloutConfig("exploration", "OEQ", max_turns=0, force_rationale=False))
    assert done.count() == 40
    score = metrics.accuracy(done, "verdict").first()
    assert (score.n, score.accuracy) == (40, 1.0)


def test_model_gets_settings_and_batches(spark, qa):
    def load():
        return lambda chats, settings: [f"{len(chats)}|{settings['temperature']}|{settings['max_tokens']}" for _ in chats]

    asked = qa.withColumns({"question_type": F.lit("OEQ"), "task_content": F.col("question")}).drop("question")
    asked = prompts.with_prompt(asked.coalesce(1), "retry", "exploration")
    rows = models.Model(load, "sizes", 8).respond(asked, 1).collect()
    assert sorted(r.response for r in rows) == ["7|0.6|256"] * 7 + ["8|0.6|256"] * 16


def test_model_rows_can_be_spread(spark, qa):
    asked = qa.select("dataset", "split", "id", F.col("question").alias("task_content")).coalesce(1)
    rows = models.Model(load_model, "reply", partitions=5).respond(asked, 1)
    assert rows.rdd.getNumPartitions() == 5 and rows.count() == len(QUESTIONS)


def test_missing_replay_counts_as_no_answer(spark, qa):
    replay = models.Replay(spark.createDataFrame([("d", "dev", "q1", 1, "Answer: 1\nRationale: r")], RESPONSES))
    done = run_graded(qa, replay, RolloutConfig("gradual", "OEQ", max_turns=1, force_rationale=False))
    verdicts = {r.id: (r.answer, r.verdict) for r in done.collect()}
    assert verdicts.pop("q1") == ("1", 1)
    assert set(verdicts.values()) == {("answer not found", 0)}


def recorded(spark, n=40, turns=6):
    rows = [
        ("d", "s", f"q{i}", t, "c", str(t % 3), "r", [str(i % 3)], (i * 7 + t * 5) % 6 == 0, int(t % 3 == i % 3), 0.0, 1.0)
        for i in range(n)
        for t in range(turns)
    ]
    rows += [("d", "s", "hot", t, "c", "1", "r", ["1"], t == 300, t % 2, 0.0, 1.0) for t in range(500)]
    return spark.createDataFrame(rows, PREDICTIONS)


def test_truncation(spark):
    df = recorded(spark)
    want = set()
    for qid, group in df.toPandas().groupby("id"):
        for r in group.sort_values("turn").itertuples():
            want.add((qid, r.turn))
            if r.gate_output:
                break
    kept = truncate_replay(df, F.col("gate_output"))
    assert {(r.id, r.turn) for r in kept.collect()} == want
    assert kept.columns == df.columns or set(kept.columns) == set(df.columns)


def test_fused_truncation_equals_truncated_table(spark):
    df = recorded(spark)
    kept = truncate_replay(df, F.col("gate_output"))
    accept = F.col("gate_output")
    assert metrics.system_report(df, accept=accept).collect() == metrics.system_report(kept).collect()
    assert metrics.compare_report(df, accept=accept).collect() == metrics.compare_report(kept).collect()


def test_previous_answer(spark):
    rows = with_previous_answer(recorded(spark)).filter("id = 'q5'").orderBy("turn").collect()
    assert [r.previous for r in rows] == ["", "0", "1", "2", "0", "1"]


def test_zero_shot_and_self_critic(spark, qa):
    done = baselines.zero_shot(qa, models.Model(load_model, "reply"), "MCQ", abstain=True)
    system = prompts._system_text("zero_shot", "MCQ", "abstain")
    want = {q[3]: said(f"Question: {q[4]}\n", system)[3] for q in QUESTIONS}
    assert {r.id: r.answer for r in done.collect()} == want

    critic = baselines.self_critic(qa, models.Model(load_model, "reply"))
    texts = [text for _, text, _ in prompts.CRITIC_STEPS]
    for row in critic.collect():
        question = next(q for q in QUESTIONS if q[3] == row.id)
        content, answers = f"Q: {question[4]}\n" + texts[0], []
        for step in range(5):
            response = reply(content)
            if step % 2 == 0:
                answers.append(said(content)[4])
            if step < 4:
                content += "\n" + response + "\n" + texts[step + 1]
        assert [row.answer_1, row.answer_2, row.answer_3] == answers
        assert row.transcript == content
        assert [row.correct_1, row.correct_2, row.correct_3] == [int(a in question[5]) for a in answers]


def test_user_prompts_replace_the_built_in_ones(spark, qa):
    table = spark.createDataFrame([("gradual", "OEQ", "first", "be {answer}", 0.5, 0.5, 9)], prompts.PROMPTS)
    asked = prompts.with_prompt(qa.withColumn("question_type", F.lit("OEQ")), "first", "gradual", table)
    assert {r.system for r in asked.collect()} == {f"be {i}" for i in range(4)}
    twice = spark.createDataFrame([("gradual", "OEQ", "first", t, 0.5, 0.5, 9) for t in ("one", "two")], prompts.PROMPTS)
    with pytest.raises(ValueError, match="one prompt for each"):
        prompts.with_prompt(qa.withColumn("question_type", F.lit("OEQ")), "first", "gradual", twice)
    many = [("gradual", f"t{i}", "first", f"say {i}", 0.5, 0.5, 9) for i in range(200)]
    typed = qa.withColumn("question_type", F.concat(F.lit("t"), F.col("row_index").cast("string")))
    asked = prompts.with_prompt(typed, "first", "gradual", spark.createDataFrame(many, prompts.PROMPTS))
    assert {r.row_index: r.system for r in asked.collect()} == {i: f"say {i}" for i in range(len(QUESTIONS))}


def test_prompts_need_no_join(spark, qa):
    asked = prompts.with_prompt(qa.withColumn("question_type", F.lit("OEQ")), "first", "gradual")
    assert "Join" not in asked._jdf.queryExecution().executedPlan().toString()
    assert {r.max_tokens for r in prompts.default_prompts(spark).collect()} == {256}


def load_counting_model(log, fails_on=None):
    """Writes down each question it is asked; fails on a question that is in ``fails_on``."""

    def load():
        def answer(chats, settings):
            texts = [c[-1]["content"] for c in chats]
            if fails_on and any(f in t for t in texts for f in fails_on):
                raise RuntimeError("the model broke down")
            with open(log, "a") as f:
                f.writelines(t.split("\n")[0] + "\n" for t in texts)
            return [reply(t) for t in texts]

        return answer

    return load


@pytest.mark.parametrize("setting", ["gradual", "exploration"])
def test_a_crash_costs_one_bucket(spark, qa, tmp_path, setting):
    buckets = 4
    config = RolloutConfig(setting, "OEQ", max_turns=2, force_rationale=False, run_id="r", base_path=str(tmp_path / "run"), buckets=buckets)
    place = qa.select("question", F.pmod(F.xxhash64("dataset", "split", "id"), F.lit(buckets)).alias("b")).collect()
    broken = [r.question for r in place if r.b == 2]
    assert broken and len({r.b for r in place}) == buckets
    log = tmp_path / "asked"
    with pytest.raises(Exception, match="broke down"):
        run_graded(qa, models.Model(load_counting_model(log, broken[:1]), "m"), config)
    before = sorted(f"Q: {r.question} " for r in place if r.b < 2)
    lost = {f"Q: {r.question} " for r in place if r.b == 2}
    assert sorted(t for t in log.read_text().splitlines() if t not in lost) == before  # the buckets before it, once each
    assert read_run(spark, config.base_path, "r").count() == len(before)
    done = run_graded(qa, models.Model(load_counting_model(log), "m"), config)
    columns = ["dataset", "id", "turn", "task_content", "answer", "verdict"]

    def told(df):
        return sorted(map(tuple, df.select(*columns).collect()))

    turns = Counter(r[3].split("\n")[0] for r in told(done))
    asked = Counter(log.read_text().splitlines())
    assert {q: n for q, n in asked.items() if q not in lost} == {q: n for q, n in turns.items() if q not in lost}
    assert told(done) == told(read_run(spark, config.base_path, "r"))
    whole = run_graded(qa, models.Model(load_counting_model(log), "m"), RolloutConfig(setting, "OEQ", max_turns=2, force_rationale=False))
    assert told(done) == told(whole)
    # A run that is resumed with another number of buckets keeps its own.
    again = run_graded(qa, models.Model(load_broken_model, "m"), RolloutConfig(**{**config.__dict__, "buckets": 7}))
    assert told(again) == told(done)


def test_a_turn_stores_what_it_adds(spark, qa, tmp_path):
    wordy = models.Model(lambda: lambda chats, settings: ["Answer: z\nRationale: " + "so " * 200] * len(chats), "wordy")
    config = RolloutConfig("exploration", "OEQ", max_turns=4, force_rationale=False, run_id="r", base_path=str(tmp_path))
    done = run_graded(qa, wordy, config)
    stored = spark.read.parquet(f"{tmp_path}/run_id=r").groupBy("turn").agg(F.sum(F.length("added")).alias("n")).collect()
    later = {r.n for r in stored if r.turn > 0}
    assert len(stored) == 5 and len(later) == 1
    grown = [r.n for r in done.groupBy("turn").agg(F.sum(F.length("task_content")).alias("n")).orderBy("turn").collect()]
    assert grown == [grown[0] + k * later.copy().pop() for k in range(5)]
    plan = done.groupBy("turn").agg(F.avg("verdict"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "collect_list" not in plan  # the contents are not put together for who does not read them
