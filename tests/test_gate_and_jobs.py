import random

import pytest
from pyspark.sql import functions as F

from askloop import jobs
from askloop.operators import models
from askloop.operators.gate import Gate, GateConfig, fit_gate
from askloop.operators.rollout import RolloutConfig
from askloop.schemas import QA
from askloop.sources.tables import read_metrics, write_qa

SMALL = GateConfig(features=1 << 10, penalties=(0.01, 1.0), max_iter=15)


def labelled(spark, n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        good = rng.random() < 0.5
        words = rng.choices(["sound", "clear", "right"] if good else ["vague", "wrong", "odd"], k=4) + rng.choices(["of", "it"], k=4)
        rows.append((i, " ".join(words), str(int(good))))
    return spark.createDataFrame(rows, "i int, input string, label string")


def test_gate_learns_applies_saves_and_loads(spark, tmp_path):
    train, dev = labelled(spark, 200, 1), labelled(spark, 60, 2)
    gate, accuracy = fit_gate(train, dev, SMALL)
    assert accuracy == 1.0
    judged = gate.apply(dev)
    assert judged.columns == ["i", "input", "label", "gate_output", "confidence_0", "confidence_1"]
    for r in judged.collect():
        assert r.gate_output == (r.label == "1")
        assert r.confidence_0 + r.confidence_1 == pytest.approx(1)
    assert gate.evaluate(dev).first().f1_1 == 1.0
    gate.save(str(tmp_path), "exp")
    again = Gate.load(str(tmp_path), "exp")
    assert sorted(again.apply(dev).collect()) == sorted(judged.collect())


def test_class_weights_shift_the_gate(spark):
    rows = [(i, "same text", str(i % 2)) for i in range(40)]
    both = spark.createDataFrame(rows, "i int, input string, label string")
    for weights, output in (({"weight_accept": 5.0}, True), ({"weight_reject": 5.0}, False)):
        gate, _ = fit_gate(both, both, GateConfig(features=64, penalties=(0.0,), max_iter=10, **weights))
        assert gate.apply(both).first().gate_output is output


def load_answers():
    def answer(chats, settings):
        out = []
        for chat in chats:
            n = len(chat[-1]["content"]) % 4
            out.append(f"Answer: {n}\nRationale: {'surely clear' if n else 'odd and vague'} reason")
        return out

    return answer


def test_all_stages(spark, tmp_path):
    path = {n: str(tmp_path / n) for n in ("qa", "generated", "training", "joint", "gates", "predicted", "zero", "critic", "log")}
    questions = [(i, "d", "train", f"q{i}", "why " * (i % 7) + "?", [str(i % 4)]) for i in range(80)]
    write_qa(spark.createDataFrame(questions, QA), path["qa"])
    model = models.Model(load_answers, "answers")

    config = RolloutConfig("exploration", "OEQ", max_turns=2, run_id="g")
    generated = jobs.generate(spark, path["qa"], path["generated"], model, config, path["log"], end=60)
    assert generated.select("id").distinct().count() == 60
    split = jobs.prepare_training(generated, path["training"], path["log"])
    joint = jobs.join_training([split], path["joint"], path["log"])
    assert joint.count() == split.count()
    gate = jobs.train_gate(joint, path["gates"], "exp", config=SMALL, log_path=path["log"])
    loaded = jobs.train_gate(joint, path["gates"], "exp", eval_only=True)
    assert loaded.setting == gate.setting

    config = RolloutConfig("exploration", "OEQ", max_turns=3, run_id="i")
    predicted = jobs.infer(spark, path["qa"], path["predicted"], model, loaded, config, path["log"])
    assert predicted.select("id").distinct().count() == 80
    assert predicted.filter(F.col("confidence_1").isNull()).isEmpty()
    last = jobs.evaluate(predicted).first()
    assert last.n == 80
    again = jobs.generate(spark, path["qa"], path["generated"], model, RolloutConfig("exploration", "OEQ", max_turns=2), start=60)
    assert {r.id for r in again.select("id").collect()} == {f"q{i}" for i in range(60, 80)}

    jobs.zero_shot(spark, path["qa"], path["zero"], model, log_path=path["log"])
    jobs.self_critic(spark, path["qa"], path["critic"], model, path["log"])
    log = read_metrics(spark, path["log"])
    stages = {(r.run_id, r.stage) for r in log.select("run_id", "stage").distinct().collect()}
    for want in [
        ("g", "generated"), ("g", "verdict, turn 0"), ("g", "zero-shot"), ("g", "system"), ("training", "balanced"),
        ("training", "dev"), ("joint", "train"), ("exp", "gate"), ("i", "evaluation, all turns"), ("i", "gate, turn 0"),
        ("i", "comparison"), ("zero-shot", "zero-shot"), ("self-critic", "answer 3"),
    ]:
        assert want in stages, want
    assert any(run == "i" and stage.startswith("questions, turns") for run, stage in stages)
    assert {r.dataset for r in log.filter("run_id IN ('g', 'i', 'training', 'joint')").select("dataset").distinct().collect()} == {"d"}
    rows = log.filter("run_id = 'training' and stage = 'balanced'").collect()
    sizes = {r.metric: r.value for r in rows}
    assert sizes["n_reject"] == min(sizes["n_reject"], sizes["n_accept"]) and sizes["n_rows"] == split.count()
