import collections
import random

import plain
import pytest
from pyspark.sql import functions as F

from askloop.operators import metrics
from askloop.schemas import METRICS_LOG, PREDICTIONS


def turns(spark, seed=1, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        gold = [rng.choice(["red cat", "blue", "dog"]), "x"]
        for t in range(rng.randrange(1, 6)):
            answer = rng.choice([gold[0], "blue cat", "unsure", "none of above", "dog", ""])
            right = int(answer in gold)
            rows.append((rng.choice("ab") if i else "a", "s", f"q{i}", t, "c", answer, "r", gold, rng.random() < 0.4, right, 0.4, 0.6))
    # One data set a question.
    first = {}
    rows = [(first.setdefault(r[2], r[0]), *r[1:]) for r in rows]
    return spark.createDataFrame(rows, PREDICTIONS), [(r[0], *r[2:]) for r in rows]


def last_rows(rows):
    out = {}
    for r in rows:
        out[r[1]] = r
    return list(out.values())


def mean(values):
    values = list(values)
    return sum(values) / len(values)


def confusion(rows):
    c = collections.Counter((r[8], r[7]) for r in rows)
    return c[0, False], c[0, True], c[1, False], c[1, True]


def test_custom_evaluation(spark):
    df, rows = turns(spark)
    last = last_rows(rows)
    got = {r.scope: r for r in metrics.custom_evaluation(df).collect()}
    for scope, part in (("all turns", rows), ("last turn", last)):
        tn, fp, fn, tp = confusion(part)
        r = got[scope]
        assert (r.num_points, r.tn, r.fp, r.fn, r.tp) == (len(part), tn, fp, fn, tp)
        assert r.gate_accuracy == pytest.approx((tp + tn) / len(part))
        assert r.gate_precision == pytest.approx(tp / (tp + fp))
        assert r.gate_recall == pytest.approx(tp / (tp + fn))
        assert r.gate_f1 == pytest.approx(2 * tp / (2 * tp + fp + fn))
        assert r.gate_fpr == pytest.approx(fp / (fp + tn))
        assert r.gate_tnr == pytest.approx(tn / (tn + fp))
        assert r.system_accuracy == pytest.approx(mean(x[8] for x in last))
        assert r.f1 == pytest.approx(mean(plain.f1(x[4].split(), [g.split() for g in x[6]]) for x in last))
        assert r.formula == pytest.approx(mean(0 if not x[7] else 1 if x[8] else -1 for x in last))


def test_formula_and_accuracy(spark):
    df, rows = turns(spark, 2)
    last = last_rows(rows)
    withheld = {"unsure", "none of above"}
    scores = [0 if x[4] in withheld else 1 if x[8] else -1 for x in last]
    got = metrics.formula_zero_shot(df).first()
    assert (got.formula_sum, got.n_withheld, got.n) == (sum(scores), scores.count(0), len(last))
    compat = [0 if x[4] == "unsure" else 1 if x[8] else -1 for x in last]
    assert metrics.formula_zero_shot(df, compat=True).first().formula_sum == sum(compat)
    accuracy = metrics.accuracy(df, by=["dataset"], overall=True).collect()
    for r in accuracy:
        part = [x for x in last if r.dataset in (None, x[0])]
        assert (r.n, r.correct) == (len(part), sum(x[8] for x in part))


def test_one_class_and_empty_tables(spark):
    df, _ = turns(spark, 3, 5)
    one = df.withColumns({"gate_output": F.lit(False), "correct": F.lit(0)})
    cells = metrics.gate_confusion(one).first()
    assert (cells.fp, cells.fn, cells.tp) == (0, 0, 0) and cells.gate_precision == 0 and cells.gate_accuracy == 1
    none = df.filter(F.lit(False))
    assert metrics.gate_confusion(none).first().tn == 0
    assert metrics.f1_score(none).first().f1 == 0
    opening = metrics.first_turn_metrics(none).first()
    assert (opening.n, opening.accuracy, opening.f1) == (0, None, None)


def test_turn_tables(spark):
    df, rows = turns(spark, 4)
    want = collections.Counter((r[2], r[7]) for r in rows)
    for r in metrics.turn_by_gate(df).collect():
        assert (r.rejected, r.accepted) == (want[r.turn, False], want[r.turn, True])
    sizes = collections.Counter(collections.Counter(r[1] for r in rows).values())
    assert {r.turns: r.n_questions for r in metrics.group_sizes(df).collect()} == sizes
    values = collections.Counter(str(r[7]).lower() for r in rows)
    got = metrics.value_counts(df, ["gate_output"]).collect()
    assert {r.value: r.n for r in got} == values


def test_first_and_last_rows(spark):
    df, rows = turns(spark, 5)
    last = {r[1]: (r[2], r[4], r[7]) for r in rows}
    assert {r.id: (r.turn, r.answer, r.gate_output) for r in metrics.last_turn(df.repartition(7)).collect()} == last
    assert {r.turn for r in metrics.first_turn(df).collect()} == {0}
    assert metrics.distinct_questions(df).first()[0] == len(last)
    assert abs(metrics.distinct_questions(df, approximate=True).first()[0] - len(last)) <= 6


def test_same_id_in_two_data_sets(spark):
    rows = [(d, "s", "1", t, "c", "a", "r", ["a"], True, int(d == "x"), 0.0, 1.0) for d in "xy" for t in range(2)]
    got = metrics.accuracy(spark.createDataFrame(rows, PREDICTIONS)).first()
    assert (got.n, got.correct) == (2, 1)


def test_class_report_counts_unknown_predictions_as_errors(spark):
    pairs = [("0", "0"), ("0", "1"), ("1", "1"), ("1", "?"), ("1", None), ("0", "0")]
    r = metrics.class_report(spark.createDataFrame(pairs, "label string, said string"), "label", "said").first()
    assert r.accuracy == pytest.approx(3 / 6)
    assert (r.precision_0, r.recall_0) == (1.0, pytest.approx(2 / 3))
    assert (r.precision_1, r.recall_1, r.f1_1) == (0.5, pytest.approx(1 / 3), pytest.approx(0.4))


def test_long_form(spark):
    df, _ = turns(spark, 6)
    long = metrics.to_long(metrics.accuracy(df, by=["dataset"]), "r", "s")
    assert [f"{f.name} {f.dataType.simpleString()}" for f in long.schema] == METRICS_LOG.split(", ")
    assert {r.metric for r in long.collect()} == {"n", "correct", "accuracy", "f1"}
    by_turn = metrics.to_long(metrics.turn_by_gate(df), "r", "gate, turn", "turn").collect()
    assert "gate, turn 0" in {r.stage for r in by_turn} and {r.dataset for r in by_turn} == {None}
