"""What the plans of the large-scale steps look like."""

import re

import pytest
from pyspark.sql import functions as F

from askloop.functions import text
from askloop.operators import metrics, redundancy, rollout, trainset
from askloop.operators.sampling import number_rows
from askloop.schemas import PREDICTIONS, TRAINING
from askloop.sources import tables


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return re.findall(r"Exchange (\w+)", plan(df).replace("BroadcastExchange", "Broadcast"))


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("plans") / "turns")
    rows = [("d", "s", f"q{i // 4}", i % 4, "content", "a", "r", ["a"], i % 3 == 0, i % 2, 0.5, 0.5) for i in range(400)]
    spark.createDataFrame(rows, PREDICTIONS).write.parquet(path)
    return spark.read.schema(PREDICTIONS).parquet(path)


@pytest.mark.parametrize(
    "report", [metrics.accuracy, metrics.formula_gated, metrics.custom_evaluation, metrics.compare_report, metrics.system_report]
)
def test_question_metrics_shuffle_once_and_hash(stored, report):
    """One exchange by question, then one of a single row per task; no sort, no text beyond answer and gold."""
    shown = plan(report(stored))
    assert "SortAggregate" not in shown and "Sort [" not in shown and "Window" not in shown
    assert exchanges(report(stored)) == ["SinglePartition", "hashpartitioning"]
    read = re.search(r"ReadSchema: struct<(.*?)>(?:\n|$)", shown).group(1)
    assert "rationale" not in read and "task_content" not in read


@pytest.mark.parametrize("report", [metrics.turn_by_gate, metrics.turn_by_correct, metrics.gate_confusion])
def test_counting_reports_read_two_columns(stored, report):
    read = re.search(r"ReadSchema: struct<(.*?)>", plan(report(stored))).group(1)
    assert len(read.split(",")) == 2


def test_text_functions_need_no_python_and_no_shuffle(stored):
    shown = plan(stored.select(text.token_f1(F.col("answer"), F.col("gold")), text.exact_match(F.col("answer"), F.col("gold"))))
    assert "Python" not in shown and "Exchange" not in shown


def training(stored):
    return stored.select(*[c.split()[0] for c in TRAINING.replace("gate_verdict", "correct").split(", ")]).withColumnRenamed(
        "correct", "gate_verdict"
    )


def test_balance_moves_no_row(stored):
    assert exchanges(trainset.balance(training(stored))) == []


@pytest.mark.parametrize("pick", [metrics.last_turn, metrics.first_turn])
def test_turn_rows_are_picked_by_hash(stored, pick):
    assert "SortAggregate" not in plan(pick(stored))


def test_redundancy_aggregates_by_hash_and_gathers_no_question(stored):
    shown = plan(redundancy.rationale_redundancy(stored))
    assert "Window" not in shown and "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_numbering_gathers_one_row_a_partition(spark, stored):
    sparse = spark.range(2_000).select((F.col("id") * 1_000_003).alias("v"))
    shown = plan(number_rows(sparse, ["v"], []))
    before, _, after = shown.partition("SinglePartition")
    assert "Range" not in after and "HashAggregate(keys=[_part" in after


def test_accuracy_without_f1_reads_no_answer(stored):
    read = re.search(r"ReadSchema: struct<(.*?)>", plan(metrics.accuracy(stored, with_f1=False))).group(1)
    assert "answer" not in read and "gold" not in read


@pytest.mark.parametrize("name", ["row_slice", "first_rows", "norm_answers", "parse_responses", "assistant_output"])
def test_slices_and_projections_have_no_exchange(spark, name):
    from askloop.plans.queries import QUERIES

    assert "Exchange" not in plan(QUERIES[name](spark, "/root/testdata/sf0.001"))


def test_split_joins_on_the_question_only(stored):
    shown = plan(trainset.group_split(training(stored)))
    assert "SinglePartition" not in shown and "CartesianProduct" not in shown and "NestedLoop" not in shown


def test_slices_reach_the_scan(spark, tmp_path):
    rows = [(i, "d", "s", str(i), "q", ["0"]) for i in range(50)]
    tables.write_qa(spark.createDataFrame(rows, tables_schema()), str(tmp_path / "qa"))
    qa = tables.read_qa(spark, str(tmp_path / "qa"))
    for part, n in ((rollout.row_slice(qa, 5, 9), 4), (trainset.first_rows(qa, 7), 7)):
        assert part.count() == n
        assert "LessThan(row_index," in plan(part)


def tables_schema():
    from askloop.schemas import QA

    return QA


def test_replay_truncation_has_no_window(stored):
    assert "Window" not in plan(rollout.truncate_replay(stored, F.col("gate_output")))
