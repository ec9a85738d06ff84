import csv
import json
import random
from pathlib import Path

import pandas as pd
import pytest
from pyspark.sql import functions as F

from askloop.schemas import GENERATED, METRICS_LOG, PREDICTIONS, QA, RAW_MCQ, SELF_CRITIC, ZERO_SHOT
from askloop.sources import corpora, tables
from askloop.sources.ranges import _lines
from askloop.sources.tables import append_metrics, read_csv, read_metrics, read_slice

NASTY = 'say "hi", it\'s\n new \\ line\r\n ,x '


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_question_csv_both_ways(spark, tmp_path):
    data = [(0, "d", "dev", "a", NASTY, ["0"]), (1, "d", "dev", "b", " lead", ["it's", 'q"q', "both '\"", "a\\b"])]
    qa = spark.createDataFrame(data, QA)
    tables.write_csv(qa, str(tmp_path / "qa"), "qa", indexed=True)
    back = tables.read_csv(spark, str(tmp_path / "qa"), "qa", "d", indexed=True)
    names = ("row_index", "id", "question", "gold")
    assert rows(back, *names) == rows(qa, *names)


def test_reads_what_pandas_writes(spark, tmp_path):
    frame = pd.DataFrame({"ID": ["a", "b"], "Question": [NASTY, "q"], "Answers": [["0"], ["it's", "x"]]})
    frame.to_csv(tmp_path / "x.csv", index=True)
    back = tables.read_csv(spark, str(tmp_path / "x.csv"), "qa", "d", indexed=True)
    assert rows(back, "row_index", "id", "question", "gold") == [(0, "a", NASTY, ["0"]), (1, "b", "q", ["it's", "x"])]


def test_pandas_reads_what_we_write(spark, tmp_path):
    data = [("d", "", "a", 1, NASTY, "007", "r", ["0", "it's"], True, 1, 0.25, 0.75)]
    tables.write_csv(spark.createDataFrame(data, PREDICTIONS).coalesce(1), str(tmp_path / "p"), "predictions")
    (part,) = (tmp_path / "p").glob("*.csv")
    row = pd.read_csv(part, dtype={"Reasoner Answer": str}).iloc[0]
    assert row["Reasoner Task Content"] == NASTY and row["Reasoner Answer"] == "007"
    assert row["Gold Answer"] == "['0', \"it's\"]" and row["Gate Output"] == True  # noqa: E712
    assert row["Confidence Scores"] == "0: 0.2500, 1: 0.7500"


@pytest.mark.parametrize(
    "kind,schema,data",
    [
        ("generated", GENERATED, [("d", "", "1", 0, NASTY, "", "r", ["0"], 1), ("d", "", "2", 1, "c", "0", None, ["a"], 0)]),
        ("predictions", PREDICTIONS, [("d", "", "1", 0, "c", "0", "r", ["0"], False, 1, None, None), ("d", "", "1", 1, "c", "1", "r", ["0"], True, 0, 0.1, 0.9)]),
        ("zero_shot", ZERO_SHOT, [("d", "", "1", "q", ["0"], "00", 0)]),
        ("self_critic", SELF_CRITIC, [("d", "", "1", "q", ["0"], "1", None, "0", 0, 0, 1, NASTY)]),
    ],
)
def test_every_exchanged_table_round_trips(spark, tmp_path, kind, schema, data):
    df = spark.createDataFrame(data, schema)
    tables.write_csv(df, str(tmp_path / kind), kind)
    back = tables.read_csv(spark, str(tmp_path / kind), kind, "d")
    assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
    assert rows(back, "*") == rows(df, "*")


def training_file(path, ids):
    pd.DataFrame(
        {
            "ID": ids, "Turn": 0, "Reasoner Task Content": "c", "Reasoner Answer": "1", "Reasoner Rationale": "r",
            "Gold Answer": "['1']", "Gate Verdict": 1,
        }
    ).to_csv(path, index=False)


def test_split_files(spark, tmp_path):
    for name, n in (("train", 200), ("val", 3), ("test", 4)):
        training_file(tmp_path / name, [f"{name}{i}" for i in range(n)])
    paths = {n: str(tmp_path / n) for n in ("train", "val", "test")}
    whole = tables.load_splits(spark, **paths)
    sizes = {r.split: r["count"] for r in whole.groupBy("split").count().collect()}
    assert sizes == {"train": 200, "val": 3, "test": 4}
    sampled = tables.load_splits(spark, paths["train"], None, paths["test"]).filter("split = 'val'")
    again = tables.load_splits(spark, paths["train"], None, paths["test"]).filter("split = 'val'")
    assert 10 < sampled.count() < 80 and rows(sampled, "id") == rows(again, "id")
    parted = tables.load_splits(spark, paths["train"], None, paths["test"])
    assert parted.filter("split IN ('train', 'val')").select("id").distinct().count() == parted.filter("split <> 'test'").count() == 200
    doubled = tables.load_splits(spark, paths["train"], None, paths["test"], compat=True)
    assert doubled.filter("split = 'train'").count() == 200
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        tables.load_splits(spark, paths["train"], str(tmp_path / "gone"), paths["test"])


def test_files_by_name_pattern(spark, tmp_path):
    for d in ("one", "two"):
        training_file(tmp_path / f"exp_{d}_generated_train.csv", [d])
    got = tables.read_many(spark, str(tmp_path), "exp", ["one", "two"], "train", "training")
    assert rows(got, "dataset", "id") == [("one", "one"), ("two", "two")]


def test_raw_records(spark, tmp_path):
    record = {"id": "x", "question": "q", "choices": {"label": ["A", "B"], "text": ["u", "v"]}, "answerKey": "B", "extra": 1}
    (tmp_path / "r.json").write_text(json.dumps(record))
    raw = tables.read_raw(spark, str(tmp_path / "r.json"), RAW_MCQ).withColumn("row_index", F.lit(0))
    row = corpora.normalise_mcq(raw, "d", "train").first()
    assert (row.question, row.gold) == ("q\nChoices: [0: 'u', 1: 'v'].", ["1"])
    raw.drop("row_index").write.parquet(str(tmp_path / "p"))
    assert tables.read_raw(spark, str(tmp_path / "p"), RAW_MCQ, "parquet").count() == 1


def test_pairs_and_clozes(spark):
    pair = spark.createDataFrame([(3, "g", "s", "t", 1)], "row_index int, goal string, sol1 string, sol2 string, label int")
    assert corpora.normalise_pair(pair, "d", "dev").first().question == "g\nChoices: ['0': 's', '1': 't']."
    cloze = spark.createDataFrame([(3, "a _ b_", "s", "t", "2")], "row_index int, sentence string, option1 string, option2 string, answer string")
    row = corpora.normalise_cloze(cloze, "d", "dev").first()
    assert (row.id, row.question, row.gold) == ("3", "a [MASK] b[MASK]\nChoices: [0: 's', 1: 't'].", ["1"])


def test_question_partitions_are_pruned(spark, tmp_path):
    data = [(i, "d" if i % 2 else "e", "dev", str(i), "q", ["0"]) for i in range(10)]
    tables.write_qa(spark.createDataFrame(data, QA), str(tmp_path / "qa"))
    part = tables.read_qa(spark, str(tmp_path / "qa")).filter("dataset = 'd' and row_index < 5")
    assert part.count() == 2
    plan = part._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(dataset" in plan and "LessThan(row_index,5)" in plan


def test_sets_and_runs(spark, tmp_path):
    df = spark.createDataFrame([("d", "s", "1", 0, "c", "1", "r", ["1"], 1)], GENERATED)
    tables.append_results(df, str(tmp_path / "r"), "one")
    tables.append_results(df, str(tmp_path / "r"), "two")
    assert spark.read.parquet(str(tmp_path / "r")).filter("run_id = 'one'").count() == 1
    tables.write_sets(df.withColumn("side", F.lit("dev")), str(tmp_path / "s"))
    assert (tmp_path / "s" / "side=dev").is_dir()
    assert rows(corpora.split_sizes(spark.createDataFrame([(0, "d", "dev", "a", "q", ["0"])], QA)), "*") == [("d", "dev", 1)]


@pytest.mark.parametrize("bytes_a_range", [64, 300, 1 << 20])
def test_csv_ranges_cut_anywhere(spark, tmp_path, bytes_a_range):
    rng = random.Random(bytes_a_range)
    pieces = ["a", "é", " ", ",", '"', '""', "\n", "\r\n", "\n\n", "word", ""]
    rows = [(f"id{i}", str(i % 5), *["".join(rng.choices(pieces, k=rng.choice([0, 3, 40, 900]))) for _ in range(3)], "['x']", str(i % 2)) for i in range(60)]
    path = tmp_path / "one.csv"
    with open(path, "w", newline="") as f:
        writer = csv.writer(f, lineterminator="\n" if bytes_a_range == 300 else "\r\n")
        writer.writerow(["ID", "Turn", "Reasoner Task Content", "Reasoner Answer", "Reasoner Rationale", "Gold Answer", "Gate Verdict"])
        writer.writerows(rows)
    (tmp_path / "two.csv").write_text('ID,Turn,"Reasoner\nTask",A,R,G,V\nlast,1,,,,"[]",1')
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(bytes_a_range))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = read_csv(spark, [str(path), str(tmp_path / "two.csv")], "training", "d", by_ranges=True).collect()
        ranges = _lines(spark, str(path)).select("start").distinct().count()
        tasks = _lines(spark, str(path)).rdd.getNumPartitions()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert bytes_a_range > 1000 or (ranges > 20 and tasks > 20)
    told = {(r.id, r.turn, r.task_content or "", r.answer, r.rationale or "", r.gate_verdict) for r in got}
    expected = {(i, int(t), c, a, w, int(v)) for i, t, c, a, w, _, v in rows} | {("last", 1, "", "", "", 1)}
    assert len(got) == len(rows) + 1 and told == expected


def test_a_slice_counts_through_all_tables_and_reads_their_files_only(spark, tmp_path):
    paths = [str(tmp_path / n) for n in ("b set", "a")]
    for k, path in enumerate(paths):
        spark.range(k * 100, k * 100 + 40, numPartitions=4).write.parquet(path)
    whole = [*range(40), *range(100, 140)]
    for start, end in ((0, None), (0, 0), (35, 52), (10, 20), (79, 200), (80, 90), (39, 41)):
        got = {r.position: r.id for r in read_slice(spark, paths, "id bigint", start, end).collect()}
        assert got == {i: v for i, v in enumerate(whole) if i >= start and (end is None or i < end)}
    cut = read_slice(spark, paths, "id bigint", 35, 52)
    for part in [p for path in paths for p in sorted(Path(path).glob("part-*"))][:3]:
        part.write_bytes(b"no parquet")  # the slice begins in the fourth file
    assert sorted(r.id for r in cut.collect()) == whole[35:52]


def test_a_rerun_replaces_its_stages_in_the_log(spark, tmp_path):
    def rows(run, stage, value):
        return spark.createDataFrame([(run, "d", stage, "m", value, str(value))], METRICS_LOG)

    log = str(tmp_path / "log")
    for run, stage, value in (("1", "a", 1.0), ("1", "b, turn 2", 2.0), ("2", "a", 3.0), ("1", "a", 4.0)):
        append_metrics(rows(run, stage, value), log)
    assert sorted(tuple(r)[:5] for r in read_metrics(spark, log).collect()) == [
        ("1", "d", "a", "m", 4.0), ("1", "d", "b, turn 2", "m", 2.0), ("2", "d", "a", "m", 3.0)
    ]
