import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from askloop.functions import encoding
from askloop.operators import trainset
from askloop.operators.sampling import number_rows, seeded_key
from askloop.schemas import TRAINING
from askloop.sources import corpora


def training(spark, seed=1, n=400, hot=0, share=0.25):
    rng = random.Random(seed)
    rows = [
        (rng.choice("ab"), "s", f"q{i % 90}", i, f"content {i}", "a", "r", ["a"], int(rng.random() < share)) for i in range(n)
    ]
    rows += [("a", "s", "hot", i, "c", "a", "r", ["a"], i % 2) for i in range(hot)]
    return spark.createDataFrame(rows, TRAINING)


def classes(df):
    return {(r.dataset, r.gate_verdict): r["count"] for r in df.groupBy("dataset", "gate_verdict").count().collect()}


def test_balance_is_exact_per_data_set(spark):
    df = training(spark, hot=200)
    before, after = classes(df), classes(trainset.balance(df))
    for d in "ab":
        assert after[d, 1] == before[d, 1]
        assert after[d, 0] == min(before[d, 0], before[d, 1])


def test_balance_takes_the_smallest_keys_and_repeats(spark):
    df = training(spark)
    got = trainset.balance(df).filter("gate_verdict = 0").collect()
    assert sorted(got) == sorted(trainset.balance(df.repartition(3)).filter("gate_verdict = 0").collect())
    keys = df.filter("gate_verdict = 0").withColumn("k", seeded_key(42, "dataset", "split", "id", "turn")).collect()
    for d in "ab":
        mine = sorted(r.shuffle_key for r in got if r.dataset == d)
        assert mine == sorted(r.k for r in keys if r.dataset == d)[: len(mine)]


def test_balance_never_grows_or_reverses(spark):
    df = training(spark, share=0.8)
    assert classes(trainset.balance(df)) == classes(df)


def test_split_keeps_questions_together(spark):
    df = training(spark, hot=200)
    split = trainset.group_split(df)
    assert split.count() == df.count()
    assert set(split.columns) == {*df.columns, "side"}
    sides = split.groupBy("dataset", "id").agg(F.count_distinct("side").alias("n")).collect()
    assert {r.n for r in sides} == {1}
    groups = trainset.split_groups(df)
    for r in groups.groupBy("dataset").agg(F.count("*").alias("n"), F.sum((F.col("side") == "dev").cast("int")).alias("dev")).collect():
        assert r.dev == math.ceil(r.n * 0.2)
    for r in (
        groups.groupBy("dataset", "group_label")
        .agg(F.count("*").alias("n"), F.sum((F.col("side") == "dev").cast("int")).alias("dev"))
        .collect()
    ):
        assert abs(r.dev - 0.2 * r.n) <= 1


def test_no_leak_between_splits(spark):
    split = trainset.group_split(training(spark))
    ids = {s: split.filter(F.col("side") == s).select("dataset", "id") for s in ("train", "dev")}
    assert ids["train"].intersect(ids["dev"]).isEmpty()


def quota(counts, share):
    """Largest remainder on the train side, in plain Python."""
    n = sum(counts.values())
    train = n - math.ceil(round(n * share, 6))
    exact = {k: train * c / n for k, c in counts.items()}
    whole = {k: math.floor(e) for k, e in exact.items()}
    rest = sorted(counts, key=lambda k: (-round(exact[k] - whole[k], 9), k))[: train - sum(whole.values())]
    return {k: counts[k] - whole[k] - (k in rest) for k in counts}


def test_dev_quota(spark):
    cases = [(1, 1), (3, 1), (10, 5), (7, 13), (100, 1), (33, 67), (1, 0)]
    rows = [(str(i), k, c) for i, pair in enumerate(cases) for k, c in enumerate(pair) if c]
    sizes = spark.createDataFrame(rows, "dataset string, group_label int, _groups bigint")
    got = Counter()
    for r in trainset.dev_quota(sizes, ["dataset"], 0.2).collect():
        got[r.dataset, r.group_label] = r["take"]
    for i, pair in enumerate(cases):
        want = quota({k: c for k, c in enumerate(pair) if c}, 0.2)
        assert {k: got[str(i), k] for k in want} == want, pair


def test_group_label_ties_go_to_the_smallest(spark):
    votes = [("t", 1), ("t", 0), ("u", 1), ("v", 1), ("v", None), ("v", None), ("w", None)]
    rows = [("d", "s", q, t, "", "", "", [], vote) for t, (q, vote) in enumerate(votes)]
    labels = trainset.group_labels(spark.createDataFrame(rows, TRAINING)).collect()
    assert {r.id: r.group_label for r in labels} == {"t": 0, "u": 1, "v": 1, "w": 0}


def test_join_tag_and_first_rows(spark):
    one, two = training(spark, 1, 30), training(spark, 2, 50)
    assert trainset.join_sets(one, two).count() == 80
    tagged = trainset.tag_sides(one, two, one)
    assert {r.side: r["count"] for r in tagged.groupBy("side").count().collect()} == {"train": 30, "val": 50, "test": 30}
    assert [r.turn for r in trainset.first_rows(one, 3, "turn").collect()] == [0, 1, 2]


def test_instruction_text(spark):
    rows = [("d", "s", "t", 3, "Q: hi \n\nGround-truth Answer: 3\n", "3", None, ["3"], 1)]
    got = trainset.to_instruct(spark.createDataFrame(rows, TRAINING)).first()
    assert got.label == "1"
    assert got.input.split("\n")[1:] == ["Q: hi ", "Answer: 3", "Rationale: "]
    gradual = trainset.to_instruct(spark.createDataFrame(rows, TRAINING), setting="gradual").first()
    assert gradual.input.split("\n")[2:] == ["LLM Answer: 3", "LLM Rationale: "]


def test_encoding(spark):
    texts = spark.createDataFrame([(1, "b c b zz", "1"), (2, "", "0"), (3, "b " * 9, "1")], "i int, input string, label string")
    words = trainset.build_vocabulary(texts, "input", 2)
    assert {r.word: r.token_id for r in words.collect()} == {"b": 5, "c": 6}
    rows = {r.i: r for r in trainset.encode_pad(texts, trainset.VocabularyTokenizer(words), ["i"], 6, 3).collect()}
    assert rows[1].input_ids == [5, 6, 5, trainset.UNKNOWN, trainset.END, 0]
    assert rows[1].attention_mask == [1, 1, 1, 1, 1, 0]
    assert rows[1].labels == [trainset.ONE, trainset.END, -100]
    assert rows[2].input_ids == [trainset.END, 0, 0, 0, 0, 0]
    assert rows[3].input_ids == [5, 5, 5, 5, 5, trainset.END]
    assert {r.word: r.token_id for r in trainset.build_vocabulary(texts, "input").collect()} == {"b": 5, "c": 6, "zz": 7}


@pytest.mark.parametrize("at_hand", [0, 3, 1 << 15])
def test_rare_words_are_looked_up_like_frequent_ones(spark, at_hand):
    rng = random.Random(at_hand)
    texts = [(i, None if i == 7 else " ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randrange(40))), str(i % 2)) for i in range(80)]
    table = spark.createDataFrame(texts, "i int, input string, label string")
    words = trainset.build_vocabulary(table.filter("i < 60"), "input")
    ids = {r.word: r.token_id for r in words.collect()} | {"0": trainset.ZERO, "1": trainset.ONE}
    got = trainset.VocabularyTokenizer(words, at_hand).ids(table, ["i"], {"input": 20, "label": 4}).collect()
    assert len(got) == len(texts)
    for r in got:
        _, text, label = texts[r.i]
        assert r.input == [ids.get(w, trainset.UNKNOWN) for w in (text or "").split()[:19]] + [trainset.END]
        assert r.label == [ids[label], trainset.END]
    empty = trainset.VocabularyTokenizer(words, at_hand).ids(table.filter("i < 0"), ["i"], {"input": 20, "label": 4})
    assert empty.collect() == []


def load_lengths():
    return lambda texts: [[len(w) for w in t.split()] for t in texts]


def test_tokenizer_plug_in(spark):
    texts = spark.createDataFrame([(1, "b cc ddd", "1")], "i int, input string, label string")
    row = trainset.encode_pad(texts, trainset.CallableTokenizer(load_lengths), ["i"], 5, 2).first()
    assert row.input_ids == [1, 2, 3, 0, 0] and row.attention_mask == [1, 1, 1, 0, 0] and row.labels == [1, -100]


def test_label_recodes_and_collation(spark):
    df = spark.createDataFrame([(0, [4, 1, -100])], "b int, l array<int>")
    row = df.select(
        encoding.restore_pad(F.col("l"), 0).alias("r"), encoding.binary_targets(F.col("l"), 3, 4).alias("t")
    ).first()
    assert row.r == [4, 1, 0] and row.t == [1, -100, -100]
    rows = [(0, 0, [1] * 3, [1] * 3, [4]), (1, 0, [1] * 9, [1] * 9, [4, 1]), (2, 1, [1], [1], [3])]
    df = spark.createDataFrame(rows, "i int, b int, input_ids array<int>, attention_mask array<int>, labels array<int>")
    got = {r.i: r for r in encoding.collate(df, "b", 0).collect()}
    assert [len(got[i].input_ids) for i in range(3)] == [16, 16, 8]
    assert got[0].attention_mask == [1] * 3 + [0] * 13 and got[0].labels == [4] + [-100] * 7


def test_row_numbers(spark):
    values = random.Random(2).sample(range(10**7), 5000)
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    numbered = {r.v: r.row_index for r in number_rows(df, ["v"], []).collect()}
    assert numbered == {v: i for i, v in enumerate(sorted(values))}
    grouped = number_rows(df.withColumn("g", F.col("v") % 3), [F.desc("v")], ["g"]).collect()
    for g in range(3):
        assert {r.v: r.row_index for r in grouped if r.g == g} == {v: i for i, v in enumerate(sorted((v for v in values if v % 3 == g), reverse=True))}
    shuffled = corpora.number_shuffled(df, ["v"])
    assert sorted(r.row_index for r in shuffled.collect()) == list(range(5000))
    assert {tuple(r) for r in shuffled.collect()} == {tuple(r) for r in corpora.number_shuffled(df.repartition(5), ["v"]).collect()}


def test_letters(spark):
    df = spark.createDataFrame([("A",), ("E",), ("F",), ("",), ("AB",), (None,)], "l string")
    assert [r[0] for r in df.select(corpora.letter_index(F.col("l"))).collect()] == ["0", "4", None, None, None, None]
