import random
import tracemalloc

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloop.functions import text
from askloop.operators import redundancy
from askloop.schemas import KEYS

HOW = ["bitand", "min"]


def texts(rng, n):
    return [" ".join(rng.choices([f"w{i}" for i in range(30)] + ["a:b", "x#1", "Über"], k=rng.randrange(60))) for _ in range(n)]


def elements(held, how):
    words = pa.array([plain.re.findall(r"\w\w+", t.lower()) for t in held], pa.list_(pa.string()))
    return redundancy._elements(words, how)


@pytest.mark.parametrize("how", HOW)
def test_elements_share_what_the_texts_share(how):
    rng = random.Random(how)
    held = ["", "xx", "xx xx xx", *texts(rng, 20), ""]
    got, weight = elements(held, how)
    for part in (slice(0, 3), slice(3, 24), slice(5, 5)):  # the same whatever else is in the batch
        assert elements(held[part], how)[0].to_pylist() == got.to_pylist()[part]
    sets = [e.split() for e in got.to_pylist()]
    assert all(len(s) == len(set(s)) for s in sets)
    for i, a in enumerate(sets):
        assert weight[i] == plain.overlap(held[i], held[i], how)
        for j, b in enumerate(sets):
            assert sum(int(e.split(":")[0]) for e in set(a) & set(b)) == plain.overlap(held[i], held[j], how)


def test_no_question_is_a_call_of_its_own(spark, tmp_path):
    rows = [("d", "s", f"{i // 2}", i % 2, "x " * 30 + f"same words here {i % 3}") for i in range(20)]
    spark.createDataFrame(rows, "dataset string, split string, id string, turn int, rationale string").write.parquet(str(tmp_path / "t"))
    counts = redundancy.rationale_redundancy(spark.read.parquet(str(tmp_path / "t")), 3)
    assert {(r.n_redundant, r.n_questions) for r in redundancy.redundancy_histogram(counts).collect()} == {(1, 10)}
    vectors = redundancy._distinct_vectors(spark.read.parquet(str(tmp_path / "t")), 3, "bitand")
    shown = redundancy._overlapped(vectors, 3)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in shown and shown.count("MapInArrow") >= 2


@pytest.mark.parametrize("how", HOW)
def test_groups_are_tested_together_wherever_a_batch_ends(monkeypatch, how):
    monkeypatch.setattr(redundancy, "BYTES", 700)
    rng = random.Random(f"x{how}")
    rows, want = [], {}
    for g in range(60):
        held = texts(rng, rng.choice([2, 2, 3, 4, redundancy.FEW, redundancy.FEW + 1, 40]))
        last = sorted(rng.sample(range(1000), len(held)))
        rows += [("d", "s", f"g{g:02d}", 0, 0, 0, turn, e) for turn, e in zip(last, elements(held, how)[0].to_pylist()) if e]
        later = [[plain.overlap(a, b, how) for b in held[i + 1 :]] for i, a in enumerate(held)]
        want |= {(f"g{g:02d}", turn): max(s, default=0) for turn, s in zip(last, later)}
    names = [*redundancy.MEETING, "_own", "last", "elements"]
    table = pa.table({n: [r[i] for r in rows] for i, n in enumerate(names)})
    for size in (1, 7, 64, len(rows)):
        got = pa.Table.from_batches(redundancy._by_groups(iter(table.to_batches(size)), 15)).select([*KEYS, "last"])
        assert {(r["id"], r["last"]) for r in got.to_pylist()} == {k for k, shared in want.items() if shared >= 15}
        assert len(got) == len({k for k, shared in want.items() if shared >= 15})


def test_many_small_questions_are_few_pieces_of_work(monkeypatch):
    """A batch of 5,000 questions of two: they are tested by the megabyte, and none on its own."""
    calls = []
    among_few = redundancy._found_among_few
    monkeypatch.setattr(redundancy, "_found_among_few", lambda *a: calls.append(1) or among_few(*a))
    monkeypatch.setattr(redundancy, "_found", None)
    n, text = 10_000, " ".join(f"1:w{i}" for i in range(150))
    table = pa.table({
        "dataset": ["d"] * n, "split": ["s"] * n, "id": [f"{i // 2:05d}" for i in range(n)], "_one": [0] * n, "_two": [0] * n, "_own": [0] * n,
        "last": np.arange(n) % 2, "elements": [f"{text} 1:z{i}" for i in range(n)],
    })
    tracemalloc.start()
    got = pa.Table.from_batches(redundancy._by_groups(iter(table.to_batches()), 150))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == n // 2 and len(calls) <= 5
    assert peak < 30 * redundancy.BYTES


SCHEMA = "dataset string, split string, id string, turn int, rationale string"


def test_words_are_those_of_the_column_expression(spark):
    odd = ["", " ", "x", "A-b ab_c", "É", "Éa·bé", "naïve—Über a\u00a0b", "x\u0301yz", "日本 日本語", "a\x00bb\x1fcc\ncc", "½½ ²³x", "I\u0307İstanbul", "😀ab😀c", "__ 12 1"]
    rng = random.Random(1)
    held = odd + ["".join(rng.choices("aZ9_ .-\té·日😀½\u0301", k=rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(held)], "i int, t string")
    rows = df.select(text.ascii_cut(F.col("t")).alias("cut"), text.word_tokens(F.col("t")).alias("words")).orderBy("i").collect()
    cut = pa.array([r.cut for r in rows])
    for low, high in ((0, len(rows)), (5, 40), (7, 7)):
        row, told = redundancy._words(cut[low:high])
        got = [[] for _ in range(high - low)]
        for r, word in zip(row, told.to_pylist()):
            got[r].append(word)
        assert got == [r.words for r in rows[low:high]]


def test_every_character_is_cut_as_the_column_expression_cuts_it(spark):
    held = ["".join(f"ab{chr(c)}cd " for c in range(low, low + 512) if not 0xD800 <= c < 0xE000) for low in range(0, 0x110000, 512)]
    df = spark.createDataFrame([(t,) for t in held], "t string").repartition(8)
    same = F.array_join(text.word_tokens(F.col("t")), " ") == F.array_join(text.word_tokens(text.ascii_cut(F.col("t"))), " ")
    beyond = F.regexp_extract_all(text.ascii_cut(F.col("t")), F.lit(r"[^\x00-\x7f\p{L}\p{N}]"), F.lit(0))
    assert df.filter(~same | (F.size(beyond) > 0)).count() == 0


@pytest.mark.parametrize("how", HOW)
@pytest.mark.parametrize("name,value", [("BLOCK", 20), ("LARGE", 1_500), ("BYTES", 900), ("BLOCK", 0)])
def test_questions_small_and_large(spark, monkeypatch, how, name, value):
    """Some of them, all or none tested by one task."""
    monkeypatch.setattr(redundancy, name, value)
    rng = random.Random(f"{how}{name}")
    groups = {f"g{i}": texts(rng, n) for i, n in enumerate([1, 2, 2, 3, 4, 4, 16, 17, 19, 20, 21, 40, 70])}
    groups["same"] = [" ".join(["w1 w2 w3 w4"] * 9)] * 30 + ["z1 z2"]
    groups["nulls"] = [None, None, "w1 w2"]
    groups["few"] = [None, "xx yy zz " * 9, "xx yy zz " * 9, None]
    rows = [("d", "s", g, t, x) for g, held in groups.items() for t, x in enumerate(held)] + [("d", None, "g1", t, "w1 " * 40) for t in range(3)]
    rng.shuffle(rows)
    got = redundancy.rationale_redundancy(spark.createDataFrame(rows, SCHEMA), 12, how).collect()
    want = {("s", g): (sum(x is not None for x in held), plain.redundant(held, 12, how)) for g, held in groups.items()}
    assert {(r.split, r.id): (r.n_rationales, r.n_redundant) for r in got} == want | {(None, "g1"): (3, 0)}


def test_texts_of_small_questions_are_shuffled_once_and_written_nowhere(spark, monkeypatch):
    written, materialize = {}, redundancy.materialize
    monkeypatch.setattr(redundancy, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    df = spark.createDataFrame([("d", "s", f"{i // 4}", i % 4, f"same words here {i}") for i in range(40)], SCHEMA)
    counts = redundancy.rationale_redundancy(df, 3)
    assert {(r.n_redundant, r.n_questions) for r in redundancy.redundancy_histogram(counts).collect()} == {(3, 10)}
    assert written["rationale-sets"].count() == 0
    shown = redundancy._small_questions(df, 3, "bitand")._jdf.queryExecution().executedPlan().toString()
    assert shown.count("Exchange hashpartitioning") == 1 and shown.count("MapInArrow") == 1 and "regexp_extract_all" not in shown


@pytest.mark.parametrize("how", HOW)
def test_texts_of_small_questions_are_tested_many_at_a_time(monkeypatch, how):
    calls = []
    few_texts = redundancy._few_texts
    monkeypatch.setattr(redundancy, "_few_texts", lambda *a: calls.append(1) or few_texts(*a))
    n, same = 20_000, " ".join(f"w{i}" for i in range(150))
    table = pa.table({
        "dataset": ["d"] * n, "split": ["s"] * n, "id": [f"{i // 4:05d}" for i in range(n)],
        "turn": np.arange(n) % 4, "text": [f"{same} z{i}" if i % 4 != 1 else f"y{i}" for i in range(n)],
    })
    tracemalloc.start()
    got = [redundancy._questions(h, 150, how) for h in redundancy._whole_groups(iter(table.to_batches(3_000)), KEYS, "text")]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = pa.concat_tables(got)
    assert counts.num_rows == n // 4 and set(counts.column("n_redundant").to_pylist()) == {2}
    assert len(calls) <= 16 and peak < 60 * redundancy.BYTES


@pytest.mark.parametrize("block", [redundancy.BLOCK, 8])
def test_a_rationale_without_a_turn_overlaps_nothing(spark, monkeypatch, block):
    monkeypatch.setattr(redundancy, "BLOCK", block)
    same = "one two three four five"
    rows = [("d", "s", f"g{n}", None, same) for n in (2, 30)] + [("d", "s", f"g{n}", t, same if t % 5 == 1 else f"z{t}") for n in (2, 30) for t in range(n)]
    got = redundancy.rationale_redundancy(spark.createDataFrame(rows, SCHEMA), 5).collect()
    assert {r.id: (r.n_rationales, r.n_redundant) for r in got} == {"g2": (3, 0), "g30": (31, 5)}


def test_elements_that_one_side_holds_are_not_multiplied():
    """Two stretches of 200 rationales: neighbours of a side share 250 words, the sides share three."""
    sides = [[f"1:{s}{i // 2}x{k}" for k in range(250)] + [f"{1 << k}:c{k}" for k in range(3) if i % 3 == k] for s in "ab" for i in range(200)]
    sets = redundancy._Sets(pa.array(sides, pa.list_(pa.string())))
    rows, partners = np.arange(200), np.arange(200, 400)
    tracemalloc.start()
    got = sets.overlaps(rows, partners)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.tolist() == [[(1 << i % 3) * (i % 3 == j % 3) for j in range(200)] for i in range(200)]
    assert peak < 16 << 20
    assert sets.overlaps(rows, rows)[0, :3].tolist() == [251, 250, 0]
