import random

import numpy as np
import plain
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloop.operators import redundancy

SCHEMA = "dataset string, split string, id string, turn int, answer string, rationale string"


def texts(rng, n, words, longest):
    vocabulary = [f"w{i}" for i in range(words)] + ["the", "of", "a", "I", "Über"]
    return [
        None if rng.random() < 0.05 else " ".join(rng.choices(vocabulary, k=rng.randrange(longest))) for _ in range(n)
    ]


def table(spark, groups):
    rows = [("d", "s", g, t, "x", text) for g, held in groups.items() for t, text in enumerate(held)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("threshold,how", [(1, "bitand"), (5, "bitand"), (20, "bitand"), (8, "min"), (20, "min")])
def test_rationales_against_brute_force(spark, threshold, how):
    rng = random.Random(threshold)
    groups = {f"g{i}": texts(rng, rng.randrange(1, 9), 12 + i % 30, 60) for i in range(60)}
    # Near copies, exact copies, one word many times, and a later unrelated text.
    base = " ".join(f"v{i}" for i in range(40))
    groups["near"] = [f"{base} extra{i}" for i in range(40)] + ["short", "another one here"]
    groups["same"] = [base] * 30 + ["z1 z2"]
    groups["bits"] = ["ww " * k for k in range(1, 40)]
    groups["none"] = [None, None]
    got = redundancy.rationale_redundancy(table(spark, groups), threshold, how).collect()
    assert {r.id: (r.n_rationales, r.n_redundant) for r in got} == {
        g: (sum(t is not None for t in held), plain.redundant(held, threshold, how)) for g, held in groups.items()
    }


def test_a_question_with_a_third_of_all_rows(spark):
    rng = random.Random(11)
    groups = {f"g{i}": texts(rng, 4, 200, 40) for i in range(150)}
    groups["hot"] = texts(rng, 300, 400, 60)
    got = redundancy.rationale_redundancy(table(spark, groups), 12).collect()
    want = {g: plain.redundant(held, 12) for g, held in groups.items()}
    assert {r.id: r.n_redundant for r in got} == want
    assert 0 < want["hot"] < 300


def test_counts_combine_by_bits_or_minimum(spark):
    groups = {"a": ["xx xx xx", "xx"], "b": ["xx xx", "xx"]}
    assert {r.id: r.n_redundant for r in redundancy.rationale_redundancy(table(spark, groups), 1).collect()} == {"a": 1, "b": 0}
    smaller = redundancy.rationale_redundancy(table(spark, groups), 1, "min")
    assert {r.id: r.n_redundant for r in smaller.collect()} == {"a": 1, "b": 1}


def test_answers(spark):
    rows = [("d", "s", "a", t, a, None) for t, a in enumerate(["x", "x", "y", None, None, "z", "z", "z"])] + [("e", "s", "a", 0, "x", None)]
    counts = redundancy.answer_redundancy(spark.createDataFrame(rows, SCHEMA))
    assert {(r.dataset, r.n_rows, r.n_redundant) for r in counts.collect()} == {("d", 8, 5), ("e", 1, 0)}
    assert {(r.n_redundant, r.n_questions) for r in redundancy.redundancy_histogram(counts).collect()} == {(5, 1), (0, 1)}
    share = redundancy.redundancy_share(counts, "n_rows").first()
    assert share.percent == pytest.approx(500 / 9)
    empty = redundancy.redundancy_share(counts.filter(F.lit(False)), "n_rows").first()
    assert empty.percent == 0


def test_a_question_costs_a_row_for_each_block(spark):
    """30 of 100 words at random: nearly all pairs share prefix words and none overlaps by 20."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(100)]
    held = [" ".join(rng.sample(words, 30)) for _ in range(1_000)]
    vectors = redundancy._distinct_vectors(table(spark, {"hot": held}), 20, "bitand")
    assert redundancy._meetings(vectors, redundancy.BLOCK).count() == 1_000
    assert redundancy._meetings(vectors, 100).count() == 1_000 * 10
    found = {r.last for r in redundancy._overlapped(vectors, 20).collect()}
    assert found == {r.last for r in redundancy._overlapped(vectors, 20, block=150).collect()}
    assert len(found) == plain.redundant(held, 20)


@pytest.mark.parametrize("cells", [1 << 23, 600])
def test_bounds_and_stretches_lose_nothing(monkeypatch, cells):
    monkeypatch.setattr(redundancy, "STRETCH", 7)
    monkeypatch.setattr(redundancy, "CELLS", cells)
    rng = random.Random(cells)
    for _ in range(60):
        n, threshold = rng.randrange(1, 60), rng.randrange(1, 40)
        rows = [sorted({f"{1 << rng.randrange(4)}:w{int(rng.paretovariate(0.4)) % 90}" for _ in range(rng.randrange(30))}) for _ in range(n)]
        last, own = np.array(rng.sample(range(1000), n)), np.array([rng.randrange(2) for _ in range(n)])
        one_block = own.min() == own.max()

        def weight(a, b):
            return sum(int(e.split(":")[0]) for e in set(rows[a]) & set(rows[b]))

        want = [any(last[j] > last[i] and (one_block or own[i] != own[j]) and weight(i, j) >= threshold for j in range(n)) for i in range(n)]
        assert redundancy._found(last, own, pa.array(rows, pa.list_(pa.string())), threshold).tolist() == want


def test_near_copies_after_which_unrelated_texts_follow(spark):
    """Copies that no block offer settles: the last rows of the question share nothing with them."""
    rng = random.Random(5)
    base = [f"c{i}" for i in range(60)]
    held = [" ".join(rng.sample(base, 57)) for _ in range(200)]
    held += [" ".join(f"u{k}x{i}" for i in range(80)) for k in range(100)]
    got = redundancy.rationale_redundancy(table(spark, {"hot": held}), 40).first()
    assert got.n_redundant == plain.redundant(held, 40) == 199
