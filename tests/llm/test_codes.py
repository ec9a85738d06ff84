import math
import random

import numpy as np
import pytest

from askloop.llm import codes

ROWS = "vec_id bigint, vector array<float>, label int, code string, error string, _label string"


def plain(rows, parts=8, entries=16, rounds=6):
    """Codes, errors and codebooks of rows (vec_id, vector) of one length, ids different, by trying every entry."""
    whole = sorted((i, [math.floor(4096 * x) for x in v]) for i, v in rows)
    step = len(whole[0][1]) // parts if whole else 0
    cut = lambda v, p: v[p * step : (p + 1) * step]
    books = [[cut(v, p) for _, v in whole[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v in whole:
                groups.setdefault(nearest(cut(v, p), book)[1], []).append(cut(v, p))
            for e, xs in groups.items():
                book[e] = [sum(col) // len(xs) for col in zip(*xs)]
    out = {}
    for i, v in whole:
        found = [nearest(cut(v, p), books[p]) for p in range(parts)]
        out[i] = "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found)
    return out, books


def run(spark, rows):
    table = spark.createDataFrame([(i, v, label, "c", "e", "l") for i, v, label in rows], ROWS)
    return codes.compress(table).collect()


def vectors(n, dim, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in row] for row in rng.normal(0, spread, (n, dim))]


@pytest.mark.parametrize("n,dim", [(120, 16), (9, 8), (1, 24)])
def test_codes_match_trying_every_entry(spark, n, dim):
    rows = [(7 * i % 1000 - 30, v, i % 3 if i % 5 else None) for i, v in enumerate(vectors(n, dim, n))]
    rows += [(5000, None, 1), (5001, [None] * dim, 1), (5002, [math.nan] * dim, 1), (5003, [math.inf] * dim, 1), (5004, [0.5] * (dim + 8), 2)]
    expected, books = plain([(i, v) for i, v, _ in rows[:n]])
    got = run(spark, rows)
    assert {r.vec_id: (r.code, r.error) for r in got} == expected and len(got) == n
    assert {r.codebooks_sha256 for r in got} == {codes.digest([np.array(b) for b in books])}
    total = {}
    for i, _, label in rows[:n]:
        total[label] = total.get(label, 0) + expected[i][1]
    assert all(r.label_error == total[r.label] for r in got)


def test_equal_vectors_ties_and_repeated_ids(spark):
    one = [0.25, -0.25] * 4
    rows = [(3, one, 1)] * 30 + [(4, one, 1), (None, one, None), (9, [-x for x in one], 2)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    assert {r.code for r in got if r.vec_id != 9} == {"00" * 8} and {r.error for r in got} == {0}
    assert {r.code for r in got if r.vec_id == 9} == {"02" * 8}  # the third id


def test_empty_and_unfit_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1), (2, [math.nan], 1)]) == []
    assert run(spark, [(1, [1.0] * 7, 1), (2, [1.0] * 8, 1)]) == []  # seven components are not eight parts
    assert [r.code for r in run(spark, [(1, [], 1), (2, [1.0] * 8, 1)])] == ["00" * 8]
    assert run(spark, [(2, [1e30] * 8, 1)]) == []


def test_masks_keep_every_entry_within_the_radius():
    rng = random.Random(4)
    for size in (1, 2, 16, 64):
        book = np.array([[rng.randint(-9, 9) for _ in range(3)] for _ in range(size)])
        index = codes.Slices(book)
        x = np.array([[rng.randint(-12, 12) for _ in range(3)] for _ in range(200)])
        radius = np.array([rng.randint(0, 12) for _ in x])
        masks = index.candidates(x, radius)
        for row, r, mask in zip(x, radius, masks.tolist()):
            assert [bool(mask >> e & 1) for e in range(size)] == (np.abs(book - row).max(axis=1) <= r).tolist()
        number, apart = index.nearest(x)
        every = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (number == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all()


def test_a_mask_has_no_room_for_more():
    with pytest.raises(ValueError, match="64"):
        codes.Slices(np.zeros((65, 2), np.int64))
