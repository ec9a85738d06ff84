import random

import pytest
from brute import first_strings, linked, lone_words, shingles, words

from askloop.llm import common, jaccard, repeats, suffixes


def corpus(seed, n=60):
    """Texts that share passages, lines and near copies, some of several bytes a character."""
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice(['wor', 'für', 'ñan', 'x'])}{i}" for i in range(400)]
    fresh = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, line = fresh(60), fresh(12)
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "one"), (5, "a b c d")]
    for i in range(6, n):
        text = fresh(rng.randint(1, 120))
        if i % 3 == 0:
            text[rng.randint(0, len(text)) : 0] = passage[rng.randint(0, 20) : rng.randint(40, 60)]
        if i % 4 == 0:
            text = line + text + line
        if i % 7 == 0 and len(rows) > 10:
            text = words(rows[rng.randrange(6, len(rows))][1])[:]
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = "new"
        rows.append((i, rng.choice([" ", "\n", "  "]).join(text)))
    rows += [(n, "ab " * 300), (n + 1, "z" * 400), (n + 2, "y" + "z" * 300)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_strings(documents, seed):
    rows = corpus(seed)
    expected = first_strings(rows, 50)
    got = suffixes.remove_strings(documents(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    for r in got:
        kept, removed, runs = expected[r.doc_id]
        assert (bytes(r.kept), r.n_removed, len(r.starts)) == (kept, removed, runs)
        raw = (dict(rows)[r.doc_id] or "").encode()
        gone = [range(a, b) for a, b in zip(r.starts, r.ends)]
        assert bytes(raw[i] for i in range(len(raw)) if not any(i in g for g in gone)) == kept


def test_string_ids_that_are_shared_or_missing(documents):
    text = "this is one fairly long text that is certainly over fifty bytes in all"
    got = suffixes.remove_strings(documents([(3, text), (3, text), (None, text), (7, text)])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (3, 0), (3, 0), (7, len(text))]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_windows(documents, seed):
    rows = corpus(seed)
    expected = {d: k for (d, _), k in zip(rows, lone_words(rows, 35))}
    got = repeats.remove_repeats(documents(rows)).collect()
    assert len(got) == len(rows) and sum(r.n_removed for r in got) > 0
    for r in got:
        every = words(dict(rows)[r.doc_id])
        assert (r.n_words, r.n_removed, r.kept) == (len(every), len(every) - len(expected[r.doc_id]), " ".join(expected[r.doc_id]))


def test_row_repeated_whole_repeats_itself(documents):
    text = " ".join(f"w{i}" for i in range(40))
    got = repeats.remove_repeats(documents([(1, text), (1, text), (None, "a b")])).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == [(0, 0), (1, 40), (1, 40)]


def test_levels_about_double():
    assert repeats.levels(35) == [9, 18, 35]
    for size in range(1, 200):
        lengths = repeats.levels(size)
        assert lengths[-1] == size and all(a < b <= 2 * a for a, b in zip(lengths, lengths[1:]))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(documents, seed):
    rows = corpus(seed)
    expected = linked(rows)
    got = jaccard.join(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected
    assert any(r.component_id != r.doc_id for r in got)


def test_chain_around_the_threshold(documents):
    """A base and copies that link to it but not to each other, and a chain that only neighbours hold together."""
    base = [f"w{i}" for i in range(200)]
    rows = [(50, " ".join(base))]
    for k in range(8):
        text = base[:]
        text[k * 20] = f"new{k}"
        text[k * 20 + 9] = f"new{k}b"
        rows.append((k, " ".join(text)))
    chain = [f"c{i}" for i in range(400)]
    rows += [(100 + k, " ".join(chain[k * 15 : k * 15 + 250])) for k in range(8)]
    got = jaccard.join(documents(rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows)


def test_ids_that_are_shared_or_missing(documents):
    text = " ".join(f"w{i}" for i in range(30))
    other = " ".join(f"v{i}" for i in range(30))
    got = jaccard.join(documents([(9, text), (9, text), (9, other), (4, other), (None, text)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.n_shingles) for r in got) == [(0, 0, 26), (4, 4, 26), (9, 4, 26), (9, 9, 26), (9, 9, 26)]


def test_keep_one(documents):
    rows = corpus(1)
    expected = {c for _, c in linked(rows).values()}
    docs = documents(rows)
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == expected


@pytest.mark.parametrize("step", [suffixes.remove_strings, repeats.remove_repeats, jaccard.join])
def test_empty_table(documents, step):
    assert step(documents([])).count() == 0


def test_shingles_of_slices_match_plain_words(documents):
    import pyarrow as pa

    rows = corpus(4)
    batch = pa.record_batch({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})
    sizes = {}
    for docs in common.slices(iter([batch]), 500):
        hashes, owner, _ = common.shingles(docs)
        for i, d in enumerate(docs.ids.tolist()):
            sizes[d] = len(set(hashes[owner == i].tolist()))
    assert sizes == {d: len(shingles(t)) for d, t in rows}
