import random
import re

import pyarrow as pa
import pytest
from brute import base_spans, shingles

from askloop.llm import containment, secrets
from askloop.llm.common import docs_of

KEY = "AKIA" + "ABCDEFGH12345678"
HEX = "0123456789abcdef01234567"


def texts():
    rng = random.Random(3)
    parts = [
        'password = "hunter22"', "PassWord:abc", "token:token:abcdef", "api_key='A1b2C3d4E5f6G7h8'", "apikey=x.y-z_/+=", "secret : tiny",
        KEY, "AKIA123", KEY + KEY, HEX, HEX[:23], "x" + HEX + "F", "ünïcode ", "🙂", "token = " + HEX, "ſecret=longs12345", "plain words ",
    ]
    return [None, "", *("".join(rng.choice([" ", "", "\n"]).join(rng.choices(parts, k=rng.randint(1, 9)))) for _ in range(150))]


def test_base_spans(documents):
    rows = [(i, t, "en", f"src{i % 5}") for i, t in enumerate(texts())]
    got = secrets.by_document(documents([*rows, rows[9], rows[9]])).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        expected = base_spans(rows[r.doc_id][1])
        assert r.base == expected
        assert [r.n_assign, r.n_access, r.n_hex] == [expected.count(k) for k in ("assign:", "access:", "hex:")]
        assert {s for s in r.base.split(",") if s} <= set(r.spans.split(","))


def test_ownership_tells_examples_from_live_values(documents):
    copied, own = "Zz9Yy8Xx7Ww6Vv5Uu4Tt3", "Qq1Rr2Ss3Tt4Uu5Vv6Ww7"
    rows = [(i, f"see token = {copied} in the manual", "en", f"src{i}") for i in range(5)]
    rows += [(10, f"token={own}", "en", "src9"), (11, f"run with {own} then {copied}", "en", "src9"), (12, own, None, None)]
    got = {r.doc_id: r for r in secrets.by_document(documents(rows)).collect()}
    assert all(got[i].n_example == 1 and got[i].n_live == 0 for i in range(5))
    assert got[10].n_live == 1
    assert got[11].spans == f"bare:9:{9 + len(own)}" and got[11].base == ""  # the copied value alone is no secret
    assert got[12].n_bare == 1


def test_redaction_hides_what_is_not_an_example(documents):
    rows = [(1, f"a token = {HEX} and {KEY}! ñ"), (2, "nothing here"), (3, None), (4, ""), (1, "other text of the same id")]
    docs = documents(rows)
    cleaned = secrets.redact(docs)
    assert cleaned.columns == docs.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in cleaned.collect() if r.text)
    hidden = f"a {secrets.HIDDEN} and {secrets.HIDDEN}! ñ"
    assert got == [(1, hidden, len(hidden)), (1, "other text of the same id", 25), (2, "nothing here", 12)]
    assert cleaned.count() == 5


def test_many_matches_in_one_text(documents):
    text = " ".join(HEX + f"{i:06x}" for i in range(3_000))
    row = secrets.by_document(documents([(1, text)])).first()
    assert row.n_hex == 3_000 and row.base == base_spans(text)


def test_secrets_of_an_empty_table(documents):
    assert secrets.by_document(documents([])).count() == 0
    assert secrets.redact(documents([])).count() == 0


def leaky(seed=7):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    items = [(i, " ".join(fresh(rng.choice([5, 9, 14, 36, 59])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "just three words"), (93, items[0][1]), (None, items[1][1])]
    docs = []
    for d in range(150):
        text = fresh(rng.choice([3, 30, 400, 5_000]))
        for _ in range(rng.randrange(3)):
            item = items[rng.randrange(40)][1].split()
            if rng.random() < 0.5 and len(item) > 20:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randrange(len(text))
            text[at:at] = [w.upper() if rng.random() < 0.1 else w for w in item]
        docs.append((d, "  \n".join(text)))
    return [*docs, (500, None), (501, ""), (502, "Just three WORDS"), (None, items[2][1])], items


def contained(docs, items):
    sets = [(i, shingles(t)) for i, t in items]
    out = []
    for d, t in docs:
        own = shingles(t)
        out += [(d, i, len(s & own), len(s)) for i, s in sets if s and len(s & own) >= 0.8 * len(s)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16 << 20, 1_000])
def test_containment(spark, documents, block):
    docs, items = leaky()
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, doc_id int")
    got = containment.find(documents(docs), bench, block_bytes=block)
    assert sorted(map(tuple, got.collect()), key=str) == contained(docs, items)


def test_containment_finds_items_that_no_bin_shows(spark, documents, monkeypatch):
    monkeypatch.setattr(containment, "bin_minima", lambda hashes, bits: hashes[:0])
    item = " ".join(f"w{k}" for k in range(13))  # nine shingles
    bench = spark.createDataFrame([(1, item), (2, "another " * 20)], "item_id bigint, text string")
    found = containment.Items([1, 2], [item, " ".join(f"v{k}" for k in range(30))]).contained(docs_of(pa.array([7]), pa.array([f"a b {item[:-3]} c d"])), 0.8)
    assert list(found) == [(0, 0, 8)]
    assert [r.doc_id for r in containment.find(documents([(7, f"a {item} b"), (8, item[:20])]), bench).collect()] == [7]


def test_decontaminate(spark, documents):
    docs, items = leaky()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    bad = {d for d, *_ in contained(docs, items) if d is not None}
    table = documents(docs)
    kept = containment.decontaminate(table, bench)
    assert kept.columns == table.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(d for d, _ in docs if d is not None and d not in bad)
    assert containment.decontaminate(table, bench.limit(0)).count() == len(docs)
    assert containment.decontaminate(documents([]), bench).count() == 0


@pytest.mark.parametrize("block", [16 << 20, 40])
def test_decontaminate_judges_each_row_on_its_own_text(spark, documents, block):
    items = [" ".join(f"{c}{k}" for k in range(9)) for c in "pqr"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    rows = [(1, f"before {items[0]} after"), (1, "clean text of the same id"), (None, f"x {items[1]}"), (None, "clean too"), (2, items[2]), (3, None)]
    kept = containment.decontaminate(documents(rows), bench, block_bytes=block)
    assert sorted((r.doc_id, r.text) for r in kept.filter("doc_id IS NOT NULL").collect()) == [(1, "clean text of the same id"), (3, None)]
    assert [r.text for r in kept.filter("doc_id IS NULL").collect()] == ["clean too"]


def test_sketches_find_items_at_any_size():
    """Recall of the sketches alone against brute force, documents of many sizes."""
    import numpy as np

    rng, hit, tried = np.random.default_rng(1), 0, 0
    for n in (40, 300, 3_000, 30_000):
        for _ in range(40):
            document = rng.integers(0, 1 << 64, n, dtype=np.uint64)
            item = np.unique(np.append(rng.choice(document, 9, replace=False), rng.integers(0, 1 << 64, 2, dtype=np.uint64)))
            own = np.unique(document)
            bits = int(containment.size_class(len(own))) + 1
            hit += bool(set(containment.bin_minima(own, bits).tolist()) & set(containment.bin_minima(item, bits).tolist()))
            tried += 1
    assert hit == tried


def test_patterns_state_the_fixed_kinds():
    assert list(secrets.PATTERNS) == ["assign", "access", "hex", "bare"]
    assert all(re.compile(p) for p in secrets.PATTERNS.values())
