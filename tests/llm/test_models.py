import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from askloop.llm import common, dualtree, language, quality, toxicity

LETTERS = {"aa": "abcdefg ", "bb": "hijklmn ", "cc": "opqrstu "}


def text_of(lang, rng, n):
    return "".join(rng.choices(LETTERS[lang], k=n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(1)
    return [(i, text_of(lang, rng, rng.randint(20, 300)), lang) for i, lang in enumerate(list(LETTERS) * 20)]


def test_language(documents, spoken):
    model = language.train(documents([*spoken, (900, None, "aa"), (901, "abc", None), (902, "", "zz")]))
    assert [name for name, _, _ in model] == ["aa", "bb", "cc"]
    rng = random.Random(2)
    asked = [(i, text_of(lang, rng, 60), lang) for i, lang in enumerate(LETTERS)]
    odd = [(50, None), (51, ""), (52, "123 !?"), (None, asked[0][1]), (0, asked[0][1]), (53, "abc" * 50_000)]
    got = language.predict(documents([*asked, *odd]), model).collect()
    found = defaultdict(list)
    for r in got:
        assert 0 <= r.score <= 1
        found[r.doc_id].append((r.lang_pred, r.score))
    assert [found[i][0][0] for i in range(3)] == ["aa", "bb", "cc"] and found[0][0] == found[0][1]
    assert all(found[i] == [("und", 0.0)] for i in (50, 51, 52))
    assert found[None][0][0] == "aa" and found[53][0][0] == "aa"


def test_every_language_is_learned_from_a_small_sample(documents):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(f"{chr(0x3B1 + i)}{chr(0x430 + i)} x", k=5_000)), f"l{i:02d}") for i in range(20)]
    rows += [(100 + i, rows[0][1], "l00") for i in range(50)]  # copies
    rows += [(200, "q", "short"), (201, "ω " * 400_000, "long")]
    model = language.train(documents(rows), sample_bytes=1_200)
    assert [name for name, _, _ in model] == sorted({lang for _, _, lang in rows})
    read = {name: int(counts[grams >> np.uint64(56) == 1].sum()) for name, grams, counts in model}
    assert all(n < 12_000 for n in read.values()) and read["short"] == 1
    got = {r.doc_id: r.lang_pred for r in language.predict(documents([(i, t[:300], "?") for i, t, _ in rows[:20]]), model).collect()}
    assert got == {i: f"l{i:02d}" for i in range(20)}


def test_equal_pieces_count_once(documents):
    rows = [(i, "abc abd", "aa") for i in range(30)] + [(99, "abx", "aa")]
    (_, grams, counts), = language.train(documents(rows))
    one = {int(g) & 0xFF: int(n) for g, n in zip(grams, counts) if int(g) >> 56 == 1}
    assert one == Counter(b"abc abdabx")


def test_pieces_are_whole_characters():
    raw = ("aé漢🙂" * 400).encode()
    parts = list(language.pieces_of(raw, 7))
    assert b"".join(parts) == raw and all(p.decode() for p in parts) and max(map(len, parts)) <= 10


def test_language_without_training(documents):
    model = language.train(documents([]))
    assert model == []
    assert language.predict(documents([(1, "text")]), model).collect()[0][1:] == ("und", 0.0)


def plain_bits(counts, gram):
    """Method C with exclusion, by the book, for the last byte of ``gram``."""
    ruled_out, bits = set(), 0.0
    for length in range(len(gram) - 1, -1, -1):
        context = gram[len(gram) - 1 - length : -1]
        seen = {s: n for s, n in counts.get(context, {}).items() if s not in ruled_out}
        if seen:
            total = sum(seen.values()) + len(seen)
            if gram[-1] in seen:
                return bits + math.log2(total / seen[gram[-1]])
            bits += math.log2(total / len(seen))
        ruled_out |= set(counts.get(context, {}))
    return bits + math.log2(256 - len(ruled_out))


def test_code_lengths_match_a_plain_context_tree():
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdé ", k=rng.randint(0, 90))) for _ in range(20)]
    docs = common.docs_of(pa.array(range(len(texts)), pa.int64()), pa.array(texts))
    counts, codes = defaultdict(Counter), Counter()
    for t in texts:
        raw = t.encode()
        for i in range(len(raw)):
            for length in range(min(i, language.ORDER) + 1):
                counts[raw[i - length : i]][raw[i]] += 1
    full = language.grams(docs, language.ORDER + 1)[language._inside(docs)]
    for length in range(1, language.ORDER + 2):
        codes.update(language.shorten(full[language.length_of(full) >= length], length).tolist())
    keys = np.array(list(codes), np.uint64)
    scorer = language.Scorer([("xx", keys, np.array([codes[k] for k in keys.tolist()]))])
    asked = ["abcd", "", "zz top", "aé", *texts[:3]]
    got = scorer.lengths(common.docs_of(pa.array(range(len(asked)), pa.int64()), pa.array(asked)))[:, 0]
    for text, bits in zip(asked, got):
        raw = text.encode()
        expected = sum(plain_bits(counts, raw[max(0, i - language.ORDER) : i + 1]) for i in range(len(raw)))
        assert bits == pytest.approx(expected, abs=1e-6)


def plain_kneser_ney(texts, order):
    """Gram -> probability of its last byte, from the definition."""
    counts = {order: Counter()}
    for t in texts:
        raw = b"\n" * (order - 1) + t.encode()
        counts[order].update(raw[i : i + order] for i in range(len(raw) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])

    def discount(k):
        n = Counter(counts[k].values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        out = []
        for i, plain in ((1, 0.5), (2, 1.0), (3, 1.5)):
            raw = i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else 0
            out.append(raw if raw > 0 else plain)
        return out

    discounts = {k: discount(k) for k in counts}

    def p(gram):
        k = len(gram)
        if k == 0:
            return 1 / 256
        own = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        cut = {g: min(discounts[k][min(n, 3) - 1], n) for g, n in own.items()}
        total = sum(own.values())
        return (own.get(gram, 0) - cut.get(gram, 0) + sum(cut.values()) * p(gram[1:])) / total

    return p


def test_perplexity_matches_the_definition(spark, documents):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices("abcé d", k=rng.randint(1, 60))), "xx") for i in range(25)]
    rows += [(50, None, "xx"), (51, "", "xx"), (52, "zq zq", None), (3, rows[3][1], "xx"), (None, "abab", "xx")]
    labels = spark.createDataFrame([(i, int(i < 12), 0) for i in range(20)] + [(None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    trusted = [t for d, t, _ in rows if d is not None and d < 12]
    p = plain_kneser_ney(trusted, quality.ORDER)
    got = quality.classify(documents(rows), labels).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t, _ in rows}
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        if not raw:
            assert r.perplexity is None and not r.keep
            continue
        padded = b"\n" * (quality.ORDER - 1) + raw
        bits = -sum(math.log2(p(padded[i : i + quality.ORDER])) for i in range(len(raw)))
        assert r.perplexity == pytest.approx(2 ** (bits / len(raw)), rel=1e-5)
        assert r.keep == (r.threshold is None or r.score <= r.threshold)
    assert [r.keep for r in got if r.doc_id == 52] == [True]


def test_quality_rejects_text_unlike_the_trusted(spark, documents):
    rng = random.Random(3)
    good = [(i, " ".join(rng.choices(["the", "cat", "sat", "on", "a", "mat"], k=80)), "en") for i in range(60)]
    bad = [(100 + i, "".join(rng.choices("#$%&*ZQXJ", k=200)), "en") for i in range(5)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id bigint, quality int, toxic int")
    docs = documents([*good, *bad])
    assert {r.doc_id for r in quality.keep_good(docs, labels).collect()} == {i for i, *_ in good}
    assert quality.keep_good(docs, labels.limit(0)).count() == 65
    assert quality.keep_good(documents([]), labels).count() == 0


def test_quality_threshold_is_the_quantile_of_held_out_trusted_text(spark, documents):
    rng = random.Random(4)
    texts = {i: "".join(rng.choices("abcé d", weights=rng.choices([1, 5], k=6), k=rng.randint(40, 90))) for i in range(30)}
    rows = [(i, t, "xx") for i, t in texts.items()] + [(40, texts[0], "xx")]
    labels = spark.createDataFrame([(i, int(i < 16 or i == 40), 0) for i in [*range(30), 40]], "doc_id bigint, quality int, toxic int")
    texts[40] = texts[0]
    half = {i: zlib.crc32(t.encode()) % 2 for i, t in texts.items() if i < 16 or i == 40}
    assert set(half.values()) == {0, 1}
    models = [plain_kneser_ney([texts[i] for i in half if h is None or half[i] != h], quality.ORDER) for h in (0, 1, None)]

    def bits(i):
        raw = texts[i].encode()
        padded = b"\n" * (quality.ORDER - 1) + raw
        return -sum(math.log2(models[half.get(i, 2)](padded[k : k + quality.ORDER])) for k in range(len(raw))), len(raw)

    median = sorted(b / n for b, n in map(bits, half))[(len(half) - 1) // 2]
    score = {i: (b + quality.PRIOR_BYTES * median) / (n + quality.PRIOR_BYTES) for i, (b, n) in ((i, bits(i)) for i in texts)}
    for r in quality.classify(documents(rows), labels).collect():
        assert r.score == pytest.approx(score[r.doc_id], rel=1e-5)
        assert r.threshold == pytest.approx(max(score[i] for i in half), rel=1e-5)


def test_toxicity_on_held_out_rows(spark, documents):
    rng = random.Random(8)
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(400):
        text, junk, toxic = rng.choices(plain, k=rng.randint(20, 120)), rng.random() < 0.3, rng.random() < 0.3
        for at in range(3 if toxic else 0):
            text[at * 5] = rng.choice(["Idiot,", "moron", "scum!"])
        if junk:
            text = [t + "***" for t in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(toxic)))
    table = spark.createDataFrame([*labels[:300], (5, None, None), (None, 1, 1), (9_999, 1, 1)], "doc_id bigint, quality int, toxic int")
    odd = [(700, None), (701, ""), (None, "Idiot moron scum")]
    got = {r.doc_id: r for r in toxicity.classify(documents([*rows, *odd]), table).collect()}
    held = labels[300:]
    assert sum(got[i].toxic == bool(t) for i, _, t in held) >= 97
    assert sum(got[i].junk == (not q) for i, q, _ in held) >= 97
    assert not got[700].toxic and not got[701].toxic and got[None].toxic
    assert all(0 <= r.p_toxic <= 1 for r in got.values())


def test_a_toxic_passage_in_a_very_long_clean_text(spark, documents):
    rng = random.Random(4)
    plain = [f"{rng.choice('bdfgk')}{''.join(rng.choices('aeioulmnrst', k=rng.randint(2, 9)))}" for _ in range(3_000)]
    rows, labels = [], []
    for i in range(300):
        text, toxic = rng.choices(plain, k=rng.randint(20, 120)), i % 3 == 0
        for at in range(2 if toxic else 0):
            text[at * 5] = rng.choice(["idiot", "moron", "scum"])
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    clean = [" ".join(rng.choices(plain, k=100_000)) for _ in range(2)]
    passage = clean[0][:400_000] + " you idiot moron, pathetic scum, idiot scum moron " + clean[0][400_000:]
    table = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.classify(documents([*rows, (900, passage), (901, clean[0]), (902, clean[1])]), table).collect()}
    assert got[900] and not got[901] and not got[902]


def test_the_solver_finds_the_optimum_of_spark_ml(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(3)
    x = rng.random((120, 8)) * (rng.random((120, 8)) < 0.5)
    y = (x @ np.array([3, -2, 0, 0, 1.5, 0, 0, 0]) + rng.normal(0, 0.5, 120) > 0.4).astype(float)
    table = spark.createDataFrame([(float(b), Vectors.dense(a)) for a, b in zip(x.tolist(), y)], ["label", "features"])
    best = LogisticRegression(regParam=0.02, elasticNetParam=1.0, standardization=False, maxIter=500, tol=1e-10).fit(table)
    row, column = np.nonzero(x)
    weights, intercept = toxicity.solve(row, column, x[row, column], y, 8, 0.02, 5_000, 1e-9)
    assert weights == pytest.approx(best.coefficients.toArray(), abs=2e-3) and intercept == pytest.approx(best.intercept, abs=2e-3)
    assert (weights == 0).any()


def test_toxicity_of_empty_tables(spark, documents):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.classify(documents([]), labels).count() == 0
    got = toxicity.classify(documents([(1, "same text"), (3, None)]), labels.filter("doc_id = 1")).collect()
    assert [tuple(r) for r in sorted(got)] == [(1, 0.0, 0.0, False, False), (3, 0.0, 0.0, False, False)]


def test_toxicity_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [tuple(r) for r in toxicity.classify(documents([(1, "text")]), none).collect()] == [(1, 0.0, 0.0, False, False)]


def plain_top(rows, k):
    whole = {(i, tuple(math.floor(256 * x) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, v in whole:
        if i % 3 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [8_192, 16])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(dualtree, "BLOCK_ROWS", block)
    monkeypatch.setattr(dualtree, "QUERY_ROWS", max(4, block // 8))
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(150)]
    rows += [(200 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]  # a large group of equal vectors
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (303, [math.nan, 0.0, 0.0, 0.0]), (306, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(309, [1.0, 2.0]), (310, [0.5, 1.0]), (3, rows[3][1]), (None, [1.0, 1.0, 1.0, 1.0]), (312, [9.0, 9.0, 9.0, 9.0]), (312, [-9.0, 1.0, 1.0, 1.0])]
    table = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<double>, score int")
    got = dualtree.top_k(table, F.col("vec_id") % 3 == 0, k=5)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5)


def test_top_k_of_little(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert dualtree.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 3 == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in dualtree.top_k(two, F.col("vec_id") % 3 == 0).collect()] == [(0, 1, 1, 256 * 512)]
