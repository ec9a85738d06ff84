import random
import re
from collections import Counter

import numpy as np
import pytest

from askloop.llm import collocations

A_Z = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(rows, least=10, top=2000, share=50):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(A_Z)):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    often = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    longer = Counter()
    for (lang, w), a in often.items():
        if len(w) == 3:
            for part in (w[:2], w[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    scored = {}
    for (lang, w), a in often.items():
        if 100 * longer[lang, w] < share * a:
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            s, k = min(cuts)
            scored.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {
        (lang, i): (phrase.decode(), -a, left, right, n[lang], -s)
        for lang, found in scored.items() for i, (s, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    }


def mined(documents, rows, **settings):
    got = collocations.mine(documents(rows), **settings).collect()
    found = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got}
    assert len(found) == len(got)
    return found


def sentences(n, seed, vocabulary, langs=("en", "de", None)):
    rng = random.Random(seed)
    marks = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b", " \x1c", "\x00 "]
    made = []
    for i in range(n):
        words = [rng.choice(vocabulary[: rng.randint(2, len(vocabulary))]) for _ in range(rng.randint(0, 60))]
        made.append((i, "".join(w + rng.choice(marks) for w in words), rng.choice(langs)))
    return made


WORDS = ["the", "The", "of", "New", "york", "is", "é", "É", "漢", "a\x00b", "x-y", "ı", "big", "\xa0", "city"]


@pytest.mark.parametrize("settings", [{}, {"least": 3, "top": 5}, {"least": 2, "share": 80, "block_bytes": 60, "bucket_entries": 16}])
def test_phrases_match_plain_counts(documents, settings):
    rows = [*sentences(150, 3, WORDS), (None, None, "en"), (1, "", "fr"), (2, "New York " * 400, "en"), (3, "q " * 3000, "es"), *[(7, "so it goes, so it goes", "en")] * 30]
    own = {k: v for k, v in settings.items() if k in ("least", "top", "share")}
    expected = plain(rows, **own)
    assert mined(documents, rows, **settings) == expected and len(expected) >= (10 if settings.get("top") else 40)


def test_und_is_one_language_and_rare_words_count_only_in_n(documents):
    rows = [(i, f"red fox jumps rare{i}", None if i % 2 else "und") for i in range(20)]
    got = mined(documents, rows)
    assert got == plain(rows) and {k[0] for k in got} == {"und"}
    assert next(iter(got.values()))[4] == 80


def test_nothing_frequent(documents):
    assert mined(documents, []) == {}
    assert mined(documents, [(1, None, None), (2, "a b c", "en")]) == {}


def test_words_and_phrases_are_never_broadcast(documents, monkeypatch):
    rows, frames, write = sentences(150, 3, WORDS), [], collocations.materialize
    monkeypatch.setattr(collocations, "materialize", lambda df, name: frames.append(df) or write(df, name))
    frames.append(collocations.mine(documents(rows)))
    assert len(frames) == 4
    broadcast, merged = set(), 0
    for df in frames[1:]:
        df.collect()  # joins may turn into broadcasts while they run
        plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
        assert "isFinalPlan=true" in plan
        plan = plan.split("== Initial Plan ==")[0]
        broadcast |= set(re.findall(r"BroadcastHashJoin \[(.*?)\], \[", plan))
        merged += len(re.findall("SortMergeJoin.*(?:lang, word|pmod)", plan))
    assert broadcast <= {"_part", "lang", "block"}  # a row for each partition, language or block
    assert merged == 9  # a join by each word of two or three, by three pairs, and of a block's words


def test_scores_broadcast_nothing_however_small_spark_takes_the_tables(spark):
    words = spark.createDataFrame([(1, "en", "new", 30), (2, "en", "york", 20), (3, "en", "city", 20)], "id bigint, lang string, word string, f bigint")
    phrases = spark.createDataFrame([(1, 2, 0, 20), (2, 3, 0, 12), (1, 2, 3, 12)], "w1 bigint, w2 bigint, w3 bigint, f bigint")
    setting = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1g")
    try:
        scored = collocations.score(phrases, words)
        got = {tuple(r) for r in scored.collect()}
        plan = scored._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(setting, before)
    assert got == {("en", "new york city", 12, 20, 20, 360_000)}
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("bits", [1, 5, 16, 21, 32])
def test_permuted_phrases_come_back_and_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    high = rng.integers(0, 1 << bits, 3000, dtype=np.uint64)
    low = rng.integers(0, 1 << (2 * bits), 3000, dtype=np.uint64, endpoint=False) if bits < 32 else rng.integers(0, 1 << 64, 3000, dtype=np.uint64)
    mixed = collocations.permute(high, low, 2 * bits)
    assert (collocations.restore(high, mixed, 2 * bits) == low).all()
    counts = rng.choice([1, 2, 254, 255, 256, 10**12], 3000)
    h, m, c = collocations.in_order(high, mixed, counts)
    assert c.sum() == counts.sum()
    packed = collocations.to_filter(h, m, c, 2 * bits, bits)
    back = collocations.from_filter(packed["n"], packed["quotient_bits"], packed["body"], 2 * bits, bits)
    assert all((x == y).all() for x, y in zip(back, (h, m, c)))


def test_filters_of_shards_add_up():
    rng = np.random.default_rng(8)
    high, low = rng.integers(0, 8, 4000, dtype=np.uint64), rng.integers(0, 64, 4000, dtype=np.uint64)
    whole = collocations.in_order(high, low, None)
    parts = [collocations.in_order(high[i::3], low[i::3], None) for i in range(3)]
    back = [collocations.from_filter(f["n"], f["quotient_bits"], f["body"], 6, 3) for f in (collocations.to_filter(*p, 6, 3) for p in parts)]
    assert all((a == b).all() for a, b in zip(collocations.in_order(*(np.concatenate(x) for x in zip(*back))), whole))
