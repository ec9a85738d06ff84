"""The queries over the driver's smallest tables against plain statements, and the pipeline stage by stage."""

import hashlib
import os
import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from brute import base_spans, first_strings, linked, lone_words, shingles
from compare import compare, duck
from test_models import plain_bits

import __spark_entry__ as contract
import corpus_pipeline
from askloop.llm import language, quality, secrets

SF_DIR = "/root/testdata/sf0.001"
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


def sha(value):
    return hashlib.sha256(value if isinstance(value, bytes) else value.encode()).hexdigest()


@pytest.fixture(scope="module")
def texts(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def run(spark, name, *columns):
    return {r[0]: tuple(r[1:]) for r in contract.queries()[name](spark, SF_DIR).select("doc_id", *columns).collect()}


def test_every_operator_has_one_query():
    names = [n for n in contract.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "tokens"]


def test_op2(spark, texts):
    ids = {d: LIBRARY.encode(t or "") for d, t in texts}
    expected = {d: (len(i), sha(",".join(map(str, i))), sha(LIBRARY.decode(i))) for d, i in ids.items()}
    assert run(spark, "op2_sentencepiece", "n_tokens", "ids_sha256", "decoded_sha256") == expected


def test_op3(spark, texts):
    expected = {d: (len((t or "").encode()), *x) for (d, t), x in zip(sorted(texts), first_strings(texts, 50).values())}
    got = run(spark, "op3_suffixes", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == {d: (n, gone, runs, sha(kept)) for d, (n, kept, gone, runs) in expected.items()}


def test_op4(spark, tmp_path):
    """Small texts of invented languages, some held out, against plain context trees of the others."""
    rng = random.Random(6)
    letters = {"xx": "abcd ", "yy": "abef ", "zz": "ghij é"}
    rows = [(i, "".join(rng.choices(letters[lang], k=rng.randint(1, 40))), lang) for i, lang in enumerate(list(letters) * 14)]
    rows += [(100, None, "xx"), (101, "  12 ", "yy"), (102, "abcd abcd", None), (103, rows[0][1], "xx"), (None, "gh ij", "zz")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    held_out = {d: d is not None and zlib.crc32(str(d).encode()) % 3 == 1 for d, _, _ in rows}
    counts = {lang: defaultdict(Counter) for lang in letters}
    for lang, text in {(lang, text) for d, text, lang in rows if text and lang and not held_out[d]}:
        raw = text.encode()
        for i in range(len(raw)):
            for length in range(min(i, language.ORDER) + 1):
                counts[lang][raw[i - length : i]][raw[i]] += 1
    got = contract.queries()["op4_language"](spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.held_out for r in got} == held_out
    found = {r.doc_id: r for r in got}
    for d, text, _ in rows:
        if not any(c.isalpha() for c in text or ""):
            assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
            continue
        raw = text.encode()
        bits = {x: sum(plain_bits(c, raw[max(0, i - language.ORDER) : i + 1]) for i in range(len(raw))) for x, c in counts.items()}
        best = min(sorted(bits), key=bits.get)
        assert found[d].lang_pred == best
        assert found[d].score == pytest.approx(1 / sum(2 ** (bits[best] - b) for b in bits.values()), abs=2e-6)


def test_op5(spark, texts):
    spans = {d: base_spans(t) for d, t in texts}
    counts = {d: tuple(s.count(f"{k}:") for k in ("assign", "access", "hex")) for d, s in spans.items()}
    assert run(spark, "op5_secrets", "n_assign", "n_access", "n_hex", "base_sha256") == {d: (*counts[d], sha(s)) for d, s in spans.items()}


def test_op7(spark, texts):
    assert run(spark, "op7_jaccard", "n_shingles", "component_id") == linked(texts)


@pytest.mark.parametrize("name", ["op8_dualtree", "op11_collocations", "op12_codes"])
def test_sql_twins(spark, name):
    assert compare(spark, duck(SF_DIR), name, contract.queries()[name], contract.oracle_sql()[name], SF_DIR)[0] is None


def test_op9(spark, texts):
    kept = {d: k for (d, _), k in zip(texts, lone_words(texts, 35))}
    got = run(spark, "op9_repeats", "n_words", "n_removed", "kept_sha256")
    assert {d: (n - gone, h) for d, (n, gone, h) in got.items()} == {d: (len(k), sha(" ".join(k))) for d, k in kept.items()}


def test_op10(spark, texts):
    items = [(r.item_id, shingles(r.text)) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    expected = {(d, i) for d, t in texts for i, s in items if s and len(s & shingles(t)) >= 0.8 * len(s)}
    got = contract.queries()["op10_containment"](spark, SF_DIR).select("doc_id", "item_id").collect()
    assert {tuple(r) for r in got} == expected and len(got) == len(expected)


def test_pipeline(spark, texts):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    judged = quality.classify(docs, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    good = {r.doc_id for r in judged.filter("keep").collect()}
    alone = {c for _, c in linked([(d, t) for d, t in texts if d in good]).values()}
    items = [shingles(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    clean = {d for d, t in texts if d in alone and not any(s and len(s & shingles(t)) >= 0.8 * len(s) for s in items)}
    left = secrets.redact(docs.filter(docs.doc_id.isin(sorted(clean))))
    expected = {r.doc_id: LIBRARY.encode(r.text) for r in left.collect()}
    got = {r.doc_id: (r.ids, r.n_tokens) for r in contract.queries()["pipeline"](spark, SF_DIR).collect()}
    assert got == {d: (i, len(i)) for d, i in expected.items()}
    assert 0 < len(got) < len(texts)
