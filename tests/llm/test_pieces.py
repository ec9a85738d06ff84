import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from askloop.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def odd_texts():
    rng = random.Random(5)
    letters = list("abc eé▁\n\t\x00漢🙂ñ  .the ing er\u200d")
    return [
        None, "", " ", "▁", "\n", "  a  b", "x" * 5000, " " * 700, "🙂" * 40, "word " * 20_000,
        *("".join(rng.choices(letters, k=rng.randint(0, 80))) for _ in range(300)),
    ]


def test_whole_texts_match_the_library(documents):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (5, texts[5]), (None, "the end")]
    got = pieces.encode(documents(rows), PATH, decoded="back").select("doc_id", "text", "ids", "back", "shard").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == LIBRARY.encode(r.text or "")
        assert r.back == LIBRARY.decode(r.ids)
        assert r.shard == "s"


def test_decode_alone(spark):
    rng = random.Random(2)
    lists = [[rng.choice([0, 1, 2, 3, 13, 130, 200, 226, 225, 244, 259, 28705, 300, 29000]) for _ in range(rng.randint(0, 9))] for _ in range(300)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, ids array<int>")
    for r in pieces.decode(table, PATH).collect():
        assert r.decoded == LIBRARY.decode(r.ids or [])


def test_empty_table(documents):
    assert pieces.encode(documents([]), PATH, decoded="back").count() == 0


def test_unknown_id_is_an_error(spark):
    with pytest.raises(Exception, match="IndexError|index out of range"):
        pieces.decode(spark.createDataFrame([([40_000],)], "ids array<int>"), PATH).agg(F.max("decoded")).collect()


def test_cache_turnover_keeps_ids(monkeypatch):
    monkeypatch.setattr(pieces, "CACHED_CUTS", 10)
    vocabulary = pieces.Pieces(PATH)
    texts = [f"word{i} again{i % 7} Ωmega{i}" for i in range(200)]
    for at in range(0, 200, 20):
        for text, ids in zip(texts[at : at + 20], vocabulary.encode(texts[at : at + 20])):
            assert [int.from_bytes(ids[k : k + 4], "little") for k in range(0, len(ids), 4)] == LIBRARY.encode(text)
