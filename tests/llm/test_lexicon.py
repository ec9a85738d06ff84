import hashlib
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from askloop.llm import lexicon

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def odd_texts():
    rng = random.Random(7)
    parts = [*"abc  .!'12\n\t\x00\x0b\x1c\x85\xa0éß漢🙂́ ", "'s", "'re", "'ll", "don't", " 't", "<|endoftext|>", "the ", "\r\n", "aaaa", "<|", "|>"]
    return [
        None, "", " ", "'", "''s", "\n'tis", "x" * 5000, "ab" * 20_000, " " * 3000, "🙂" * 40, "word " * 20_000,
        "<|endoftext|>", "<|endoftext|><|endoftext|> a", " <|endoftext|>  \n<|endoftext|",
        *("".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(400)),
    ]


def test_whole_texts_match_the_library(documents):
    texts = odd_texts()
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, None), (5, texts[5]), (None, "the end")]
    docs = documents(rows)
    got = lexicon.encode(docs, lexicon.build(docs, PATH, size=300), decoded="back").select("doc_id", "text", "ids", "back", "shard").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == library_ids(r.text)
        assert r.back == LIBRARY.decode(r.ids, skip_special_tokens=False)
        assert r.shard == "s"


def test_every_code_point_has_the_library_s_class():
    classes = lexicon.character_classes()
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = random.Random(1)
    for _ in range(40):
        text = "".join(chr(c) + rng.choice("a1! \n") for c in rng.sample(points, 3000))
        data, starts, sizes, _ = lexicon.cut_words([text], classes, [])
        raw = data.tobytes()
        expected = [text[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(text)]
        assert [raw[a : a + k].decode() for a, k in zip(starts, sizes)] == expected


def test_the_automaton_is_minimal_and_numbers_its_words():
    words = sorted({w.encode() for w in ["tap", "taps", "top", "tops", "stop", "stops", "été", "a"]})
    states = lexicon.minimal_states(words)

    def suffixes(s):
        final, arcs = states[s]
        return frozenset(([b""] if final else []) + [bytes([b]) + x for b, to in arcs for x in suffixes(to)])

    assert suffixes(len(states) - 1) == frozenset(words)
    assert len({suffixes(s) for s in range(len(states))}) == len(states)  # no two states are worth the same
    text = b"".join(words) + b"tapX"
    starts = np.cumsum([0, *map(len, words)])
    sizes = np.array([*map(len, words), 4])
    found = lexicon.places(lexicon.transducer(words), np.frombuffer(text, np.uint8), starts, sizes)
    assert found.tolist() == [*range(len(words)), -1]
    assert lexicon.places(lexicon.transducer([]), np.frombuffer(text, np.uint8), starts, sizes).tolist() == [-1] * 9


def test_ids_do_not_depend_on_the_lexicon(documents, tmp_path):
    texts = [t or "" for t in odd_texts()]
    plain = " ".join(texts[20:60]).replace("<|endoftext|>", "")
    for words in ([], [" the", "a", "'s", "aaaa", " word"], [plain[a:b] for _, (a, b) in LIBRARY.pre_tokenizer.pre_tokenize_str(plain)]):
        place = tmp_path / f"{len(words)}.bin"
        place.write_bytes(lexicon.compile_words(PATH, words))
        one = lexicon.Lexicon(str(place))
        ids, bounds = one.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [library_ids(t) for t in texts]


def test_decode_alone(documents, spark):
    rng = random.Random(2)
    lists = [[rng.choice([0, 13, 220, 50256, 300, 127, 128, 187, 162, 60_000, -3, 40_000]) for _ in range(rng.randint(0, 9))] for _ in range(200)]
    table = spark.createDataFrame([(i, x) for i, x in enumerate([*lists, None])], "i int, ids array<int>")
    name = lexicon.build(documents([]), PATH)
    for r in lexicon.decode(table, name).collect():
        known = [i for i in r.ids or [] if 0 <= i < 50_257]
        assert r.decoded == LIBRARY.decode(known, skip_special_tokens=False)


def test_words_are_counted_over_all_texts(documents):
    docs = documents([(1, "the cat, the"), (2, "the cat"), (3, None)])
    counts = {r.word: r.n for r in lexicon.count_words(docs, PATH).collect()}
    assert counts == {" the": 3, " cat": 2, ",": 1}


def test_empty_table(documents):
    docs = documents([])
    assert lexicon.encode(docs, lexicon.build(docs, PATH), decoded="back").count() == 0


def test_digests_of_the_query(spark):
    import __spark_entry__ as contract

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = contract.queries()["op13_lexicon"](spark, sf).select(F.struct("*").alias("x")).collect()
    assert len(got) == len(texts)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for (r,) in got:
        ids = library_ids(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(",".join(map(str, ids))))
        assert r.decoded_sha256 == sha(LIBRARY.decode(ids, skip_special_tokens=False))
