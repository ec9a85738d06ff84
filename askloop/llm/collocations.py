"""Collocations: phrases of two or three words that stand together more often than their parts would, counted without loss.

Texts are written once as blocks of pieces of one language, lower case, with the distinct words of each block and their counts.
Added up over all blocks these give every word's frequency. As no part of a phrase is rarer than the phrase, only words that
reach the least frequency get an id, a dense number over all languages that so names the language too. A block learns the ids of
its words through a join (a row for each distinct word of a block, so a word in every text costs a row a block) and counts its
n-grams, packed as word ids of ``bits`` each, in counting quotient filters: the packed n-gram is permuted invertibly, its first
bits name the bucket that it is sent to, the next ones are its quotient and all others, the first word's id included, its
remainder. A filter keeps a bit for each quotient in use, a bit for each end of a run, the remainders and their counters, in order,
so it is a lossless table of counts. A bucket merges the sorted filters of all blocks, and undoes the permutation for what is
frequent. Lengths of blocks and buckets are parameters: 4 MB and a million entries suit small executors; at 100 TB take blocks of
1 GB and buckets of 256 million entries, as the rows between them number blocks times buckets.

Defined cases: null and empty texts have no words; a null lang is ``und``; row ids and further columns play no part, and repeated
rows count each. A language without frequent phrases has no rows. An empty table gives none. Texts of any length are taken whole;
a long one is spread over blocks at the ends of its pieces.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloop.llm.common import mix, salted_join
from askloop.operators.sampling import number_rows
from askloop.session import materialize

LEAST, TOP, SHARE = 10, 2_000, 50
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NORMAL = bytes(10 if b in PIECE_ENDS else 32 if b == 9 else b for b in range(256))
U64 = np.uint64
SALTS = 32
#: How words and phrases are joined. Both grow with the corpus, and Spark judges them by their files, compressed and before they
#: are repeated for salts, so without it they pass through the driver as broadcasts of a hundred times the size judged.
SHUFFLED = "merge"


# --- Counting quotient filters ----------------------------------------------------------------------------------------


def low_mask(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def permute(high: np.ndarray, low: np.ndarray, width: int) -> np.ndarray:
    """``low``, of ``width`` bits, permuted for each ``high``; ``restore`` undoes it."""
    x = (low ^ mix(high + U64(0x9E3779B97F4A7C15))) & low_mask(width)
    half = U64((width + 1) // 2)
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x * U64(factor)) & low_mask(width)
        x ^= x >> half
    return x


def restore(high: np.ndarray, permuted: np.ndarray, width: int) -> np.ndarray:
    x, half = permuted, U64((width + 1) // 2)
    for factor in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9):
        x = x ^ (x >> half)  # its own inverse, as the shift is at least half of the width
        x = (x * U64(pow(factor, -1, 1 << 64))) & low_mask(width)
    return (x ^ mix(high + U64(0x9E3779B97F4A7C15))) & low_mask(width)


def in_order(high: np.ndarray, low: np.ndarray, counts: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (low, high) in order with their summed counts."""
    order = np.lexsort((high, low))
    high, low = high[order], low[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    first = np.flatnonzero(new)
    if counts is None:
        total = np.diff(np.append(first, len(low)))
    else:
        total = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return high[first], low[first], total


def _bytes_of(values: np.ndarray, bits: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : (bits + 7) // 8].tobytes()


def _values_of(raw: bytes, n: int, bits: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    size = (bits + 7) // 8
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(n, size)
    return wide.view("<u8").ravel().astype(np.uint64)


def to_filter(high: np.ndarray, low: np.ndarray, counts: np.ndarray, width: int, bits: int) -> dict:
    """A filter of distinct sorted entries: ``low`` of ``width`` bits, ``high`` of ``bits``."""
    n = len(low)
    quotient_bits = min(width, max(0, n - 1).bit_length())
    rest = width - quotient_bits
    quotient = (low >> U64(rest)).astype(np.int64)
    used = np.zeros(1 << quotient_bits, bool)
    used[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)[:n]
    body = [
        np.packbits(used).tobytes(), np.packbits(run_end).tobytes(), _bytes_of(low & low_mask(rest), rest), _bytes_of(high, bits),
        np.minimum(counts, 255).astype(np.uint8).tobytes(), counts[counts >= 255].astype(np.int64).tobytes(),
    ]
    return {"n": n, "quotient_bits": quotient_bits, "body": b"".join(body)}


def from_filter(n: int, quotient_bits: int, body: bytes, width: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, counts) in order."""
    rest, at = width - quotient_bits, 0

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return body[at - size : at]

    used = np.flatnonzero(np.unpackbits(np.frombuffer(take(((1 << quotient_bits) + 7) // 8), np.uint8), count=1 << quotient_bits))
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(take((n + 7) // 8), np.uint8), count=n))
    quotient = np.repeat(used, np.diff(ends, prepend=-1)).astype(np.uint64)
    low = _values_of(take(n * ((rest + 7) // 8)), n, rest) | (quotient << U64(rest) if rest < 64 else quotient & U64(0))
    high = _values_of(take(n * ((bits + 7) // 8)), n, bits)
    counts = np.frombuffer(take(n), np.uint8).astype(np.int64)
    counts[counts == 255] = np.frombuffer(body[at:], np.int64)
    return high, low, counts


# --- Blocks and words -------------------------------------------------------------------------------------------------


def to_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(block, lang, body, n, words, counts): pieces of one language, a line each, and the distinct words with their counts."""

    def block(lang: str, lines: list[bytes]) -> pa.RecordBatch:
        body = b"\n".join(lines)
        counts = Counter(body.split())
        return pa.record_batch({
            "block": pa.array([uuid.uuid4().hex], pa.string()), "lang": pa.array([lang], pa.string()),
            "body": pa.array([zstandard.ZstdCompressor(level=1).compress(body)], pa.binary()),
            "n": pa.array([sum(counts.values())], pa.int64()),
            "words": pa.array([[w.decode() for w in counts]], pa.list_(pa.string())),
            "counts": pa.array([list(counts.values())], pa.list_(pa.int64())),
        })

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: Counter[str] = Counter()
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                lang, raw, at = lang.as_py(), (text.as_py() or "").encode().lower().translate(NORMAL), 0
                while at < len(raw):
                    end = len(raw) if len(raw) - at <= block_bytes else raw.find(b"\n", at + block_bytes) + 1 or len(raw)
                    held.setdefault(lang, []).append(raw[at:end])
                    sizes[lang] += end - at
                    at = end
                    full = [lang] if sizes[lang] >= block_bytes else list(held) if sizes.total() >= 4 * block_bytes else []
                    for name in full:
                        yield block(name, held.pop(name))
                        del sizes[name]
        for name, lines in held.items():
            yield block(name, lines)

    narrow = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(made, "block string, lang string, body binary, n bigint, words array<string>, counts array<bigint>")


def number_words(blocks: DataFrame, least: int) -> DataFrame:
    """(id, lang, word, f): every word of a language that occurs ``least`` times there; ids count from 1."""
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    frequent = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
    numbered = number_rows(frequent, [F.desc("f"), "lang", "word"], [])
    return materialize(numbered.select((F.col("row_index") + 1).alias("id"), "lang", "word", "f"), "phrase-words")


def count_phrases(blocks: DataFrame, words: DataFrame, least: int, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(w1, w2, w3, f): word ids of the phrases of two (w3 is 0) and three words that occur ``least`` times."""
    size, total = words.agg(F.max("id")).first()[0] or 0, blocks.agg(F.sum("n")).first()[0] or 0
    bits = max(1, size.bit_length())
    if bits > 32:
        raise ValueError("more than 4 billion frequent words")
    width = 2 * bits
    shift = width - min(width, max(0, 2 * total // bucket_entries).bit_length())  # a bucket is named by the first bits

    asked = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    known = asked.join(words.select("lang", "word", "id").hint(SHUFFLED), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    coded = blocks.select("block", "body", "words").join(known, "block").select("body", "words", F.col("ids.place").alias("places"), F.col("ids.id").alias("ids"))

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                body, names, places, ids = (batch.column(k)[row] for k in range(4))
                names, places = names.as_py(), places.values.to_numpy()
                number = dict(zip([names[p].encode() for p in places], ids.values.to_numpy().tolist()))
                get, run = number.get, []
                for line in zstandard.ZstdDecompressor().decompress(body.as_py()).split(b"\n"):
                    run += [get(w, 0) for w in line.split()]
                    run.append(0)
                yield from _filters(np.array([*run, 0], np.uint64), bits, shift)

    def merged(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [from_filter(r["n"], r["quotient_bits"], r["body"], shift, bits) for r in group.select(["n", "quotient_bits", "body"]).to_pylist()]
        high, low, counts = in_order(*(np.concatenate(x) for x in zip(*parts)))
        often = counts >= least
        high, low, counts = high[often], low[often], counts[often]
        whole = low | (U64(bucket) << U64(shift) if shift < 64 else U64(0))
        pair = restore(high, whole, width)
        return pa.table({"w1": high.astype(np.int64), "w2": (pair >> U64(bits)).astype(np.int64), "w3": (pair & low_mask(bits)).astype(np.int64), "f": counts})

    sent = coded.mapInArrow(filters, "bucket bigint, n int, quotient_bits int, body binary")
    return materialize(sent.groupBy("bucket").applyInArrow(merged, "w1 bigint, w2 bigint, w3 bigint, f bigint"), "phrases")


def _filters(run: np.ndarray, bits: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Filters of the n-grams of one block, a row for each bucket; 0 in ``run`` is a rare word or the end of a piece."""
    one, two, three = run[:-2], run[1:-1], run[2:]
    pairs, triples = (one > 0) & (two > 0), (one > 0) & (two > 0) & (three > 0)
    high = np.concatenate([one[pairs], one[triples]])
    low = np.concatenate([two[pairs] << U64(bits), two[triples] << U64(bits) | three[triples]])
    if not len(high):
        return
    high, low, counts = in_order(high, permute(high, low, 2 * bits), None)
    bucket = low >> U64(shift) if shift < 64 else np.zeros(len(low), np.uint64)
    cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(low))
    low = low & low_mask(shift)
    rows = [to_filter(high[a:b], low[a:b], counts[a:b], shift, bits) for a, b in zip(cuts[:-1], cuts[1:])]
    yield pa.record_batch({
        "bucket": pa.array(bucket[cuts[:-1]].astype(np.int64), pa.int64()), "n": pa.array([r["n"] for r in rows], pa.int32()),
        "quotient_bits": pa.array([r["quotient_bits"] for r in rows], pa.int32()), "body": pa.array([r["body"] for r in rows], pa.binary()),
    })


# --- Scores -----------------------------------------------------------------------------------------------------------


def score(phrases: DataFrame, words: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no longer one stands for."""
    salt = F.xxhash64("w1", "w2", "w3")

    def with_word(rows: DataFrame, column: str, how: str = "inner") -> DataFrame:
        named = words.select(F.col("id").alias("_id"), *[F.col("lang").alias("lang")] * (column == "w1"), F.col("word").alias(f"_{column}"), F.col("f").alias(f"_f_{column}"))
        return salted_join(rows, named.hint(SHUFFLED), [(column, "_id")], salt, how)

    def with_pair(rows: DataFrame, first: str, second: str, pairs: DataFrame, value: str, name: str, how: str = "inner") -> DataFrame:
        named = pairs.select(F.col("w1").alias("_p1"), F.col("w2").alias("_p2"), F.col(value).alias(name))
        return salted_join(rows, named.hint(SHUFFLED), [(first, "_p1"), (second, "_p2")], salt, how)

    def value(left: str, right: str) -> Column:
        return F.expr(f"(cast(1000000 as decimal(38,0)) * f * f) div (cast({left} as decimal(38,0)) * {right})")

    pairs, triples = phrases.filter("w3 = 0"), phrases.filter("w3 > 0")
    longest = (
        triples.select("w1", "w2", "f").union(triples.select("w2", "w3", "f")).groupBy("w1", "w2").agg(F.max("f").alias("most"))
    )
    two = with_pair(pairs, "w1", "w2", longest, "most", "_most", "left").filter(F.col("_most").isNull() | (100 * F.col("_most") < share * F.col("f")))
    two = with_word(with_word(two, "w1"), "w2").select(
        "lang", F.concat_ws(" ", "_w1", "_w2").alias("phrase"), F.col("f").alias("a"), F.col("_f_w1").alias("l"), F.col("_f_w2").alias("r"),
        value("_f_w1", "_f_w2").alias("score"),
    )
    three = with_pair(with_pair(triples, "w2", "w3", pairs, "f", "_rest"), "w1", "w2", pairs, "f", "_first")
    three = with_word(with_word(with_word(three, "w1"), "w2"), "w3")
    three = three.withColumns({"_one": value("_f_w1", "_rest"), "_two": value("_first", "_f_w3")})
    lower = F.col("_two") < F.col("_one")
    three = three.select(
        "lang", F.concat_ws(" ", "_w1", "_w2", "_w3").alias("phrase"), F.col("f").alias("a"),
        F.when(lower, F.col("_first")).otherwise(F.col("_f_w1")).alias("l"), F.when(lower, F.col("_f_w3")).otherwise(F.col("_rest")).alias("r"),
        F.when(lower, F.col("_two")).otherwise(F.col("_one")).alias("score"),
    )
    return two.unionByName(three)


def best(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language with their ``rank``; each of ``SALTS`` shares of a language is cut first."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    share = Window.partitionBy("lang", "_salt").orderBy(*order)
    some = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).withColumn("rank", F.row_number().over(share)).filter(F.col("rank") <= top)
    whole = Window.partitionBy("lang").orderBy(*order)
    return some.withColumn("rank", F.row_number().over(whole).cast("bigint")).filter(F.col("rank") <= top).drop("_salt")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, block_bytes: int = BLOCK_BYTES, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language; n is its number of words."""
    blocks = materialize(to_blocks(docs, block_bytes), "phrase-blocks")
    words = number_words(blocks, least)
    phrases = count_phrases(blocks, words, least, bucket_entries)
    sizes = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best(score(phrases, words, share), top).join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
