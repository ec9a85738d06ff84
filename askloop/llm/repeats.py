"""Substring dedup by level-wise doubling.

Words are runs of non-blank bytes. A window of ``size`` consecutive words of a document is a repeat if its word sequence
starts anywhere else too, in the same document or another; every word that a repeat covers is removed. All windows are
judged on the input.

Levels have lengths that about double up to ``size`` (9, 18, 35). Every window of the first length is hashed, and only those
that occur more than once survive. A window of the next length is a candidate only where both windows of the length before
that make it up survived, and so on; the last level's survivors are the repeats. Each level is one round of questions: a
shard of documents sends its distinct hashes once, in ranges of values, and learns which other shards have them. So a passage
in a third of all documents costs a range one value for each shard. Levels before the last use 48 bits, as a false survivor
only costs work there; the last uses 96 bits from two independent hashes.

Defined cases: a null or empty text, or one of blanks only, has no words and keeps the empty text; documents shorter than a
window keep all words; a row repeated whole repeats all its windows; rows without an id or with a common id are documents of
their own. Kept words are joined by one space. Other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from askloop.llm.common import ANSWERED, ASKED, Asked, Docs, answer, hasher, ids_array, pack, unpack_docs, widths

SIZE = 35
FIRST = 12
FILTER_BITS = 48
SCHEMA = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("body", pa.binary()), ("tags", pa.binary())])
KEPT = "doc_id bigint, n_words bigint, n_removed bigint, kept string"


def levels(size: int = SIZE, first: int = FIRST) -> list[int]:
    """Window lengths, each at most twice the one before; the first is at most ``first``."""
    out = [size]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


class Shard:
    """The words of a shard's documents, and what the answers so far leave of its windows."""

    def __init__(self, blobs: list[bytes], lengths: list[int], buckets: int):
        self.lengths, self.buckets = lengths, buckets
        self.docs = [unpack_docs(b) for b in blobs]
        self.words = [docs.words() for docs in self.docs]
        counts = np.concatenate([w[3] for w in self.words])
        self.hashes = np.concatenate([w[2] for w in self.words])
        self.limit = np.repeat(np.cumsum(counts), counts)

    def second_hashes(self) -> np.ndarray:
        return np.concatenate([docs.words(seed=11)[2] for docs in self.docs])

    def asked(self, level: int, starts: np.ndarray) -> tuple[Asked, int]:
        size = self.lengths[level]
        numbers = hasher(3).runs(self.hashes, starts, starts + size)
        if level < len(self.lengths) - 1:
            return Asked(numbers >> np.uint64(64 - FILTER_BITS)), FILTER_BITS
        tags = hasher(5).runs(self.second_hashes(), starts, starts + size)
        return Asked(numbers, (tags >> np.uint64(32)).astype(np.uint32)), 64

    def run(self, answers: dict[int, list[tuple[int, bytes]]], until: int):
        """The question of level ``until``, or after the last level where the repeats start."""
        every = np.arange(len(self.hashes))
        starts = every[every + self.lengths[0] <= self.limit]
        for level, size in enumerate(self.lengths):
            asked, bits = self.asked(level, starts)
            if level == until:
                return asked, bits
            left = np.zeros(len(every), bool)
            left[starts[asked.shared(answers.get(level, []), self.buckets, bits)[asked.place]]] = True
            if level == len(self.lengths) - 1:
                return left
            longer = self.lengths[level + 1]
            starts = np.flatnonzero(left)
            starts = starts[starts + longer <= self.limit[starts]]
            starts = starts[left[starts + longer - size]]


def _answers(table: pa.Table) -> dict[int, list[tuple[int, bytes]]]:
    """The answers of every level so far: of earlier ones in the row that went along, of the last one in the others."""
    known, last = {}, []
    for bucket, bits in zip(table.column("bucket").to_pylist(), table.column("bits").to_pylist()):
        if bucket < 0:
            known = pickle.loads(bits)
        else:
            last.append((bucket, bits))
    return {**known, len(known): last} if known or last else {}


def _asked(key: tuple, asked: Asked, bits: int, buckets: int, known: dict) -> pa.Table:
    """The shard's questions, and a row that takes what it knows along to the next step."""
    shard = key[0].as_py()
    along = pa.table({"bucket": [shard % buckets], "shard": [shard], "body": [None], "tags": [pickle.dumps(known)]}, SCHEMA)
    return pa.concat_tables([asked.rows(shard, buckets, bits), along])


def _answered(asked: pa.Table) -> pa.Table:
    known = asked.filter(pa.compute.is_null(asked.column("body")))
    passed = pa.table({"shard": known.column("shard"), "bucket": pa.array([-1] * len(known), pa.int32()), "bits": known.column("tags")})
    questions = asked.filter(pa.compute.is_valid(asked.column("body")))
    return pa.concat_tables([answer(questions), passed]) if len(questions) else passed


def _kept(docs: Docs, words, removed: np.ndarray) -> pa.Table:
    starts, ends, _, counts = words
    keep = ~removed
    mark = np.zeros(len(docs.data) + 1, np.int8)
    mark[starts[keep]] += 1
    mark[ends[keep] + 1] -= 1  # each word with the blank after it
    mask = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    data = docs.data.copy()
    data[ends[keep]] = 32
    kept = data[mask]
    bounds = np.concatenate([[0], np.cumsum(mask)])
    texts = [kept[bounds[a] : max(bounds[a], bounds[b] - 1)].tobytes().decode() for a, b in zip(docs.starts, docs.ends + 1)]
    gone = np.concatenate([[0], np.cumsum(removed)])
    last = np.cumsum(counts)
    return pa.table({
        "doc_id": ids_array(docs.ids), "n_words": pa.array(counts.astype(np.int64)),
        "n_removed": pa.array((gone[last] - gone[last - counts]).astype(np.int64)), "kept": pa.array(texts, pa.string()),
    })


def remove_repeats(docs: DataFrame, size: int = SIZE, first: int = FIRST) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every document without the words that repeats cover."""
    lengths = levels(size, first)
    shards, buckets = widths(docs.sparkSession)
    by_shard = pack(docs, shards).groupBy("shard")

    def shard_of(blobs: pa.Table) -> Shard:
        return Shard(blobs.column("docs").to_pylist(), lengths, buckets)

    def first_question(key: tuple, blobs: pa.Table) -> pa.Table:
        return _asked(key, *shard_of(blobs).run({}, 0), buckets, {})

    def question(level: int):
        def run(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
            known = _answers(answers)
            return _asked(key, *shard_of(blobs).run(known, level), buckets, known)

        return run

    def finish(key: tuple, blobs: pa.Table, answers: pa.Table) -> pa.Table:
        shard = shard_of(blobs)
        starts = np.flatnonzero(shard.run(_answers(answers), len(lengths)))
        step = np.zeros(len(shard.hashes) + 1, np.int64)
        step[starts] += 1
        step[starts + size] -= 1
        removed = np.cumsum(step[:-1]) > 0
        ends = np.cumsum([len(w[0]) for w in shard.words])
        return pa.concat_tables([_kept(d, w, removed[e - len(w[0]) : e]) for d, w, e in zip(shard.docs, shard.words, ends)])

    asked = by_shard.applyInArrow(first_question, ASKED)
    for level in range(1, len(lengths) + 1):
        answers = asked.groupBy("bucket").applyInArrow(_answered, ANSWERED)
        met = by_shard.cogroup(answers.groupBy("shard"))
        asked = met.applyInArrow(question(level), ASKED) if level < len(lengths) else met.applyInArrow(finish, KEPT)
    return asked
