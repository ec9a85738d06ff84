"""What several operators of this folder share: words, hashes and documents packed into shards.

A *shard* is a set of documents chosen by a hash of doc_id. Documents travel once, compressed, to their shard; a shard's
task asks questions about its distinct hashes (``ask``), which are dealt out by value to buckets, and gets one bit back for
each hash (``answer``). Every shard sends a value once however often it holds it, so a value that fills a third of all rows
costs a bucket one entry for each shard.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACK_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
NO_ID = np.iinfo(np.int64).min
U64 = np.uint64
#: Bytes that separate words.
BLANKS = bytes([32, *range(9, 14)])
IS_WORD = np.ones(256, bool)
IS_WORD[list(BLANKS)] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MASK = (1 << 64) - 1


def widths(spark: SparkSession) -> tuple[int, int]:
    """Shards and buckets of a step: twice and half the session's shuffle partitions, so a round has their square of rows."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return 2 * partitions, max(1, partitions // 2)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (a public finalizer)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Hasher:
    """Hashes of runs from running sums: equal runs have equal hashes wherever they stand."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.factor = int(rng.integers(0, 1 << 61, dtype=np.uint64)) * 8 + 3
        self.up = self.down = np.ones(1, np.uint64)

    def powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = np.full(size, self.factor & MASK, np.uint64), np.full(size, pow(self.factor, -1, 1 << 64), np.uint64)
            self.up[0] = self.down[0] = 1
            np.multiply.accumulate(self.up, out=self.up)
            np.multiply.accumulate(self.down, out=self.down)
        return self.up[:n], self.down[:n]

    def runs(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of values[start:end] for each pair."""
        up, down = self.powers(len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:-1], out=sums[1:])
        return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def windows(self, values: np.ndarray, size: int) -> np.ndarray:
        """Hash of every window of ``size`` values, by its start."""
        starts = np.arange(max(0, len(values) - size + 1))
        return self.runs(values, starts, starts + size)


@lru_cache(maxsize=8)
def hasher(seed: int) -> Hasher:
    return Hasher(seed)


class Docs:
    """Some documents in one byte array, each followed by a blank."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.sizes, self.data = ids, sizes, data
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes

    def __len__(self):
        return len(self.ids)

    def text(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def words(self, lower: bool = False, seed: int = 1):
        """Start, end and hash of each word, and the number of words of each document."""
        parts, at = [], 0
        while at < len(self.data):  # pieces of about a megabyte that end at a blank
            end = min(at + PIECE_BYTES, len(self.data))
            while end < len(self.data) and IS_WORD[self.data[end - 1]]:
                more = np.flatnonzero(~IS_WORD[self.data[end : end + PIECE_BYTES]])
                end = end + int(more[0]) + 1 if len(more) else min(end + PIECE_BYTES, len(self.data))
            data = LOWER[self.data[at:end]] if lower else self.data[at:end]
            edge = np.diff(IS_WORD[data].astype(np.int8), prepend=np.int8(0))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            hashed = hasher(seed)
            parts.append((starts + at, ends + at, hashed.runs(hashed.of_byte[data], starts, ends)))
            at = end
        starts, ends, hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        counts = np.searchsorted(starts, self.ends) - np.searchsorted(starts, self.starts)
        return starts, ends, hashes, counts


def docs_of(ids: pa.Array, texts: pa.Array) -> Docs:
    """Null texts are empty; a null id becomes NO_ID."""
    ids = ids.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
    raw = [t.encode() for t in texts.fill_null("").to_pylist()]
    return Docs(ids, np.array([len(t) for t in raw], np.int64), np.frombuffer(b"".join([t + b" " for t in raw]), np.uint8))


def pack_docs(docs: Docs) -> bytes:
    head = np.array([len(docs)], np.int64).tobytes() + docs.ids.astype(np.int64).tobytes() + docs.sizes.astype(np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + docs.data.tobytes())


def unpack_docs(blob: bytes) -> Docs:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, sizes = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int64, n, 8 + 8 * n)
    return Docs(ids, sizes, np.frombuffer(raw, np.uint8, offset=8 + 16 * n))


def pack(docs: DataFrame, shards: int, label: str | None = None) -> DataFrame:
    """(shard, docs, labels): every document, compressed with others of its shard, and the value of a column for each."""
    narrow = docs.select(
        shard_of("doc_id", shards),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        (F.col(label) if label else F.lit(None)).cast("string").alias("label"),
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0

        def flush():
            blobs = [pack_docs(docs_of(pa.array(ids, pa.int64()), pa.array(texts, pa.string()))) for ids, texts, _ in held.values()]
            return pa.record_batch({
                "shard": pa.array(list(held), pa.int32()), "docs": pa.array(blobs, pa.binary()),
                "labels": pa.array([x if label else None for _, _, x in held.values()], pa.list_(pa.string())),
            })

        for batch in batches:
            for shard, *row in zip(*(batch.column(k).to_pylist() for k in range(4))):
                for values, value in zip(held.setdefault(shard, ([], [], [])), row):
                    values.append(value)
                size += len(row[1] or "") + 16
                if size >= PACK_BYTES:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    return narrow.mapInArrow(packed, "shard int, docs binary, labels array<string>")


def shard_of(doc_id: str, shards: int):
    return F.pmod(F.xxhash64(F.col(doc_id).cast("bigint")), F.lit(shards)).cast("int").alias("shard")


def slices(batches: Iterator[pa.RecordBatch], limit: int = 2 << 20) -> Iterator[Docs]:
    """The (doc_id, text) rows of ``batches``, about ``limit`` bytes of text at a time."""
    for batch in batches:
        sizes = np.cumsum(np.append(0, pa.compute.binary_length(batch.column(1).fill_null("")).to_numpy()))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit)) - 1)
            yield docs_of(batch.column(0)[at:end], batch.column(1)[at:end])
            at = end


def salted_join(rows: DataFrame, lookup: DataFrame, keys: list[tuple[str, str]], salt: Column, how: str = "inner", salts: int = 16) -> DataFrame:
    """``rows`` with the other columns of ``lookup``, which has one row a key; nulls are equal.

    The rows of a key are dealt to ``salts`` places by ``salt``, a hash, and its one row of ``lookup`` to each of them.
    """
    spread = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    same = F.pmod(salt, F.lit(salts)).cast("int") == F.col("_salt")
    for own, other in keys:
        same = same & F.col(own).eqNullSafe(F.col(other))
    return rows.join(spread, same, how).drop("_salt", *[other for _, other in keys])


def id_text(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))


def ids_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


def shingles(docs: Docs, size: int = 5, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, first word) of every run of ``size`` words; a document with fewer words has one run of all."""
    _, _, words, counts = docs.words(lower)
    ends = np.cumsum(counts)
    firsts = ends - counts
    runs = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(docs)), runs)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + np.repeat(firsts, runs)
    end = np.minimum(start + size, ends[doc])
    return hasher(2).runs(words, start, end), doc, start


# --- Questions and answers ------------------------------------------------------------------------------------------


def pack_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as differences, split into byte planes."""
    steps = np.diff(values, prepend=U64(0)).view(np.uint8).reshape(-1, 8).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps).tobytes())


def unpack_sorted(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def split_at(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Bounds of the equal ranges of ``bits``-bit numbers in sorted ``values``."""
    edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


class Asked:
    """Sorted distinct values of a shard, each a number with an optional 32-bit tag, and which of them recur in the shard."""

    def __init__(self, numbers: np.ndarray, tags: np.ndarray | None = None):
        order = np.argsort(numbers, kind="stable") if tags is None else np.lexsort((tags, numbers))
        sorted_numbers = numbers[order]
        new = np.ones(len(order), bool)
        new[1:] = sorted_numbers[1:] != sorted_numbers[:-1]
        if tags is not None:
            sorted_tags = tags[order]
            new[1:] |= sorted_tags[1:] != sorted_tags[:-1]
        first = np.flatnonzero(new)
        self.numbers = sorted_numbers[first]
        self.tags = None if tags is None else sorted_tags[first]
        self.first = order[first]
        self.repeated = np.diff(np.append(first, len(order))) > 1
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1

    def rows(self, shard: int, buckets: int, bits: int) -> pa.Table:
        """One row for each bucket that the values reach."""
        cuts = split_at(self.numbers, buckets, bits)
        some = [b for b in range(buckets) if cuts[b] < cuts[b + 1]]
        tags = None if self.tags is None else [self.tags[cuts[b] : cuts[b + 1]].tobytes() for b in some]
        return pa.table({
            "bucket": pa.array(some, pa.int32()),
            "shard": pa.array([shard] * len(some), pa.int32()),
            "body": pa.array([pack_sorted(self.numbers[cuts[b] : cuts[b + 1]]) for b in some], pa.binary()),
            "tags": pa.array(tags or [None] * len(some), pa.binary()),
        })

    def shared(self, answers: list[tuple[int, bytes]], buckets: int, bits: int) -> np.ndarray:
        """Which values occur more than once anywhere, given the answers to ``rows``."""
        cuts, out = split_at(self.numbers, buckets, bits), self.repeated.copy()
        for bucket, body in answers:
            a, b = cuts[bucket], cuts[bucket + 1]
            out[a:b] |= np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
        return out


ASKED = "bucket int, shard int, body binary, tags binary"
ANSWERED = "shard int, bucket int, bits binary"


def in_ranges(parts: list[np.ndarray], at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, list[slice]]]:
    """Sorted arrays joined range by range of their values, about ``at_once`` of them at a time, and where they come from."""
    total = sum(map(len, parts))
    ranges = 1 + total // at_once
    every = max(1, total // (ranges * 64))
    sample = np.sort(np.concatenate([p[::every] for p in parts]))
    edges = np.unique(sample[[len(sample) * k // ranges for k in range(1, ranges)]]) if ranges > 1 else sample[:0]
    cuts = [np.concatenate([[0], np.searchsorted(p, edges), [len(p)]]) for p in parts]
    for k in range(len(edges) + 1):
        slices = [slice(int(c[k]), int(c[k + 1])) for c in cuts]
        yield np.concatenate([p[s] for p, s in zip(parts, slices)]), slices


def answer(asked: pa.Table) -> pa.Table:
    """For each value of a bucket one bit: does another shard ask for it too?"""
    parts = [unpack_sorted(b) for b in asked.column("body").to_pylist()]
    tags = [None if t is None else np.frombuffer(t, np.uint32) for t in asked.column("tags").to_pylist()]
    shared = [np.zeros(len(p), bool) for p in parts]
    for numbers, slices in in_ranges(parts):
        marks = None if tags[0] is None else np.concatenate([t[s] for t, s in zip(tags, slices)])
        every = Asked(numbers, marks)
        repeated, at = every.repeated[every.place], 0
        for out, s in zip(shared, slices):
            out[s] = repeated[at : at + s.stop - s.start]
            at += s.stop - s.start
    bits = [np.packbits(s).tobytes() for s in shared]
    return pa.table({"shard": asked.column("shard"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary())})
