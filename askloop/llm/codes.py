"""Vector codes: each of a vector's parts becomes the number of its nearest entry in a codebook, found by slices and bitmasks.

Components are integers, floor(scale * x), so distances and means are exact and no order of work changes a result. A codebook is
learnt in rounds: Spark deals the vectors to tasks, each finds the nearest entries of its parts and sums them, and what is added
up over all tasks is one row for each part, entry and position, however many vectors there are.

Nearest entries come by slice and intersect. For each position of a part the entries' coordinates are sorted once, and with the
k-th goes a 64-bit mask of the first k entries. A part's initial radius is its distance from one entry, the one next to it at the
position where the entries lie widest apart. Two binary searches at each position then give the slice of entries within the
radius, as the difference of two masks, and the masks of all positions are ANDed: what is left holds every entry within the
radius, so the nearest of these, the lowest at ties, is the nearest of all.

Defined cases: vectors that are null or hold null or non-finite components take no part, nor do vectors of another length than
that of the smallest kept id (null ids come last), vectors that do not divide into the parts, and vectors with a component
beyond ``LARGEST``, whose distances would pass 64 bits. Rows that share an id are rows of their own, each with its code; as a
starting entry an id counts once, with its smallest vector, and rows without an id are none. With fewer ids than entries the
codebook is smaller. An empty table gives no rows. Extra columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.llm.common import salted_join
from askloop.session import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a larger integer value are refused: 64 squares of their differences, so parts of 64 positions, still fit 64 bits.
LARGEST = 1 << 27
BLOCK_ROWS = 4_096


class Slices:
    """The entries of one part's codebook, at most 64, as sorted coordinates with masks of their prefixes."""

    def __init__(self, entries: np.ndarray):
        if len(entries) > 64:
            raise ValueError("a mask holds 64 entries")
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        self.masks = np.zeros((len(entries) + 1, entries.shape[1]), np.uint64)
        np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0, out=self.masks[1:])
        self.widest = int(np.argmax(self.sorted[-1] - self.sorted[0])) if entries.shape[1] else 0

    def start(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of each part from one entry, that next to it at the position where the entries lie widest apart."""
        near = np.searchsorted(self.sorted[:, self.widest], x[:, self.widest]).clip(max=len(self.entries) - 1)
        by_place = np.argsort(self.entries[:, self.widest], kind="stable")
        return ((x - self.entries[by_place[near]]) ** 2).sum(axis=1)

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Mask of the entries within ``radius`` of each part at every position."""
        left = np.full(len(x), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            left &= self.masks[high, d] ^ self.masks[low, d]
        return left

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each part, the lowest number at ties."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        reach = self.start(x)
        radius = np.sqrt(reach.astype(np.float64)).astype(np.int64) + 1  # never below the exact root
        masks = self.candidates(x, radius)
        best, number = reach + 1, np.zeros(len(x), np.int64)
        for e in range(len(self.entries)):
            rows = np.flatnonzero(masks >> np.uint64(e) & np.uint64(1))
            apart = ((x[rows] - self.entries[e]) ** 2).sum(axis=1)
            closer = apart < best[rows]
            best[rows[closer]], number[rows[closer]] = apart[closer], e
        return number, best


def components(vector: str = "vector", scale: int = SCALE) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def whole_vectors(df: DataFrame, vector: str, vec_id: str, label: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, vector): rows whose vector has only finite components, of a size that can be coded, as integers."""

    def fits(x: Column) -> Column:
        y = x.cast("double") * F.lit(float(scale))
        return x.isNotNull() & ~F.isnan(y) & (F.abs(y) < F.lit(float(LARGEST)))

    whole = df.filter(F.col(vector).isNotNull() & F.forall(vector, fits))
    return whole.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(label).alias("label"), components(vector, scale).alias("vector"))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size).astype(np.int64)


def assign(books: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry numbers and squared distances (rows, parts)."""
    step = x.shape[1] // len(books)
    found = [Slices(book).nearest(x[:, p * step : (p + 1) * step]) for p, book in enumerate(books)]
    return tuple(np.stack(y, axis=1) for y in zip(*found))


def of_one_length(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """The vectors as long as that of the smallest id, none if it does not divide into parts."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(1).collect()
    size = len(first[0].vector) if first else -2
    return rows.filter(F.size("vector") == (-2 if size % parts else size))


def first_books(rows: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids; bounded by ``entries`` rows."""
    ids = rows.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("vector").alias("vector"))
    first = ids.orderBy("vec_id").limit(entries).collect() or rows.orderBy("vector").limit(1).collect()
    if not first:
        return []
    whole = np.array([r.vector for r in first], np.int64).reshape(len(first), -1)
    return np.split(whole, parts, axis=1)


def improved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Each entry replaced by the floored mean of the parts that are nearest to it; unused entries stay."""
    size = sum(b.shape[1] for b in books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                x = matrix(batch.column(0)[at : at + BLOCK_ROWS], size)
                numbers, _ = assign(books, x)
                step = size // len(books)
                for p, total in enumerate(sums):
                    np.add.at(total[:, -1], numbers[:, p], 1)
                    np.add.at(total[:, :-1], numbers[:, p], x[:, p * step : (p + 1) * step])
        keys = [(p, e, k) for p, s in enumerate(sums) for e in range(len(s)) if s[e, -1] for k in range(s.shape[1])]
        if keys:
            yield pa.record_batch({
                **{name: pa.array([key[i] for key in keys], pa.int32()) for i, name in enumerate(("part", "entry", "place"))},
                "total": pa.array([int(sums[p][e, k]) for p, e, k in keys], pa.int64()),
            })

    partial = rows.select("vector").mapInArrow(summed, "part int, entry int, place int, total bigint")
    out = [b.copy() for b in books]
    totals = {(r.part, r.entry, r.place): r.total for r in partial.groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).collect()}
    for (p, e, k), total in totals.items():
        if k < out[p].shape[1]:
            out[p][e, k] = total // totals[p, e, out[p].shape[1]]
    return out


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """One codebook for each part, from vectors of one length."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = improved(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """(vec_id, label, code, error): entry numbers in the order of the parts, and the squared distances summed over them."""
    size = sum(b.shape[1] for b in books)
    kind = rows.schema["label"].dataType.simpleString()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                numbers, apart = assign(books, matrix(part.column(2), size))
                yield pa.record_batch({
                    "vec_id": part.column(0), "label": part.column(1),
                    "code": pa.array([bytes(n).hex() for n in numbers.astype(np.uint8)], pa.string()),
                    "error": pa.array(apart.sum(axis=1), pa.int64()),
                })

    return rows.select("vec_id", "label", "vector").mapInArrow(coded, f"vec_id bigint, label {kind}, code string, error bigint")


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return sha256(",".join(str(x) for b in books for row in b.tolist() for x in row).encode()).hexdigest()


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the error summed over equal labels."""
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return salted_join(coded, materialize(sums, "label-errors"), [("label", "_label")], F.xxhash64("vec_id", "code", "error"))


def compress(df: DataFrame, vector: str = "vector", vec_id: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of every vector that takes part."""
    rows = of_one_length(materialize(whole_vectors(df, vector, vec_id, label), "integer-vectors"))
    books = learn(rows)
    coded = materialize(encode(rows, books), "vector-codes")
    return label_errors(coded).withColumn("codebooks_sha256", F.lit(digest(books)))
