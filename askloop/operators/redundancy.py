"""How often a question's turns repeat an answer or a line of reasoning.

Rationale redundancy asks, for each rationale, whether some later one of the same question shares at least
``threshold`` words with it. A rationale is held as a set of weighted elements so that the shared words of two
rationales are the summed weight of their common elements:

* ``bitand`` (counts combined by bitwise and): one element per word and set bit of its count, weighing that bit;
* ``min`` (the smaller count): one element per repeat of a word, weighing 1.

The words are cut and counted in Arrow batches, some texts at a time. A question of at most ``BLOCK`` rationales and ``LARGE``
bytes of them is tested in one task, and its texts are shuffled once, as they are. Of a larger question a rationale travels as
one text of its elements, and exact copies collapse before anything is compared. What is left is an existence join that never
makes a row for a pair: the rationales of a question fall into blocks of about ``BLOCK`` by a hash, each block meets each other
one of its question in one task, and a rationale leaves that task as soon as a partner is found. Questions of at most ``FEW``
rationales are tested together, many at a time: their words are sorted once, and neighbours that are equal add up what all
pairs share. In a larger one the elements are ordered rarest first and those of a single rationale are dropped. Partners are taken a stretch at a time, latest first. A rationale is only tested against
a stretch that holds an element of its prefix, that is one with ``threshold`` of its own weight at or behind it (two that
overlap enough have their first common element there), and if the weight it could share with the whole stretch reaches
``threshold``. Those left are one product of matrices, over the elements that both sides hold. A question with n different rationales costs n rows for each BLOCK
of them: one row a rationale up to about a thousand.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from askloop.functions.text import ascii_cut
from askloop.operators.skew import join_per_question
from askloop.schemas import KEYS
from askloop.session import materialize

#: Different rationales of a block, on average; partners tested at a time; numbers of a matrix at a time.
BLOCK = 1_024
STRETCH = 256
CELLS = 1 << 23
#: Rationales of a question that is tested along with others; words counted, and bytes of texts or elements tested, at a time.
FEW = 16
WORDS = 1 << 18
BYTES = 1 << 22
#: Bytes of the rationales of a question that is tested by one task.
LARGE = 1 << 24
#: What becomes of each byte of a text: the ASCII characters of no word are blanks.
CUT = bytes(b if b > 127 or chr(b).isalnum() or b == ord("_") else ord(" ") for b in range(256))
#: What two rationales share of a word, from how often each holds it.
SHARED = {"bitand": np.bitwise_and, "min": np.minimum}

#: What tells apart the groups of rationales that meet in one task.
MEETING = [*KEYS, "_one", "_two"]


def answer_redundancy(df: DataFrame) -> DataFrame:
    """Per question: rows, and rows whose answer occurs more than once."""
    counts = df.groupBy(*KEYS, "answer").agg(F.count(F.lit(1)).alias("c"))
    repeated = F.when((F.col("c") > 1) & F.col("answer").isNotNull(), F.col("c")).otherwise(0)
    return counts.groupBy(*KEYS).agg(
        F.sum("c").alias("n_rows"), F.sum(repeated).cast("bigint").alias("n_redundant")
    )


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words of texts made by ``ascii_cut``, and which of the texts each belongs to."""
    texts = texts.cast(pa.string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    cut = (data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b"").translate(CUT)
    parts = pc.split_pattern(pa.StringArray.from_buffers(len(texts), pa.py_buffer(ends - ends[0]), pa.py_buffer(cut)), " ")
    row = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy(zero_copy_only=False))
    told = parts.flatten().dictionary_encode()
    long = pc.greater_equal(pc.utf8_length(told.dictionary), 2).to_numpy(zero_copy_only=False).astype(bool)
    kept = long[told.indices.to_numpy(zero_copy_only=False)]
    return row[kept], told.filter(pa.array(kept))


def _elements(words: pa.ListArray, overlap: str) -> tuple[pa.Array, np.ndarray]:
    """Of some texts the elements ``weight:word`` in a fixed order, joined by blanks, and their summed weight."""
    row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
    return _weighed(row, words.flatten().dictionary_encode(), len(words), overlap)


def _weighed(row: np.ndarray, told: pa.DictionaryArray, n: int, overlap: str) -> tuple[pa.Array, np.ndarray]:
    """``_elements`` of ``n`` texts that hold the words ``told``, each in its ``row``."""
    order = pc.array_sort_indices(told.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, width = told.dictionary.take(pa.array(order)), max(1, len(order))
    held, counts = np.unique(row * width + rank[told.indices.to_numpy(zero_copy_only=False)], return_counts=True)
    if overlap == "bitand":
        bits = np.int64(1) << np.arange(max(1, int(counts.max(initial=0)).bit_length()))
        at, bit = np.nonzero(counts[:, None] & bits)
        weights = bits[bit]
    else:
        at = np.repeat(np.arange(len(counts)), counts)
        weights = np.ones(len(at), np.int64)
    elements = pc.binary_join_element_wise(pa.array(weights).cast(pa.string()), names.take(pa.array(held[at] % width)), ":")
    if overlap != "bitand":
        repeat = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        elements = pc.binary_join_element_wise(elements, pa.array(repeat).cast(pa.string()), "#")
    of_row = held[at] // width
    ends = np.searchsorted(of_row, np.arange(n + 1))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), elements), " ")
    return joined, np.bincount(of_row, weights, n).astype(np.int64)


def _split(elements: pa.Array) -> pa.ListArray:
    return pc.split_pattern(elements, " ")


def _parts(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Neighbours in runs of at most ``most`` in sum, one at least."""
    ends, low = np.cumsum(sizes), 0
    while low < len(ends):
        high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + most, "right")))
        yield low, high
        low = high


def _texts_weighed(texts: pa.Array, overlap: str) -> tuple[pa.Array, np.ndarray]:
    """``_elements`` of texts made by ``ascii_cut``, some at a time."""
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    done = [_weighed(*_words(texts[low:high]), high - low, overlap) for low, high in _parts(size, 8 * WORDS)]
    return pa.concat_arrays([d[0] for d in done]), np.concatenate([d[1] for d in done])


def _rationales(df: DataFrame) -> DataFrame:
    """The rationales of named questions, ready to be cut into words; without a turn none is later, and none is earlier."""
    return df.dropna(subset=[*KEYS, "turn", "rationale"]).select(*KEYS, "turn", ascii_cut(F.col("rationale")).alias("text"))


def _distinct_vectors(df: DataFrame, threshold: int, overlap: str) -> DataFrame:
    """Per question and distinct rationale: its copies, the last turn that holds it, its elements.

    A rationale of less weight than ``threshold``, or of none, overlaps nothing and has no row.
    """
    texts, names = _rationales(df), [*KEYS, "turn"]

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64)
            for low, high in _parts(size, 8 * WORDS):
                part = batch.slice(low, high - low)
                elements, weight = _texts_weighed(part.column("text"), overlap)
                out = pa.RecordBatch.from_arrays([*[part.column(n) for n in names], elements], [*names, "elements"])
                yield out.filter(pa.array(weight >= max(1, threshold)))

    schema = T.StructType([*[texts.schema[n] for n in names], T.StructField("elements", T.StringType())])
    return texts.mapInArrow(weighed, schema).groupBy(*KEYS, "elements").agg(F.count(F.lit(1)).alias("copies"), F.max("turn").alias("last"))


def _meetings(vectors: DataFrame, block: int) -> DataFrame:
    """``vectors`` of questions that have several, a row for each two blocks ``_one`` <= ``_two`` that theirs is one of."""
    sizes = vectors.groupBy(*KEYS).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    placed = join_per_question(vectors.select(*KEYS, "last", "elements"), sizes.filter("_n > 1").drop("_n"), "last")
    own = F.pmod(F.xxhash64("last"), F.col("_blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    met = placed.select(*KEYS, "last", "elements", own.alias("_own"), other)
    return met.select(*KEYS, F.least("_own", "_other").alias("_one"), F.greatest("_own", "_other").alias("_two"), "_own", "last", "elements")


def _weights(elements: pa.Array) -> np.ndarray:
    """The weights of elements ``weight:word``."""
    return pc.split_pattern(elements, ":", max_splits=1).flatten()[::2].cast(pa.float64()).to_numpy(zero_copy_only=False)


class _Sets:
    """Some rationales as element numbers, rarest first: those of a row are ``codes[ends[i] : ends[i + 1]]``."""

    def __init__(self, elements: pa.ListArray):
        words = elements.flatten().dictionary_encode()
        codes, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(elements)), elements.value_lengths().to_numpy(zero_copy_only=False))
        weights = _weights(words.dictionary)
        held = np.bincount(codes, minlength=len(weights))
        shared = held[codes] > 1
        codes, row = codes[shared], row[shared]
        rank = np.empty(len(held), np.int64)
        rank[np.argsort(held, kind="stable")] = np.arange(len(held))
        order = np.lexsort((rank[codes], row))
        self.codes, self.row, self.rank, self.weights = codes[order], row[order], rank, weights
        self.ends = np.searchsorted(self.row, np.arange(len(elements) + 1))
        sums = np.append(0.0, np.cumsum(weights[self.codes]))
        self.behind = sums[self.ends[self.row + 1]] - sums[:-1]  # the weight at and behind each element of a row

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the elements of ``rows``, and which of ``rows`` each belongs to."""
        sizes = self.ends[rows + 1] - self.ends[rows]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.ends[rows], sizes)
        return at, np.repeat(np.arange(len(rows)), sizes)

    def possible(self, rows: np.ndarray, partners: np.ndarray, threshold: int) -> np.ndarray:
        """Those of ``rows`` that both bounds leave."""
        theirs = np.zeros(len(self.weights), bool)
        prefixes = np.zeros(len(self.weights), bool)
        at, _ = self.of(partners)
        theirs[self.codes[at]] = True
        prefixes[self.codes[at[self.behind[at] >= threshold]]] = True
        at, place = self.of(rows)
        code = self.codes[at]
        met = np.bincount(place, prefixes[code] & (self.behind[at] >= threshold), len(rows)) > 0
        return rows[met & (np.bincount(place, self.weights[code] * theirs[code], len(rows)) >= threshold)]

    def overlaps(self, rows: np.ndarray, partners: np.ndarray) -> np.ndarray:
        """Shared weight of each of ``rows`` with each of ``partners``; elements that both sides hold are multiplied some at a time."""
        (at, mine), (there, theirs) = self.of(rows), self.of(partners)
        known = np.intersect1d(self.codes[at], self.codes[there])
        column = np.full(len(self.weights), -1)
        column[known] = np.arange(len(known))
        out, width = np.zeros((len(rows), len(partners))), max(1, CELLS // (len(rows) + len(partners)))
        for low in range(0, len(known), width):
            a, b = (np.zeros((len(x), min(width, len(known) - low))) for x in (rows, partners))
            for matrix, place, columns in ((a, mine, column[self.codes[at]]), (b, theirs, column[self.codes[there]])):
                here = (columns >= low) & (columns < low + width)
                matrix[place[here], columns[here] - low] = 1
            out += (a * self.weights[known[low : low + width]]) @ b.T
        return out


def _found(last: np.ndarray, own: np.ndarray, elements: pa.ListArray, threshold: int) -> np.ndarray:
    """Which rationales overlap a later one, of the same block or of the other one where there are two."""
    sets, found = _Sets(elements), np.zeros(len(last), bool)
    for block in np.unique(own):
        partners = np.flatnonzero(own == block)
        partners = partners[np.argsort(-last[partners], kind="stable")]
        seekers = np.flatnonzero(own != block) if own.min() < own.max() else partners
        for low in range(0, len(partners), STRETCH):
            some = partners[low : low + STRETCH]
            open_ = seekers[~found[seekers] & (last[seekers] < last[some].max())]
            open_ = sets.possible(open_, some, threshold)
            for at in range(0, len(open_), STRETCH):
                rows = open_[at : at + STRETCH]
                found[rows] = ((sets.overlaps(rows, some) >= threshold) & (last[some] > last[rows, None])).any(axis=1)
    return found


def _found_among_few(last: np.ndarray, group: np.ndarray, elements: pa.ListArray, threshold: int) -> np.ndarray:
    """Which rationales overlap a later one of their group: groups follow each other, each of ``FEW`` at most, by ``last``."""
    words = elements.flatten().dictionary_encode()
    row = np.repeat(np.arange(len(elements)), elements.value_lengths().to_numpy(zero_copy_only=False))
    codes, weights = words.indices.to_numpy(zero_copy_only=False), _weights(words.dictionary)
    key = group[row] * max(1, len(weights)) + codes
    order = np.argsort(key, kind="stable")  # of equal elements of a group the earlier rationale's first
    return _later(last, key[order], row[order], weights[codes[order]], threshold, np.minimum)


def _later(last: np.ndarray, key: np.ndarray, row: np.ndarray, n: np.ndarray, threshold: int, shared: Callable) -> np.ndarray:
    """Which rows share ``threshold`` with a later one of their group, where each ``row`` holds ``n`` of what ``key`` names.

    A key belongs to one group, which has ``FEW`` rows at most; entries are sorted by key and row.
    """
    sums = np.zeros(len(last) * FEW)  # by rationale and by how many places behind it the other one is
    for apart in range(1, FEW):
        at = np.flatnonzero(key[apart:] == key[:-apart])
        if not len(at):
            break
        sums += np.bincount(row[at] * FEW + row[at + apart] - row[at], shared(n[at], n[at + apart]), len(sums))
    one, behind = np.nonzero(sums.reshape(-1, FEW) >= threshold)
    later = (behind > 0) & (last[np.minimum(one + behind, len(last) - 1)] > last[one])
    found = np.zeros(len(last), bool)
    found[one[later]] = True
    return found


def _tested(held: pa.Table, threshold: int) -> pa.Table:
    """The rows of ``held`` that overlap a later one of their group: groups of equal ``MEETING`` follow each other whole, by ``last``."""
    starts = np.append(_starts(held, MEETING), len(held))
    last, own, one, two = (held.column(c).to_numpy() for c in ("last", "_own", "_one", "_two"))
    sizes, elements = np.diff(starts), held.column("elements").combine_chunks()
    group, found = np.repeat(np.arange(len(sizes)), sizes), np.zeros(len(held), bool)
    few = (sizes <= FEW) & (one[starts[:-1]] == two[starts[:-1]])
    some = np.flatnonzero(few[group])
    found[some] = _found_among_few(last[some], group[some], _split(elements.take(pa.array(some))), threshold)
    for k in np.flatnonzero(~few):
        low, high = starts[k], starts[k + 1]
        found[low:high] = _found(last[low:high], own[low:high], _split(elements[low:high]), threshold)
    return held.select([*KEYS, "last"]).filter(pa.array(found))


def _starts(held: pa.Table, by: list[str]) -> np.ndarray:
    """The rows that begin a group."""
    new = np.zeros(len(held), bool)
    new[:1] = True
    for name in by:
        column = held.column(name)
        new[1:] |= ~pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy().astype(bool)
    return np.flatnonzero(new)


def _whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], text: str) -> Iterator[pa.Table]:
    """A sorted stream of rows in tables of whole groups; only the group that goes on in the next batch is held back."""
    pending = []  # rows of one group
    for batch in batches:
        for low, high in _parts(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(np.int64), BYTES):
            part = batch.slice(low, high - low)
            edge = pa.Table.from_batches([*[p.slice(p.num_rows - 1) for p in pending[-1:]], part])
            begun = int(_starts(edge, by)[-1]) - len(pending[-1:])
            if begun >= 0 and (begun or pending):
                yield pa.Table.from_batches([*pending, part.slice(0, begun)])
                pending, part = [], part.slice(begun)
            pending.append(part)
    if pending:
        yield pa.Table.from_batches(pending)


def _by_groups(batches: Iterator[pa.RecordBatch], threshold: int) -> Iterator[pa.RecordBatch]:
    """``_tested`` on a sorted stream of rows."""
    for held in _whole_groups(batches, MEETING, "elements"):
        yield from _tested(held, threshold).to_batches()


def _few_texts(last: np.ndarray, sizes: np.ndarray, texts: pa.Array, threshold: int, overlap: str) -> np.ndarray:
    """Which texts overlap a later one of their question: questions of ``sizes``, ``FEW`` at most, follow each other, by ``last``."""
    row, told = _words(texts)
    group, begin = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
    place, width = np.arange(len(texts)) - begin, max(1, len(told.dictionary))
    codes = told.indices.to_numpy(zero_copy_only=False)
    key, n = np.unique((group[row] * width + codes) * FEW + place[row], return_counts=True)
    starts = np.cumsum(sizes) - sizes
    held = key // FEW
    return _later(last, held, starts[held // width] + key % FEW, n, threshold, SHARED[overlap])


def _many_texts(last: np.ndarray, texts: pa.Array, threshold: int, overlap: str) -> np.ndarray:
    """Which of a question's texts overlap a later one; all but the last of equal ones do."""
    elements, weight = _texts_weighed(texts, overlap)
    heavy = np.flatnonzero(weight >= threshold)
    found = np.zeros(len(last), bool)
    if len(heavy):
        found[heavy] = True
        told = elements.take(pa.array(heavy)).dictionary_encode()
        behind = np.unique(told.indices.to_numpy(zero_copy_only=False)[::-1], return_index=True)[1]
        rows = heavy[np.sort(len(heavy) - 1 - behind)]
        found[rows] = _found(last[rows], np.zeros(len(rows), int), _split(elements.take(pa.array(rows))), threshold)
    return found


def _questions(held: pa.Table, threshold: int, overlap: str) -> pa.Table:
    """How many rationales of each question a later one overlaps, where any is: questions follow each other whole, by ``turn``."""
    starts = _starts(held, KEYS)
    sizes, last = np.diff(np.append(starts, len(held))), held.column("turn").to_numpy()
    texts, found = held.column("text").combine_chunks(), np.zeros(len(held), bool)
    few = (sizes > 1) & (sizes <= FEW)
    some = np.flatnonzero(np.repeat(few, sizes))
    if len(some):
        found[some] = _few_texts(last[some], sizes[few], texts.take(pa.array(some)), threshold, overlap)
    for low, size in zip(starts[sizes > FEW], sizes[sizes > FEW]):
        found[low : low + size] = _many_texts(last[low : low + size], texts[low : low + size], threshold, overlap)
    counts = np.add.reduceat(found, starts, dtype=np.int64)
    out = held.select(KEYS).take(pa.array(starts)).append_column("n_redundant", pa.array(counts))
    return out.filter(pa.array(counts > 0))


def _small_questions(df: DataFrame, threshold: int, overlap: str) -> DataFrame:
    """Redundant rationales of each question that has any; all of its texts go to one task."""
    texts = _rationales(df).repartition(*KEYS).sortWithinPartitions(*KEYS, "turn")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _whole_groups(batches, KEYS, "text"):
            yield from _questions(held, threshold, overlap).to_batches()

    return texts.mapInArrow(counted, ", ".join([f"{k} string" for k in KEYS] + ["n_redundant bigint"]))


def _overlapped(vectors: DataFrame, threshold: int, block: int = BLOCK) -> DataFrame:
    """(question, last) of the rationales that a later one of their question overlaps."""
    met = _meetings(vectors, block).repartition(*MEETING).sortWithinPartitions(*MEETING, "last")
    schema = ", ".join([f"{k} string" for k in KEYS] + [f"last {vectors.schema['last'].dataType.simpleString()}"])
    return met.mapInArrow(lambda batches: _by_groups(batches, threshold), schema).distinct()


def _large_questions(df: DataFrame, threshold: int, overlap: str) -> DataFrame:
    """Redundant rationales of each question, which may be of any size."""
    vectors = materialize(_distinct_vectors(df, threshold, overlap), "rationale-sets")
    found = _overlapped(vectors, threshold).withColumn("_found", F.lit(1))
    # Of equal rationales all but the last turn's are redundant, and the last one if a later one overlaps it.
    return vectors.join(found, [*KEYS, "last"], "left").groupBy(*KEYS).agg(
        F.sum(F.col("copies") - 1 + F.coalesce("_found", F.lit(0))).cast("bigint").alias("n_redundant")
    )


def rationale_redundancy(df: DataFrame, threshold: int = 20, overlap: str = "bitand") -> DataFrame:
    """Per question: non-null rationales, and those that a later one overlaps. (dataset, split, id, turn) is unique."""
    threshold = max(1, threshold)
    size = F.coalesce(F.sum(F.octet_length("rationale")), F.lit(0)).alias("_bytes")
    totals = materialize(df.groupBy(*KEYS).agg(F.count("rationale").alias("n_rationales"), size), "rationale-counts")
    large = totals.filter((F.col("n_rationales") > BLOCK) | (F.col("_bytes") > LARGE)).select(*KEYS)
    large = materialize(large, "large-questions")  # so that the planner knows how few they are
    found = _small_questions(join_per_question(df, large, how="left_anti"), threshold, overlap).unionByName(
        _large_questions(join_per_question(df, large), threshold, overlap)
    )
    counts = totals.select(*KEYS, "n_rationales", F.lit(0).cast("bigint").alias("n_redundant"))
    return counts.unionByName(found.withColumn("n_rationales", F.lit(0).cast("bigint"))).groupBy(*KEYS).agg(
        F.sum("n_rationales").alias("n_rationales"), F.sum("n_redundant").alias("n_redundant")
    )


def redundancy_histogram(counts: DataFrame) -> DataFrame:
    """How many questions have how many redundant rows, fewest first."""
    return counts.groupBy("n_redundant").agg(F.count(F.lit(1)).alias("n_questions")).orderBy("n_redundant")


def redundancy_share(counts: DataFrame, rows: str) -> DataFrame:
    """Redundant rows in percent of all rows, 0 without rows."""
    share = 100.0 * F.sum("n_redundant") / F.nullif(F.sum(rows), F.lit(0))
    return counts.agg(
        F.sum(rows).cast("bigint").alias("n_rows"),
        F.sum("n_redundant").cast("bigint").alias("n_redundant"),
        F.coalesce(share, F.lit(0.0)).alias("percent"),
    )
