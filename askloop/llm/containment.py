"""Benchmark decontamination: short test items inside long documents, by size-partitioned MinHash containment search.

Words are runs of non-blank bytes with A-Z lower-cased; a text's set holds its distinct five-word shingles, or the whole
word sequence if it has fewer words. An item is contained in a document if at least ``threshold`` of the item's set is in
the document's.

Documents are partitioned by the power of two ``u`` that bounds their set size. A partition uses one-permutation MinHash with
2u bins (the leading bits of a shingle's hash choose the bin, the smallest hash in a bin is its value), so that a sketch
keeps a shingle that both sides share with a probability of 0.78 at any size and one equal bin makes a candidate: an item
with s shared shingles is missed by the sketches with a probability of 0.22 ** s. Items of at most ``EXACT_ITEM`` shingles
are looked up by every shingle instead, and for longer ones that no bin found the shared hashes are counted, so none is missed.
Candidates are verified on the words themselves.

Items are a stated set, taken in blocks of about ``BLOCK_BYTES`` of text; each block travels with its tasks and meets every
document in place, so no document is shuffled and a document's length or popularity is of no matter.

Defined cases: null or empty texts and texts without words are contained in nothing and contain nothing; rows without an id
keep a null id; repeated rows give repeated pairs; an empty side gives no pairs. Other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloop.llm.common import Docs, docs_of, id_text, ids_array, shingles, slices

BLOCK_BYTES = 16 << 20
EXACT_ITEM = 8
WORDS = 5
FOUND = "doc_id bigint, item_id bigint, n_shared bigint, n_item bigint"


def bin_minima(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The smallest hash of each of 2**bits bins that is not empty; ``hashes`` are sorted."""
    if not len(hashes):
        return hashes
    bins = hashes >> np.uint64(64 - bits)
    return hashes[np.concatenate([[True], bins[1:] != bins[:-1]])]


def size_class(n: np.ndarray | int):
    """Exponent of the power of two that bounds a set size of ``n``."""
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def shingle_set(raw: bytes, size: int = WORDS) -> set[tuple[bytes, ...]]:
    words = raw.lower().split()
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(size))))


class Items:
    """A block of items, with the sketches that each size class of documents needs."""

    def __init__(self, ids: list[int | None], texts: list[str | None]):
        block = docs_of(pa.array(ids, pa.int64()), pa.array(texts, pa.string()))
        hashes, owner, _ = shingles(block, WORDS)
        self.ids = ids
        self.sets = [shingle_set(block.text(i)) for i in range(len(ids))]
        self.hashes = [np.unique(h) for h in np.split(hashes, np.searchsorted(owner, np.arange(1, len(ids))))] if ids else []
        self.classes: dict[int, dict[int, list[int]]] = {}
        holders = np.repeat(np.arange(len(ids)), [len(h) for h in self.hashes]) if ids else np.zeros(0, np.int64)
        every = np.concatenate(self.hashes) if ids else hashes
        order = np.argsort(every, kind="stable")
        #: The distinct hashes, and the items that hold them: those of hash k are holders[first[k]:first[k + 1]].
        self.known, first = np.unique(every[order], return_index=True)
        self.holders, self.first = holders[order], np.append(first, len(every))
        self.sizes = np.array([len(h) for h in self.hashes], np.int64)
        self.filter = np.zeros(1 << 20, bool)
        self.filter[self.known >> np.uint64(44)] = True

    def sketches(self, size: int) -> dict[int, list[int]]:
        """Items by each value that their sketch has against documents of one size class."""
        if size not in self.classes:
            by_value = defaultdict(list)
            for i, hashes in enumerate(self.hashes):
                for h in (hashes if len(hashes) <= EXACT_ITEM else bin_minima(hashes, size + 1)).tolist():
                    by_value[h].append(i)
            self.classes[size] = dict(by_value)
        return self.classes[size]

    def enough(self, shared: np.ndarray, threshold: float) -> list[int]:
        """Items that have enough of the known hashes ``shared``."""
        at = np.searchsorted(self.known, shared)
        found = [self.holders[a:b] for a, b in zip(self.first[at].tolist(), self.first[at + 1].tolist())]
        items, n = np.unique(np.concatenate(found), return_counts=True)
        return items[n >= threshold * self.sizes[items]].tolist()

    def contained(self, docs: Docs, threshold: float) -> Iterator[tuple[int, int, int]]:
        """(document, item, shared shingles) of the items that the documents contain."""
        hashes, owner, _ = shingles(docs, WORDS)
        near = np.flatnonzero(self.filter[hashes >> np.uint64(44)])
        near = near[np.isin(hashes[near], self.known)]
        bounds = np.searchsorted(owner, np.arange(len(docs) + 1))
        for d in np.unique(owner[near]).tolist():  # only these can share a value with a sketch
            own = np.unique(hashes[bounds[d] : bounds[d + 1]])
            size = int(size_class(len(own)))
            sketches, minima = self.sketches(size), set(bin_minima(own, size + 1).tolist())
            candidates = set()
            shared = np.unique(hashes[near[owner[near] == d]])
            for h in shared.tolist():
                candidates.update(i for i in sketches.get(h, ()) if h in minima or len(self.hashes[i]) <= EXACT_ITEM)
            candidates.update(self.enough(shared, threshold))
            if candidates:
                there = shingle_set(docs.text(d))
                for i in sorted(candidates):
                    n = len(self.sets[i] & there)
                    if n and n >= threshold * len(self.sets[i]):
                        yield d, i, n


def find(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, n_shared, n_item): the pairs whose document contains the item."""
    found = None
    for ids, texts in _blocks(items, block_bytes):
        pairs = id_text(docs).mapInArrow(_finder(ids, texts, threshold), FOUND)
        found = pairs if found is None else found.unionAll(pairs)
    return found


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[tuple[list, list]]:
    """Ids and texts of the items, in blocks of about ``block_bytes`` of text; one empty block if there are none."""
    named = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + total // block_bytes
    for b in range(blocks):
        rows = named.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def _finder(ids, texts, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for docs in slices(batches):
            pairs = list(items.contained(docs, threshold))
            yield pa.record_batch({
                "doc_id": ids_array(docs.ids[np.array([d for d, _, _ in pairs], np.int64)]),
                "item_id": pa.array([ids[i] for _, i, _ in pairs], pa.int64()),
                "n_shared": pa.array([n for _, _, n in pairs], pa.int64()),
                "n_item": pa.array([len(items.sets[i]) for _, i, _ in pairs], pa.int64()),
            })

    return run


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = 0.8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows whose own text contains an item; every row is judged in place, whatever its id."""
    clean = docs
    for ids, texts in _blocks(items, block_bytes):
        clean = clean.mapInArrow(_cleaner(ids, texts, threshold), docs.schema)
    return clean


def _cleaner(ids, texts, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(ids, texts)
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text")).cast(pa.string())
            keep, at = np.ones(len(batch), bool), 0
            for docs in slices([pa.record_batch([pa.nulls(len(batch), pa.int64()), text], ["doc_id", "text"])]):
                keep[[at + d for d, _, _ in items.contained(docs, threshold)]] = False
                at += len(docs)
            yield batch.filter(pa.array(keep))

    return run
