"""Toxicity by a classifier chain.

Categories are predicted one after another by L1-regularised logistic regressions over hashed tokens; each later model also
gets the probabilities of the categories before it. In training these are out-of-fold: a document's earlier probabilities
come from a model that has not seen it, as they will when the chain meets new documents.

Tokens are runs of letters (ASCII letters and all bytes from 128; A-Z lower-cased) with their leading 4 to 8 bytes, and runs of
other marks. A feature is a token's 64-bit hash, so that a text of any length has none by chance, and weighs log(1 + count):
a few toxic words count as much in a long clean text as in a short one. Training takes a bounded sample of the labelled rows,
chosen by a hash of the id: at most about ``SAMPLE_ROWS`` of them and ``SAMPLE_BYTES`` of text. The models of a category, that of
the whole sample and one for each fold, are fitted side by side, a task each, by accelerated proximal gradient steps; their few
weights travel with the tasks that score every whole text, a megabyte at a time.

Defined cases: a text without tokens, such as a null one, has probability 0 throughout; rows without an id, repeated rows and texts of any
length are scored like others; labels that are null, or whose id has no text, are not learned from; an id with several labels
counts once, as the largest; a category that the sample always or never has gets that constant as its probability, and with no
labelled rows every probability is 0. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from askloop.llm.common import LOWER, PIECE_BYTES, Docs, hasher, id_text, ids_array, slices
from askloop.session import materialize

SAMPLE_ROWS = 8_000
SAMPLE_BYTES = 48 << 20
SAMPLE_PARTITIONS = 6
FOLDS = 3
REGULARISATION = 0.001
STEPS, STEP_TOLERANCE = 200, 1e-4
#: Documents of the sample that hold a token, at least, for it to be a feature.
LEAST_DOCUMENTS = 3
LEADING = (4, 5, 6, 7, 8)
IS_LETTER = np.zeros(256, np.int8)
IS_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
KIND = IS_LETTER.copy()  # 1 letters, 2 other marks, 0 blanks
KIND[[c for c in range(33, 127) if not IS_LETTER[c]]] = 2
COUNTED = "doc_id bigint, features array<bigint>, amounts array<double>"
FITTED = "fold int, features array<bigint>, weights array<double>, earlier array<double>, intercept double"


def tokens(docs: Docs) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(feature, document) of every token and leading part, about a megabyte of text at a time."""
    hashed, at = hasher(7), 0
    while at < len(docs.data):
        end = min(at + PIECE_BYTES, len(docs.data))
        while end < len(docs.data) and KIND[docs.data[end - 1]]:  # a piece ends at a blank
            blank = np.flatnonzero(KIND[docs.data[end : end + PIECE_BYTES]] == 0)
            end = end + int(blank[0]) + 1 if len(blank) else min(end + PIECE_BYTES, len(docs.data))
        data = LOWER[docs.data[at:end]]
        kind = KIND[data]
        starts = np.flatnonzero((kind != 0) & np.append(True, kind[1:] != kind[:-1]))
        ends = np.flatnonzero((kind != 0) & np.append(kind[1:] != kind[:-1], True)) + 1
        values, owner = hashed.of_byte[data], np.searchsorted(docs.starts, starts + at, side="right") - 1
        parts = [(hashed.runs(values, starts, ends), owner)]
        letters = kind[starts] == 1
        for size in LEADING:
            long = letters & (ends - starts > size)
            parts.append((hashed.runs(values, starts[long], starts[long] + size) + np.uint64(size), owner[long]))
        yield tuple(np.concatenate(x) for x in zip(*parts))
        at = end


def _summed(owner: np.ndarray, feature: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, feature) in order with their summed counts."""
    order = np.lexsort((feature, owner))
    owner, feature = owner[order], feature[order]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1]))[: len(owner)])
    return owner[first], feature[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def _counted(df: DataFrame) -> DataFrame:
    """(doc_id, features, amounts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs in slices(batches):
            parts = [_summed(owner, feature, np.ones(len(owner))) for feature, owner in tokens(docs)]
            owner, feature, counts = _summed(*(np.concatenate(x) for x in zip(*parts)))
            bounds = pa.array(np.searchsorted(owner, np.arange(len(docs) + 1)), pa.int32())
            yield pa.record_batch({
                "doc_id": ids_array(docs.ids),
                "features": pa.ListArray.from_arrays(bounds, pa.array(feature.view(np.int64))),
                "amounts": pa.ListArray.from_arrays(bounds, pa.array(np.log1p(counts))),
            })

    return id_text(df).mapInArrow(run, COUNTED)


class Link:
    """One fitted model of the chain: weights of features, of earlier probabilities, and the intercept."""

    def __init__(self, features: list[int], weights: list[float], earlier: list[float], intercept: float):
        self.features, self.weights = np.array(features, np.int64).view(np.uint64), np.array(weights, np.float64)
        self.earlier, self.intercept = earlier, intercept

    def places(self, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of ``feature`` have a weight, and its place."""
        if not len(self.features):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.features, feature), len(self.features) - 1)
        known = np.flatnonzero(self.features[at] == feature)
        return known, at[known]

    def probability(self, total: np.ndarray, before: list[np.ndarray]) -> np.ndarray:
        for p, v in zip(before, self.earlier):
            total = total + p * v
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -500, 500)))


def solve(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, size: int, penalty: float = REGULARISATION, steps: int = STEPS, tolerance: float = STEP_TOLERANCE) -> tuple[np.ndarray, float]:
    """Weights and intercept that minimise the mean logistic loss plus ``penalty`` times the sum of absolute weights.

    Accelerated proximal gradient steps; the step's length comes from the largest singular value of the sparse rows.
    """
    n, weights, intercept = len(label), np.zeros(size), 0.0
    x = np.ones(size + 1)
    for _ in range(20):
        z = np.bincount(row, value * x[column], n) + x[-1]
        x = np.append(np.bincount(column, value * z[row], size), z.sum())
        norm = np.linalg.norm(x)
        x /= norm
    rate = 1 / (0.26 * norm / n)
    ahead, ahead_b, momentum = weights, intercept, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * ahead[column], n) + ahead_b, -500, 500))) - label
        moved = ahead - rate / n * np.bincount(column, value * error[row], size)
        new = np.sign(moved) * np.maximum(np.abs(moved) - rate * penalty, 0)
        new_b = ahead_b - rate / n * error.sum()
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        change = max(np.abs(new - weights).max(initial=0), abs(new_b - intercept))
        ahead = new + (momentum - 1) / following * (new - weights)
        ahead_b = new_b + (momentum - 1) / following * (new_b - intercept)
        weights, intercept, momentum = new, new_b, following
        if change < tolerance:
            break
    return weights, float(intercept)


def _fit(rows: DataFrame, category: str, earlier: list[str], folds: list[int]) -> dict[int, Link]:
    """The category's model without each of ``folds``, -1 for none. A model's rows are the bounded sample."""

    def fitted(group: pa.Table) -> pa.Table:
        label = group.column(category).to_numpy().astype(np.float64)
        lists, amounts = (group.column(c).combine_chunks() for c in ("features", "amounts"))
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        features, column, held = np.unique(lists.flatten().to_numpy().view(np.uint64), return_inverse=True, return_counts=True)
        often = held >= LEAST_DOCUMENTS
        keep = often[column]
        row, value, column = row[keep], amounts.flatten().to_numpy()[keep], (np.cumsum(often) - 1)[column[keep]]
        features, more = features[often], [group.column(c).to_numpy() for c in earlier]
        if label.min() == label.max():
            weights, intercept = np.zeros(len(features) + len(more)), 40.0 if label[0] else -40.0
        else:
            for k, p in enumerate(more):
                row, value = np.append(row, np.arange(len(label))), np.append(value, p)
                column = np.append(column, np.full(len(label), len(features) + k))
            weights, intercept = solve(row, column, value, label, len(features) + len(more))
        used = np.flatnonzero(weights[: len(features)])
        return pa.table({
            "fold": pa.array([group.column("group")[0].as_py()], pa.int32()),
            "features": pa.array([features[used].view(np.int64)], pa.list_(pa.int64())), "weights": pa.array([weights[used]], pa.list_(pa.float64())),
            "earlier": pa.array([weights[len(features) :]], pa.list_(pa.float64())), "intercept": pa.array([intercept], pa.float64()),
        })

    dealt = rows.withColumn("group", F.explode(F.array(*[F.lit(f) for f in folds]))).filter("group <> fold")
    models = dealt.groupBy("group").applyInArrow(fitted, FITTED).collect()
    found = {r.fold: Link(r.features, r.weights, r.earlier, r.intercept) for r in models}
    return {f: found.get(f, Link([], [], [0.0] * len(earlier), -40.0)) for f in folds}


def _held_out(rows: DataFrame, links: dict[int, Link], name: str, earlier: list[str]) -> DataFrame:
    """``rows`` with the probability by the model that has not seen them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold, lists, out = batch.column("fold").to_numpy(), batch.column("features"), np.zeros(len(batch))
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            feature, amount = lists.flatten().to_numpy().view(np.uint64), batch.column("amounts").flatten().to_numpy()
            before = [batch.column(c).to_numpy() for c in earlier]
            for k in range(FOLDS):
                known, at = links[k].places(feature)
                p = links[k].probability(np.bincount(row[known], amount[known] * links[k].weights[at], len(batch)), before)
                out = np.where(fold == k, p, out)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, f"p_{name}"])

    return rows.mapInArrow(run, rows.withColumn(f"p_{name}", F.lit(0.0)).schema)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], sample_rows: int = SAMPLE_ROWS) -> list[Link]:
    """A chain for ``categories`` (name -> 0/1 expression over ``labels``), in their order."""
    names = list(categories)
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[c.cast("int").alias(n) for n, c in categories.items()])
    marked = marked.na.drop().groupBy("doc_id").agg(*[F.max(n).alias(n) for n in names])
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("length(trim(text)) > 0")
    sizes = texts.select("doc_id", F.octet_length("text").alias("size")).join(marked.select("doc_id"), "doc_id")
    n, size = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    share = min(1.0, sample_rows / max(1, n), SAMPLE_BYTES / max(1, size))
    chosen = marked.filter(place < F.lit(share * (1 << 30)))
    fold = F.pmod(F.hash("doc_id", F.lit("fold")), F.lit(FOLDS)).alias("fold")
    rows = _counted(texts.filter(place < F.lit(share * (1 << 30)))).join(chosen, "doc_id").select("features", "amounts", *names, fold)
    rows = materialize(rows.coalesce(SAMPLE_PARTITIONS), "toxicity-sample")
    chain: list[Link] = []
    for k, name in enumerate(names):
        earlier = [f"p_{n}" for n in names[:k]]
        links = _fit(rows, name, earlier, [-1, *range(FOLDS)] if k + 1 < len(names) else [-1])
        chain.append(links[-1])
        if k + 1 < len(names):
            rows = materialize(_held_out(rows, links, name, earlier), "toxicity-sample")
    return chain


def predict(docs: DataFrame, chain: list[Link], names: list[str]) -> DataFrame:
    """(doc_id, p_<category>...) of every row."""
    fields = ", ".join(f"p_{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1 << 20):
            hits: list[list] = [[] for _ in chain]
            empty = np.ones(len(part), bool)
            for feature, owner in tokens(part):
                empty[owner] = False
                for link, found in zip(chain, hits):
                    known, at = link.places(feature)
                    found.append(_summed(owner[known], at, np.ones(len(at))))
            given: list[np.ndarray] = []
            for link, found in zip(chain, hits):
                owner, at, counts = _summed(*(np.concatenate(x) for x in zip(*found)))
                total = np.bincount(owner, np.log1p(counts) * link.weights[at], len(part))
                given.append(np.where(empty, 0.0, link.probability(total, given)))
            yield pa.record_batch({"doc_id": ids_array(part.ids), **{f"p_{n}": pa.array(np.round(p, 6)) for n, p in zip(names, given)}})

    return id_text(docs).mapInArrow(run, f"doc_id bigint, {fields}")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_junk, p_toxic, junk, toxic) of every row, learned from ``labels`` (doc_id, quality, toxic)."""
    categories = {"junk": (F.col("quality") == 0), "toxic": (F.col("toxic") == 1)}
    chain = train(docs, labels, categories)
    found = predict(docs, chain, list(categories))
    return found.select("doc_id", "p_junk", "p_toxic", *[(F.col(f"p_{n}") >= threshold).alias(n) for n in categories])
