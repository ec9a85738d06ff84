"""Quality classifier: an interpolated modified Kneser-Ney model of bytes, trained on trusted text.

Trusted are the documents that ``labels`` gives quality 1. Every document asks for the grams of ``ORDER`` bytes that it holds:
a shard sends its distinct grams once, with their counts in trusted text. Counts, continuation counts, context totals and
discounts are aggregated and joined by gram over the whole corpus (each order's table is hash-partitioned by gram or context),
and the log probabilities go back to the shards that asked. So what the model gathers grows with the documents and nothing of
it is kept in one place. A document's perplexity is 2 to the power of its bits for each byte.

Languages have a threshold of their own: the ``QUANTILE`` of the scores of their trusted documents. The score is the bits for
each byte, where ``PRIOR_BYTES`` bytes at the language's trusted median are added, so that few bytes cannot condemn a text.
A trusted document would read too well to a model that counted it, so trusted text is dealt into two halves by a hash of the
text (copies stay together) and a trusted document is scored by the model of the other half; all others, and every perplexity,
by the model of all trusted text. The three models are columns of the same tables.

Defined cases: a null or empty text has no perplexity and is rejected; other texts are kept if their language has no trusted
text (a null language is a language of its own); without any trusted text every byte has probability 1/256. Rows without an id
are never trusted. An id is trusted if any of its labels says so. Repeated rows are scored each; they count in training as
often as they occur. Other columns are not read. Texts are taken whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from askloop.llm.common import NO_ID, Docs, ids_array, mix, pack, pack_sorted, salted_join, shard_of, unpack_docs, unpack_sorted, widths
from askloop.session import materialize

ORDER = 5
QUANTILE = 0.99
PRIOR_BYTES = 200
SLOT_BITS = 19
#: Models and the columns that hold their counts and probabilities: all trusted text, and each half of it.
MODELS = ("full", "half0", "half1")
HALVES = len(MODELS) - 1
ASKED = "bucket int, shard int, grams binary, counts binary"
ANSWERED = "shard int, bucket int, bits binary"
SCORED = "doc_id bigint, lang string, trusted boolean, n_bytes bigint, bits double, held_out double"
NO_QUESTION = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
NO_SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("trusted", pa.bool_()), ("n_bytes", pa.int64()), ("bits", pa.float64()), ("held_out", pa.float64())])
MASK = (1 << 64) - 1


def codes(docs: Docs, order: int = ORDER) -> np.ndarray:
    """The ``order`` bytes that end at each place as one number; line ends stand before a document."""
    data = docs.data.astype(np.uint64)
    out = data.copy()
    for k in range(1, order):
        out[k:] |= data[:-k] << np.uint64(8 * k)
    for k in range(order - 1):
        at = docs.starts[docs.sizes > k] + k
        missing = sum(10 << 8 * j for j in range(k + 1, order))
        out[at] = out[at] & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64(missing)
    return out


def _inside(docs: Docs) -> np.ndarray:
    inside = np.ones(len(docs.data), bool)
    inside[docs.ends] = False
    return inside


class Shard:
    """A shard's documents with the distinct grams that they hold, sorted by bucket and gram."""

    def __init__(self, blobs: list[bytes], trusted: list[int], buckets: int, order: int):
        self.docs = [unpack_docs(b) for b in blobs]
        self.trusted = [np.isin(d.ids, np.array(trusted, np.int64)) & (d.ids != NO_ID) for d in self.docs]
        #: The half of trusted text that a document is in, or -1.
        self.half = [np.where(t, [zlib.crc32(d.text(i)) % HALVES if t[i] else 0 for i in range(len(d))], -1).astype(np.int8) for d, t in zip(self.docs, self.trusted)]
        self.order = order
        grams, counts = [], []
        for docs, half in zip(self.docs, self.half):
            of = codes(docs, order)
            of_half = np.where(_inside(docs), np.repeat(half, docs.sizes + 1), np.int8(-2))
            for h in range(-1, HALVES):
                found, n = np.unique(of[of_half == h], return_counts=True)
                grams.append(found)
                counts.append(np.outer(np.arange(HALVES) == h, n))
        every, place = np.unique(np.concatenate(grams), return_inverse=True)
        total = np.array([np.bincount(place, n, len(every)) for n in np.concatenate(counts, axis=1)], np.int64)
        bucket = every % np.uint64(buckets)
        order_ = np.lexsort((every, bucket))
        self.grams, self.counts = every[order_], np.ascontiguousarray(total[:, order_])
        self.cuts = np.searchsorted(bucket[order_], np.arange(buckets + 1, dtype=np.uint64))

    def question(self, shard: int) -> pa.Table:
        some = [b for b in range(len(self.cuts) - 1) if self.cuts[b] < self.cuts[b + 1]]
        own = [slice(self.cuts[b], self.cuts[b + 1]) for b in some]
        return pa.table({
            "bucket": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()),
            "grams": pa.array([pack_sorted(self.grams[s]) for s in own], pa.binary()),
            "counts": pa.array([_pack_counts(self.counts[:, s]) for s in own], pa.binary()),
        })

    def bits(self, answers: list[tuple[int, bytes]]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Code length of each document of each part to all trusted text, and to what a trusted document is not part of."""
        cost = np.zeros((1 + HALVES, len(self.grams)))
        for bucket, body in answers:
            own = slice(self.cuts[bucket], self.cuts[bucket + 1])
            told, at = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.float32), 0
            for row, needed in zip(cost, _needed(self.counts[:, own])):
                row[own][needed] = told[at : at + needed.sum()]
                at += needed.sum()
        sorted_ = np.argsort(self.grams)
        grams, cost = self.grams[sorted_], cost[:, sorted_]
        keys, held = np.full(1 << SLOT_BITS, MASK, np.uint64), np.zeros(1 << SLOT_BITS, np.int64)
        at = (mix(grams) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        keys[at], held[at] = grams, np.arange(len(grams))
        out = []
        for docs, half in zip(self.docs, self.half):
            of = codes(docs, self.order)
            slots = (mix(of) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
            place = held[slots]
            inside = _inside(docs)
            missed = np.flatnonzero(inside & (keys[slots] != of))
            place[missed] = np.searchsorted(grams, of[missed])
            place[~inside] = 0
            del of, slots

            def lengths(models: np.ndarray) -> np.ndarray:
                values = cost[np.repeat(models, docs.sizes + 1), place]
                values[~inside] = 0
                sums = np.concatenate([[0], np.cumsum(values)])
                return sums[docs.ends] - sums[docs.starts]

            out.append((lengths(np.zeros(len(docs), np.int8)), lengths(np.where(half < 0, 0, 2 - half).astype(np.int8))))
        return out


def _needed(counts: np.ndarray) -> list[np.ndarray]:
    """The grams that a shard needs from each model: all from that of all text, from a half what the other half's documents hold."""
    return [np.ones(counts.shape[1], bool), counts[1] > 0, counts[0] > 0]


def _pack_counts(counts: np.ndarray) -> bytes:
    """Counts of each half, as byte planes."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(counts.view(np.uint8).reshape(-1, 8).T).tobytes())


def _read_counts(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.int64).reshape(HALVES, -1)


def _gathered(asked: pa.Table) -> pa.Table:
    """The distinct grams of a bucket with their counts in trusted text and its halves."""
    parts = [unpack_sorted(g) for g in asked.column("grams").to_pylist()]
    grams, place = np.unique(np.concatenate(parts), return_inverse=True)
    counts = np.concatenate([_read_counts(c) for c in asked.column("counts").to_pylist()], axis=1)
    halves = [np.bincount(place, n, len(grams)).astype(np.int64) for n in counts]
    return pa.table({"gram": pa.array(grams.view(np.int64)), **dict(zip(MODELS, map(pa.array, [sum(halves), *halves])))})


def _answer(asked: pa.Table, costs: pa.Table) -> pa.Table:
    grams = costs.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    grams, cost = grams[order], [costs.column(m).to_numpy()[order].astype(np.float32) for m in MODELS]
    zip_ = zstandard.ZstdCompressor(level=1).compress
    bits = []
    for g, c in zip(asked.column("grams").to_pylist(), asked.column("counts").to_pylist()):
        place = np.searchsorted(grams, unpack_sorted(g))
        bits.append(zip_(b"".join(row[place[needed]].tobytes() for row, needed in zip(cost, _needed(_read_counts(c))))))
    return pa.table({"shard": asked.column("shard"), "bucket": asked.column("bucket"), "bits": pa.array(bits, pa.binary())})


def discounts(counts: DataFrame) -> DataFrame:
    """Modified Kneser-Ney discounts (one, two, more) of each model's counts, as a struct of its name; one row."""
    held = [F.sum((F.col(m) == i).cast("bigint")).alias(f"{m}{i}of") for m in MODELS for i in (1, 2, 3, 4)]

    def discount(m: str, i: int, plain: float) -> Column:
        n = lambda k: F.col(f"{m}{k}of")
        y = F.try_divide(n(1), n(1) + 2 * n(2))
        raw = F.lit(float(i)) - (i + 1) * y * F.try_divide(n(i + 1), n(i))
        usable = (n(1) > 0) & (n(i) > 0) & (raw > 0)
        return F.when(usable, raw).otherwise(F.lit(plain))

    return counts.agg(*held).select(*[
        F.struct(discount(m, 1, 0.5).alias("one"), discount(m, 2, 1.0).alias("two"), discount(m, 3, 1.5).alias("more")).alias(f"of_{m}")
        for m in MODELS
    ])


def _level(grams: DataFrame, lower: DataFrame | None, mask: int) -> DataFrame:
    """(gram, p of each model) of all grams of one order, given those of the next lower one; ``mask`` cuts the first byte.

    A context has at most 256 grams, so its sums are a window over few rows.
    """
    d = F.broadcast(discounts(grams).withColumn("all", F.lit(1)))  # one row by construction

    def cut(m: str) -> Column:
        n, of = F.col(m), F.col(f"of_{m}")
        wanted = F.when(n == 1, of["one"]).when(n == 2, of["two"]).otherwise(of["more"])
        return F.when(n > 0, F.least(wanted, n.cast("double"))).otherwise(F.lit(0.0))

    told = grams.withColumn("all", F.lit(1)).join(d, "all").select("gram", *MODELS, *[cut(m).alias(f"cut_{m}") for m in MODELS])
    siblings = Window.partitionBy(F.shiftright("gram", 8))
    told = told.withColumns({f"{k}_{m}": F.sum(c).over(siblings) for m in MODELS for k, c in (("total", m), ("rest", f"cut_{m}"))})
    if lower is None:
        told = told.withColumns({f"lower_{m}": F.lit(1.0 / 256) for m in MODELS})
    else:
        shorter = lower.select(F.col("gram").alias("suffix"), *[F.col(m).alias(f"lower_{m}") for m in MODELS])
        told = told.withColumn("suffix", F.col("gram").bitwiseAND(F.lit(mask))).join(shorter, "suffix")

    def p(m: str) -> Column:
        total, rest, below = (F.col(f"{k}_{m}") for k in ("total", "rest", "lower"))
        return F.when(total == 0, below).otherwise((F.col(m) - F.col(f"cut_{m}") + rest * below) / total)

    return told.select("gram", *[p(m).alias(m) for m in MODELS])


def probabilities(grams: DataFrame, order: int = ORDER, written: bool = False) -> DataFrame:
    """(gram, p of each model) for every gram with its counts in the models' text; p of its last byte after the others.

    All grams of lower orders are there too, with the number of different bytes that the text has before them. With
    ``written`` each order's counts and probabilities are tables of their own.
    """

    def kept(df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name) if written else df

    of_order = {order: kept(grams, "gram-counts")}
    for k in range(order - 1, 0, -1):
        low = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).alias("gram")
        counts = of_order[k + 1].groupBy(low).agg(*[F.sum((F.col(m) > 0).cast("bigint")).alias(m) for m in MODELS])
        of_order[k] = kept(counts, "gram-counts")
    found = None
    for k in range(1, order + 1):
        found = kept(_level(of_order[k], found, (1 << 8 * (k - 1)) - 1), "gram-probabilities")
    return found


def scores(docs: DataFrame, labels: DataFrame, order: int = ORDER, written: bool = False) -> DataFrame:
    """(doc_id, lang, trusted, n_bytes, bits, held_out) of every row; held_out are the bits without a document's own counts.

    One plan holds the whole model, and deals out the documents once. With ``written`` the model is built in small plans from
    written tables, for a driver that holds the plans of other stages too; the documents are then dealt out a second time.
    """
    shards, buckets = widths(docs.sparkSession)
    buckets |= 1
    by_shard = pack(docs, shards, "lang").groupBy("shard")
    trusted = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(shard_of("doc_id", shards), F.col("doc_id").cast("bigint").alias("doc_id")).distinct()

    def shard_from(blobs: pa.Table, ids: list) -> Shard:
        return Shard(blobs.column("docs").to_pylist(), ids, buckets, order)

    def question(key: tuple, blobs: pa.Table, ids: pa.Table) -> pa.Table:
        if not len(blobs):  # trusted ids without a document
            return NO_QUESTION.empty_table()
        return shard_from(blobs, ids.column("doc_id").to_pylist()).question(key[0].as_py())

    def finish(blobs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(blobs):
            return NO_SCORE.empty_table()
        rows = answers.to_pylist()
        shard = shard_from(blobs, [r["doc_id"] for r in rows if r["doc_id"] is not None])
        bits = shard.bits([(r["bucket"], r["bits"]) for r in rows if r["doc_id"] is None])
        langs = blobs.column("labels").to_pylist()
        return pa.concat_tables([pa.table({
            "doc_id": ids_array(d.ids), "lang": pa.array(lang, pa.string()), "trusted": pa.array(t),
            "n_bytes": pa.array(d.sizes.astype(np.int64)), "bits": pa.array(b), "held_out": pa.array(h),
        }) for d, lang, t, (b, h) in zip(shard.docs, langs, shard.trusted, bits)])

    asked = by_shard.cogroup(trusted.groupBy("shard")).applyInArrow(question, ASKED)
    grams = asked.groupBy("bucket").applyInArrow(_gathered, "gram bigint, " + ", ".join(f"{m} bigint" for m in MODELS))
    costs = probabilities(grams, order, written).select(
        F.pmod(F.col("gram"), F.lit(buckets)).cast("int").alias("bucket"), "gram", *[(-F.log2(m)).alias(m) for m in MODELS]
    )
    answers = asked.groupBy("bucket").cogroup(costs.groupBy("bucket")).applyInArrow(_answer, ANSWERED)
    told = answers.withColumn("doc_id", F.lit(None).cast("bigint")).unionAll(
        trusted.select("shard", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("bits"), "doc_id")
    )
    return by_shard.cogroup(told.groupBy("shard")).applyInArrow(finish, SCORED)


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, written: bool = False) -> DataFrame:
    """(doc_id, lang, n_bytes, perplexity, score, threshold, keep) of every row."""
    scored = materialize(scores(docs, labels, order, written), "quality-scores").withColumn("key", F.coalesce("lang", F.lit("\x00")))
    trusted, salt = scored.filter("trusted AND n_bytes > 0"), F.xxhash64("doc_id", "n_bytes", "bits")
    median = F.percentile_approx(F.col("held_out") / F.col("n_bytes"), 0.5, 10_000).alias("median")
    # One row a language, written so that the planner knows how few there are; otherwise a language's rows are salted.
    medians = materialize(trusted.groupBy(F.col("key").alias("__key")).agg(median), "language-medians")
    score = (F.col("held_out") + PRIOR_BYTES * F.col("median")) / (F.col("n_bytes") + PRIOR_BYTES)
    limit = salted_join(trusted, medians, [("key", "__key")], salt).groupBy(F.col("key").alias("__key"))
    limits = medians.join(limit.agg(F.percentile_approx(score, quantile, 10_000).alias("threshold")), "__key", "left")
    judged = salted_join(scored, materialize(limits, "language-thresholds"), [("key", "__key")], salt, "left").withColumn("score", score)
    kept = (F.col("n_bytes") > 0) & (F.col("threshold").isNull() | (F.col("score") <= F.col("threshold")))
    return judged.select(
        "doc_id", "lang", "n_bytes", F.when(F.col("n_bytes") > 0, F.pow(F.lit(2.0), F.col("bits") / F.col("n_bytes"))).alias("perplexity"),
        "score", "threshold", F.coalesce(kept, F.lit(False)).alias("keep"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id has a rejected text. Rows without an id cannot be named and stay."""
    rejected = classify(docs, labels, written=True).filter("NOT keep").select(F.col("doc_id").alias("__rejected")).distinct()
    return docs.join(rejected, F.col("doc_id") == F.col("__rejected"), "left_anti")
