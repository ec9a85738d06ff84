"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to ``ORDER`` bytes. A byte is coded in the longest context seen in training
that has it; each longer one costs an escape. Escape probabilities follow method C with exclusion: a context with total T
over q distinct bytes, less those that the longer context already ruled out, gives a byte with count n the probability
n / (T + q) and an escape q / (T + q); below the empty context all bytes left are alike. Statistics are frozen after
training, so the code length of a text is exact and the shortest one names its language.

Training takes the rows with a language and a text. They are cut into pieces of about ``SAMPLE_PIECE`` bytes, of which a bounded
sample, about ``SAMPLE_BYTES`` for each language, is chosen by a hash of language and piece; the piece with the smallest hash is
always in it, so no language is lost, however few or long its texts. Equal pieces count once. The trees are counted by Spark and
travel with the tasks that score every whole text: at most about ``SAMPLE_BYTES`` times the number of languages.

Defined cases: a text that is null or has no letter is ``und`` with score 0, as is every text if nothing was learned. The
score is the probability of the language under equal priors. Equal code lengths go to the smaller name. Rows without an id,
repeated rows and texts of any length are scored like others; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloop.llm.common import Docs, id_text, ids_array, mix, slices
from askloop.session import materialize

ORDER = 4
SAMPLE_BYTES = 3_000_000
SAMPLE_PIECE = 1_000
CACHE_BITS = 18
UNKNOWN = "und"
PREDICTED = "doc_id bigint, lang_pred string, score double"


def grams(docs: Docs, length: int) -> np.ndarray:
    """Code of the bytes that end at each place, at most ``length`` and none of the document before; blanks between included."""
    data, codes = docs.data.astype(np.uint64), np.zeros(len(docs.data), np.uint64)
    for k in range(length):
        codes[k:] |= data[: len(data) - k] << np.uint64(8 * k)
    codes |= np.uint64(length << 56)
    for k in range(length - 1):  # places with fewer bytes before them
        at = docs.starts[docs.sizes > k] + k
        codes[at] = codes[at] & np.uint64((1 << 8 * (k + 1)) - 1) | np.uint64((k + 1) << 56)
    return codes


def _inside(docs: Docs) -> np.ndarray:
    inside = np.ones(len(docs.data), bool)
    inside[docs.ends] = False
    return inside


def length_of(codes: np.ndarray) -> np.ndarray:
    return codes >> np.uint64(56)


def shorten(codes: np.ndarray, length: int) -> np.ndarray:
    """The last ``length`` bytes of each code."""
    return codes & np.uint64((1 << 8 * length) - 1) | np.uint64(length << 56)


def before(codes: np.ndarray) -> np.ndarray:
    """Each code without its last byte."""
    body = (codes & np.uint64((1 << 56) - 1)) >> np.uint64(8)
    return body | (length_of(codes) - np.uint64(1)) << np.uint64(56)


class Tree:
    """Frozen counts of one language."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.counts = codes[order], counts[order].astype(np.float64)
        contexts, group = np.unique(before(self.codes), return_inverse=True)
        self.contexts = contexts
        self.total = np.bincount(group, self.counts, len(contexts))
        self.kinds = np.bincount(group, minlength=len(contexts)).astype(np.float64)
        # What the next shorter context loses by the bytes that this one rules out.
        longer = length_of(self.codes) > 1
        lower = np.zeros(len(self.codes))
        for length in np.unique(length_of(self.codes[longer])).tolist():
            at = length_of(self.codes) == length
            lower[at] = self.count(shorten(self.codes[at], length - 1))
        self.ruled_out = np.bincount(group, lower, len(contexts))

    def count(self, codes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.counts[at], 0.0)

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each code after the bytes before it."""
        bits, open_ = np.zeros(len(codes)), np.ones(len(codes), bool)
        less, fewer = np.zeros(len(codes)), np.zeros(len(codes))
        lengths = length_of(codes).astype(np.int64)
        for length in range(int(lengths.max(initial=1)), 0, -1):
            here = np.flatnonzero(open_ & (lengths >= length))
            code = shorten(codes[here], length)
            context = before(code)
            at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
            known = self.contexts[at] == context
            total = np.where(known, self.total[at] - less[here], 0.0)
            kinds = np.where(known, self.kinds[at] - fewer[here], 0.0)
            n = self.count(code)
            seen = n > 0
            bits[here[seen]] += np.log2((total + kinds)[seen] / n[seen])
            escaped = ~seen & (kinds > 0)
            bits[here[escaped]] += np.log2((total + kinds)[escaped] / kinds[escaped])
            less[here] = np.where(known, self.ruled_out[at], 0.0)
            fewer[here] = np.where(known, self.kinds[at], 0.0)
            open_[here[seen]] = False
        bits[open_] += np.log2(np.maximum(256 - fewer[open_], 1))
        return bits


class Scorer:
    """Code lengths under every language, with a table of the grams met last."""

    def __init__(self, model: list[tuple[str, np.ndarray, np.ndarray]]):
        self.names = [name for name, _, _ in model]
        self.trees = [Tree(codes, counts) for _, codes, counts in model]
        self.keys = np.zeros(1 << CACHE_BITS, np.uint64)
        self.held = np.zeros((1 << CACHE_BITS, len(model)))

    def lengths(self, docs: Docs) -> np.ndarray:
        """Bits of each document in each language."""
        codes = grams(docs, ORDER + 1)
        slots = (mix(codes) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        inside, sums = _inside(docs), np.zeros((len(docs.data) + 1, len(self.trees)))
        missed = np.flatnonzero(inside & (self.keys[slots] != codes))
        values = self.held[slots]
        if len(missed):
            new, which = np.unique(codes[missed], return_inverse=True)
            costs = np.stack([tree.bits(new) for tree in self.trees], axis=1)
            values[missed] = costs[which]
            at = (mix(new) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[at], self.held[at] = new, costs  # of grams with one slot the last stays
        values[~inside] = 0
        np.cumsum(values, axis=0, out=sums[1:])
        return sums[docs.ends] - sums[docs.starts]

    def predict(self, docs: Docs) -> tuple[list[str], list[float]]:
        if not self.trees:
            return [UNKNOWN] * len(docs), [0.0] * len(docs)
        bits = self.lengths(docs)
        best = bits.argmin(axis=1)
        with np.errstate(under="ignore"):
            scores = 1 / np.exp2(np.maximum(bits.min(axis=1, keepdims=True) - bits, -1000)).sum(axis=1)
        names, out = [], []
        for i, (b, score) in enumerate(zip(best.tolist(), scores.tolist())):
            known = has_letter(docs.text(i))
            names.append(self.names[b] if known else UNKNOWN)
            out.append(round(score, 6) if known else 0.0)
        return names, out


def has_letter(raw: bytes) -> bool:
    return any(c.isalpha() for c in raw.decode("utf-8", "ignore")) if raw else False


def pieces_of(raw: bytes, size: int = SAMPLE_PIECE) -> Iterator[bytes]:
    """``raw`` cut behind whole characters."""
    at = 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        yield raw[at:end]
        at = end


def sample(rows: DataFrame, sample_bytes: int) -> tuple[DataFrame, list[str]]:
    """(lang, text) of the chosen pieces, each once, and all languages of ``rows`` (lang, text)."""
    same = F.approx_count_distinct(F.xxhash64("text")) / F.count(F.lit(1))  # copies are one text
    sizes = rows.groupBy("lang").agg((F.sum(F.octet_length("text")) * F.least(same, F.lit(1.0))).alias("n")).collect()
    bound = {r.lang: int(min(1.0, sample_bytes / max(1.0, r.n)) * (1 << 64)) for r in sizes}

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, tuple[int, bytes]] = {}

        def told(found: list[tuple[str, int, bytes]]) -> pa.RecordBatch:
            lang, place, text = zip(*found)
            return pa.record_batch({
                "lang": pa.array(lang, pa.string()), "place": pa.array([f"{p:020d}" for p in place], pa.string()),
                "within": pa.array([p < bound[x] for x, p in zip(lang, place)]), "text": pa.array([t.decode() for t in text], pa.string()),
            })

        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                begin = xxhash.xxh64(lang.encode())
                for piece in pieces_of(text.as_py().encode()):
                    one = begin.copy()
                    one.update(piece)
                    place = one.intdigest()
                    if place < bound[lang]:
                        found.append((lang, place, piece))
                    least[lang] = min(least.get(lang, (place, piece)), (place, piece))
            if found:
                yield told(found)
        if least:
            yield told([(lang, *kept) for lang, kept in least.items()])

    # Each task's smallest pieces come along; only that of the whole language is taken beyond the bound.
    every = materialize(rows.mapInArrow(chosen, "lang string, place string, within boolean, text string"), "language-sample")
    least = every.groupBy("lang").agg(F.min("place").alias("least"))
    wanted = every.join(least, "lang").filter("within OR place = least")
    return wanted.select("lang", "text").distinct(), sorted(bound)


def train(docs: DataFrame, sample_bytes: int = SAMPLE_BYTES) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, gram codes, counts) for each language of ``docs`` (doc_id, text, lang)."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter("lang IS NOT NULL AND length(text) > 0")
    if rows.isEmpty():
        return []
    chosen, languages = sample(rows, sample_bytes)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            for code, name in enumerate(lang.dictionary.to_pylist()):
                of = batch.filter(pa.compute.equal(lang.indices, code))
                numbers = pa.array(np.zeros(len(of), np.int64))
                for part in slices(iter([pa.record_batch({"doc_id": numbers, "text": of.column(1)})])):
                    full = grams(part, ORDER + 1)[_inside(part)]
                    for length in range(1, ORDER + 2):
                        codes, counts = np.unique(shorten(full[length_of(full) >= length], length), return_counts=True)
                        yield pa.record_batch({
                            "lang": pa.array([name] * len(codes), pa.string()),
                            "gram": pa.array(codes.view(np.int64)),
                            "n": pa.array(counts.astype(np.int64)),
                        })

    table = chosen.mapInArrow(counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = table.toArrow()
    model = []
    for name in languages:
        own = got.filter(pa.compute.equal(got.column("lang"), name))
        if len(own):
            model.append((name, own.column("gram").to_numpy().view(np.uint64), own.column("n").to_numpy()))
    return model


def predict(docs: DataFrame, model: list) -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for part in slices(batches, 1 << 20):
            names, scores = scorer.predict(part)
            yield pa.record_batch({
                "doc_id": ids_array(part.ids),
                "lang_pred": pa.array(names, pa.string()),
                "score": pa.array(scores, pa.float64()),
            })

    return id_text(docs).mapInArrow(run, PREDICTED)
