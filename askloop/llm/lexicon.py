"""Byte-level BPE by a minimal acyclic transducer of frequent words.

Spark counts the words of the whole corpus. The ``size`` most frequent ones, a documented bound, are compiled in one task: an
automaton whose equal suffixes are one state, with numbers on its arcs that add up to a word's place in byte order, which
names the word's ids. Spark hands the file to every executor (``addFile``), whose workers map it into memory and so share its
pages. A batch of texts is cut into words by the vocabulary's pattern and all its words walk the automaton side by side, a byte
a step; a word that it lacks is merged exactly, lowest rank first, leftmost at equal ranks. What the lexicon holds therefore
decides the speed and never an id. Character classes of the pattern and the ids of all compiled words come from the tokenizers
library itself.

Defined cases: a null or empty text has no ids and decodes to an empty text; null ids decode to an empty text; the strings of
special tokens in a text become their ids, as in the library; ids outside the vocabulary decode to nothing, bytes that are no
UTF-8 to U+FFFD. Texts of any length are taken whole. An empty table gives a lexicon without words. Rows keep all their
columns, but a column with the name of a new one is replaced; repeated rows and ids stay as they are.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import struct
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer, normalizers

#: Words of the automaton and bytes of the longest.
LEXICON_WORDS = 1 << 16
LEXICON_BYTES = 48
#: Distinct words that a task counts before it hands them on; merged words that a worker keeps.
COUNTED_WORDS = 200_000
CACHED_WORDS = 150_000
SLICE_BYTES = 1 << 20
SHORT_WORD = 24
BLOCK_ROWS = 8_192
LETTER, NUMBER, OTHER, SPACE, SPECIAL = range(5)
#: Endings that the pattern cuts off behind an apostrophe (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
NONE = np.int32(2**31 - 1)


# --- The automaton ----------------------------------------------------------------------------------------------------


def minimal_states(words: list[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """States (final, arcs of (byte, state)) of the smallest automaton for distinct words in byte order; the last one is the start."""
    numbers: dict[tuple, int] = {}

    def number(state: list) -> int:
        return numbers.setdefault((state[0], tuple(state[1])), len(numbers))

    open_states, before = [[False, []]], b""
    for word in words:
        common = len(os.path.commonprefix([before, word]))
        while len(open_states) > common + 1:
            done = number(open_states.pop())
            open_states[-1][1].append((before[len(open_states) - 1], done))
        open_states.extend([False, []] for _ in word[common:])
        open_states[-1][0], before = True, word
    while len(open_states) > 1:
        done = number(open_states.pop())
        open_states[-1][1].append((before[len(open_states) - 1], done))
    start = number(open_states[0])
    states = list(numbers)
    assert start == len(states) - 1
    return states


def transducer(words: list[bytes]) -> dict[str, np.ndarray]:
    """The automaton as a double array: the arc of state s by byte b is at base[s] + b, if check says s. ``gap`` adds up to a place."""
    states = minimal_states(words)
    count, gaps = [], []
    for final, arcs in states:  # a state follows those that it leads to
        total, here = int(final), []
        for _, to in arcs:
            here.append(total)
            total += count[to]
        count.append(total)
        gaps.append(here)
    size = 256 * sum(len(arcs) > 1 for _, arcs in states) + len(states) + 1024  # more than the worst case takes
    taken, base = np.zeros(size, bool), np.zeros(len(states), np.int32)
    check, to, gap = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    low = 0
    for s in sorted((s for s, (_, arcs) in enumerate(states) if len(arcs) > 1), key=lambda s: -len(states[s][1])):
        labels = np.array([b for b, _ in states[s][1]])
        at = low
        while not (fits := ~taken[np.arange(at, at + 256)[:, None] + labels].any(axis=1)).any():
            at += 256
        base[s] = at = at + int(fits.argmax())
        if at - low > 2048:  # what is left behind is nearly full
            low += 512
        taken[at + labels], check[at + labels] = True, s
        to[at + labels], gap[at + labels] = [t for _, t in states[s][1]], gaps[s]
    single = np.array([s for s, (_, arcs) in enumerate(states) if len(arcs) == 1], np.int64)  # these fit anywhere
    free = np.flatnonzero(~taken[256:])[: len(single)] + 256
    label, following = (np.array([states[s][1][0][k] for s in single], np.int64) for k in (0, 1))
    base[single], check[free], to[free] = free - label, single, following
    gap[free] = [gaps[s][0] for s in single]
    used = 256 + max(int(base.max()), int(free.max(initial=0)))
    check, to, gap = check[:used], to[:used], gap[:used]
    final = np.array([f for f, _ in states], bool)
    return {"base": base, "check": check, "to": to, "gap": gap, "final": final, "start": np.array([len(states) - 1], np.int32)}


def places(lexicon: dict[str, np.ndarray], data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word data[start : start + size] its place in byte order among the compiled words, or -1."""
    found = np.full(len(starts), -1, np.int32)
    who = np.flatnonzero((sizes > 0) & (sizes <= LEXICON_BYTES))
    at, left = starts[who], sizes[who]
    state, place = np.full(len(who), lexicon["start"][0], np.int32), np.zeros(len(who), np.int32)
    base, check, to, gap, final = (lexicon[k] for k in ("base", "check", "to", "gap", "final"))
    while len(who):
        arc = base[state] + data[at]
        known = check[arc] == state
        if not known.all():
            who, at, left, arc, place = who[known], at[known], left[known], arc[known], place[known]
        state = to[arc]
        place = place + gap[arc]
        at, left = at + 1, left - 1
        done = left == 0
        if done.any():
            ended = done & final[state]
            found[who[ended]] = place[ended]
            more = ~done
            who, at, left, state, place = who[more], at[more], left[more], state[more], place[more]
    return found


# --- The file ---------------------------------------------------------------------------------------------------------


def to_file(arrays: dict[str, np.ndarray], settings: dict) -> bytes:
    """A header, then the arrays, each at a multiple of 64 bytes."""
    shape, at, parts = {}, 0, []
    for name, values in arrays.items():
        raw = np.ascontiguousarray(values).tobytes()
        shape[name] = (at, values.dtype.str, len(values))
        parts.append(raw + bytes(-len(raw) % 64))
        at += len(parts[-1])
    head = json.dumps({"arrays": shape, **settings}).encode()
    head += b" " * (-(len(head) + 8) % 64)
    return struct.pack("<Q", len(head)) + head + b"".join(parts)


def map_file(path: str) -> tuple[dict[str, np.ndarray], dict]:
    whole = np.memmap(path, np.uint8, "r").view(np.ndarray)  # still the mapped pages
    size = struct.unpack("<Q", whole[:8].tobytes())[0]
    head = json.loads(whole[8 : 8 + size].tobytes())
    arrays = {}
    for name, (at, kind, n) in head.pop("arrays").items():
        first = 8 + size + at
        arrays[name] = whole[first : first + n * np.dtype(kind).itemsize].view(kind)
    return arrays, head


def shown_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {**{chr(b): b for b in printable}, **{chr(256 + i): b for i, b in enumerate(others)}}


def character_classes() -> np.ndarray:
    """The class of every code point in the library's own pattern engine."""
    whole = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    classes = np.full(0x110000, OTHER, np.uint8)
    for kind, other in ((LETTER, r"[^\p{L}]+"), (NUMBER, r"[^\p{N}]+"), (SPACE, r"\S+")):
        left = normalizers.Replace(Regex(other), "").normalize_str(whole)
        classes[np.frombuffer(left.encode("utf-32-le"), np.uint32)] = kind
    return classes


def vocabulary_arrays(path: str) -> tuple[dict[str, np.ndarray], dict]:
    """Merges, the bytes of every id and the character classes of a byte-level BPE file, and its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec["pre_tokenizer"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or split["type"] != "ByteLevel" or split["add_prefix_space"] or not split["use_regex"] or spec["normalizer"]:
        raise ValueError("a plain byte-level BPE vocabulary without a leading blank is needed")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
        raise ValueError("special tokens that take in their surroundings are not supported")
    vocab, of_char = model["vocab"], shown_bytes()
    n = 1 + max([*vocab.values(), *special.values()])
    raw = [b""] * n
    for token, i in vocab.items():
        raw[i] = bytes(map(of_char.__getitem__, token))
    for token, i in special.items():
        raw[i] = token.encode()
    merges = [(vocab[a] * n + vocab[b], rank, vocab[a + b]) for rank, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"])]
    keys, ranks, ids = (np.array(x, np.int64) for x in zip(*sorted(merges)))
    single = np.zeros(256, np.int32)
    for char, b in of_char.items():
        single[b] = vocab[char]
    arrays = {
        "merge_keys": keys, "merge_ranks": ranks.astype(np.int32), "merge_ids": ids.astype(np.int32), "single": single,
        "shown": np.frombuffer(b"".join(raw), np.uint8), "shown_ends": np.cumsum([0, *map(len, raw)]), "classes": character_classes(),
    }
    return arrays, {"n": n, "special": special}


def compile_words(path: str, words: list[str]) -> bytes:
    """The file of a lexicon; the ids of its words are the library's, and merging them here must give the same."""
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    arrays, settings = vocabulary_arrays(path)
    ordered = sorted(w.encode() for w in set(words))
    ids = [e.ids for e in library.encode_batch([w.decode() for w in ordered], add_special_tokens=False)] if ordered else []
    arrays |= transducer(ordered)
    arrays |= {"ids": np.array([i for x in ids for i in x], np.int32), "id_ends": np.cumsum([0, *map(len, ids)])}
    blob = to_file(arrays, settings)
    merger = Merger(arrays, settings)
    for at in range(0, len(ordered), BLOCK_ROWS):
        for word, own, expected in zip(ordered[at : at + BLOCK_ROWS], merger.merged(ordered[at : at + BLOCK_ROWS]), ids[at : at + BLOCK_ROWS]):
            if own != np.array(expected, np.int32).tobytes():
                raise ValueError(f"ids differ from the library's for {word!r}")
    return blob


# --- Cutting and merging ----------------------------------------------------------------------------------------------


def cut_words(texts: list[str], classes: np.ndarray, special: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as bytes, the first byte and the length of each word, and the number of words of each text, by the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

    A special token is one word of its own, and the text before and after it is cut as a text.
    """
    segments, sizes, marked = texts, np.array([len(t) for t in texts], np.int64), []
    whole = "".join(texts)
    if special and any(s in whole for s in special):
        cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(special, key=len, reverse=True)) + ")").split
        parts = [[(p, i % 2) for i, p in enumerate(cut(t)) if p] for t in texts]
        segments = [p for x in parts for p, _ in x]
        marked = [m for x in parts for _, m in x]
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    data = np.frombuffer(whole.encode(), np.uint8)
    n = len(codes)
    kind = classes[codes]
    lengths = np.array([len(s) for s in segments], np.int64)
    begins = np.cumsum(lengths) - lengths
    begins_here = np.zeros(n + 1, bool)
    begins_here[begins] = True
    begins_here[n] = True
    for i in np.flatnonzero(marked):
        kind[begins[i] : begins[i] + lengths[i]] = SPECIAL
    first = begins_here[:n].copy()
    first[1:] |= kind[1:] != kind[:-1]
    starts = first.copy()
    run = np.flatnonzero(first)
    ends = np.append(run[1:], n)
    blank = (kind[run] == SPACE) & ~begins_here[ends]  # blanks before something else in the same text
    last = ends[blank] - 1
    starts[last] = True
    starts[ends[blank][codes[last] == 32]] = False
    lone = run[(kind[run] == OTHER) & (ends - run == 1)]
    lone = lone[(codes[lone] == 39) & starts[lone] & ~begins_here[lone + 1]]
    for ending in ENDINGS:
        here = lone[lone + len(ending) < n]
        for k, letter in enumerate(ending, 1):
            here = here[(codes[here + k] == ord(letter)) & ~begins_here[here + k]]
        starts[here + 1] = False
        after = here + len(ending) + 1
        starts[after[after < n]] = True
    at = np.flatnonzero(starts)
    per_text = np.searchsorted(at, np.cumsum(sizes)) - np.searchsorted(at, np.cumsum(sizes) - sizes)
    if len(data) != n:
        width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = (np.cumsum(width) - width)[at]
    return data, at, np.diff(np.append(at, len(data))), per_text


class Merger:
    """Exact merging of single words."""

    def __init__(self, arrays: dict[str, np.ndarray], settings: dict):
        self.n = settings["n"]
        self.keys, self.ranks, self.ids, self.single = (arrays[k] for k in ("merge_keys", "merge_ranks", "merge_ids", "single"))
        self.by_pair: dict[int, tuple[int, int]] | None = None

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each pair merges to; the rank is NONE where it doesn't."""
        wanted = left.astype(np.int64) * self.n + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], NONE), self.ids[at]

    def merged(self, words: list[bytes]) -> list[bytes]:
        """Packed 32-bit ids of each word."""
        out: list[bytes] = [b""] * len(words)
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT_WORD), key=lambda i: len(words[i]))
        for at in range(0, len(short), BLOCK_ROWS):
            block = short[at : at + BLOCK_ROWS]
            for i, ids in zip(block, self._block([words[i] for i in block])):
                out[i] = ids
        for i, word in enumerate(words):
            if len(word) > SHORT_WORD:
                out[i] = self._long(word)
        return out

    def _block(self, words: list[bytes]) -> list[bytes]:
        """Short words side by side: every round merges the best pair of each word that still has one."""
        sizes = np.array([len(w) for w in words])
        width = int(sizes.max(initial=1))
        symbols = np.full((len(words), width + 1), -1, np.int32)
        symbols[:, :width][np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(words), np.uint8)]
        ranks = self.pairs(symbols[:, :-1], symbols[:, 1:])[0]
        done, rows, columns = symbols.copy(), np.arange(len(words)), np.arange(width)
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of equal ranks
            each = np.arange(len(rows))
            live = ranks[each, best] != NONE
            if not live.all():
                done[rows[~live]] = symbols[~live]
                rows, symbols, ranks, best = rows[live], symbols[live], ranks[live], best[live]
                each = each[: len(rows)]
                if not len(rows):
                    break
            joined = self.pairs(symbols[each, best], symbols[each, best + 1])[1]
            source = columns + (columns > best[:, None])  # what stands right of the pair moves up by one
            symbols = np.concatenate([np.take_along_axis(symbols, source, 1), np.full((len(rows), 1), -1, np.int32)], axis=1)
            ranks = np.take_along_axis(np.concatenate([ranks, np.full((len(rows), 1), NONE)], axis=1), source, 1)
            symbols[each, best] = joined
            ranks[each, best] = self.pairs(joined, symbols[each, best + 1])[0]
            left = np.flatnonzero(best > 0)
            ranks[left, best[left] - 1] = self.pairs(symbols[left, best[left] - 1], joined[left])[0]
        sizes = (done >= 0).sum(axis=1).tolist()
        return [row[:k].tobytes() for row, k in zip(done, sizes)]

    def _long(self, word: bytes) -> bytes:
        """A long word by an agenda of (rank, place); an entry whose pair has changed is void."""
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.ids.tolist())))
        known, n = self.by_pair.get, self.n
        ids = self.single[np.frombuffer(word, np.uint8)].tolist()
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        agenda = [(hit[0], i) for i in range(len(ids) - 1) if (hit := known(ids[i] * n + ids[i + 1]))]
        heapq.heapify(agenda)
        while agenda:
            rank, i = heapq.heappop(agenda)
            j = after[i]
            if ids[i] < 0 or j < 0 or (hit := known(ids[i] * n + ids[j])) is None or hit[0] != rank:
                continue
            ids[i], ids[j] = hit[1], -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if more := known(ids[i] * n + ids[k]):
                    heapq.heappush(agenda, (more[0], i))
            if (h := before[i]) >= 0 and (more := known(ids[h] * n + ids[i])):
                heapq.heappush(agenda, (more[0], h))
        return np.array([i for i in ids if i >= 0], np.int32).tobytes()


class Lexicon:
    """A mapped file and the words that a worker has merged lately."""

    def __init__(self, path: str):
        self.arrays, settings = map_file(path)
        self.merger = Merger(self.arrays, settings)
        self.special, self.n = settings["special"], settings["n"]
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.special_raw = {s.encode(): np.array([i], np.int32).tobytes() for s, i in self.special.items()}

    def unseen(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words that the automaton lacks."""
        if len(self.cache) > CACHED_WORDS:
            self.older, self.cache = self.cache, {}
        missing = []
        for word in set(words) - self.cache.keys():
            kept = self.older.get(word)
            if kept is None:
                missing.append(word)
            else:
                self.cache[word] = kept
        self.cache.update(zip(missing, self.merger.merged(missing)))
        return [self.cache[w] for w in words]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the bounds of each text's."""
        data, starts, sizes, per_text = cut_words(texts, self.arrays["classes"], list(self.special))
        place = places(self.arrays, data, starts, sizes)
        new = np.flatnonzero(place < 0)
        raw = data.tobytes()
        words = [raw[a : a + k] for a, k in zip(starts[new].tolist(), sizes[new].tolist())]
        # Only a special token as a whole is a word of its bytes: the pattern cuts the same bytes elsewhere into several.
        packed = self.unseen(words)
        for i in [i for i, w in enumerate(words) if w in self.special_raw]:
            packed[i] = self.special_raw[words[i]]
        lent = np.array([len(p) // 4 for p in packed], np.int64)
        own, ends = self.arrays["ids"], self.arrays["id_ends"]
        table = np.concatenate([own, np.frombuffer(b"".join(packed), np.int32)])
        first, size = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        seen = place >= 0
        first[seen], size[seen] = ends[place[seen]], ends[place[seen] + 1] - ends[place[seen]]
        first[new], size[new] = len(own) + np.cumsum(lent) - lent, lent
        bounds = np.append(0, np.cumsum(size))
        ids = table[np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], size)]
        return ids, bounds[np.append(0, np.cumsum(per_text))]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """The texts of the ids between each two bounds."""
        known = (ids >= 0) & (ids < self.n)
        if not known.all():
            bounds = np.append(0, np.cumsum(known))[bounds]
            ids = ids[known]
        ends = self.arrays["shown_ends"]
        first, size = ends[ids], ends[ids + 1] - ends[ids]
        at = np.append(0, np.cumsum(size))
        raw = self.arrays["shown"][np.arange(at[-1]) + np.repeat(first - at[:-1], size)]
        bounds = at[bounds]
        whole = raw.tobytes()
        begins = bounds[:-1][bounds[:-1] < bounds[1:]]
        try:
            if ((raw[begins] & 0xC0) == 0x80).any():
                raise ValueError("a text begins within a character")
            whole.decode()
        except ValueError:
            return pa.array([whole[a:b].decode(errors="replace") for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.string())
        return pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(whole))


@lru_cache(maxsize=2)
def mapped(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


# --- Spark ------------------------------------------------------------------------------------------------------------


def count_words(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(word, n): words of all texts, cut where blanks stand and then by the pattern, and how often they occur."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, held = character_classes(), Counter()

        def flush():
            words = list(held)
            data, starts, sizes, per_word = cut_words([" " + w for w in words], classes, [])
            raw = data.tobytes()
            times, total = np.repeat(np.array([held[w] for w in words], np.int64), per_word).tolist(), Counter()
            for a, k, n in zip(starts.tolist(), sizes.tolist(), times):
                if k <= LEXICON_BYTES:
                    total[raw[a : a + k]] += n
            held.clear()
            return pa.record_batch({
                "word": pa.array([w.decode() for w in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())
            })

        for batch in batches:
            for value in batch.column(0):
                held.update((value.as_py() or "").split())
                if len(held) > COUNTED_WORDS:
                    yield flush()
        if held:
            yield flush()

    partial = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(counted, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def build(docs: DataFrame, path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Compile the ``size`` most frequent words of ``docs`` and hand the file to all executors; returns the name it has there."""
    frequent = count_words(docs, path, text).filter("n > 1").orderBy(F.desc("n"), "word").limit(size).select("word")

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = [w for b in batches for w in b.column(0).to_pylist()]
        if words:
            yield pa.record_batch({"file": pa.array([compile_words(path, words)], pa.binary())})

    row = frequent.coalesce(1).mapInArrow(compiled, "file binary").first()
    blob = bytes(row.file) if row else compile_words(path, [])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = os.path.join(SparkFiles.getRootDirectory(), name)
    with open(place, "wb") as f:
        f.write(blob)
    docs.sparkSession.sparkContext.addFile(place)
    return name


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches``, about ``SLICE_BYTES`` of texts or ids at a time."""
    for batch in batches:
        values = batch.column(column)
        each = pa.compute.list_value_length(values) if pa.types.is_list(values.type) else pa.compute.binary_length(values)
        sizes = np.cumsum(np.append(0, each.fill_null(0).to_numpy(zero_copy_only=False)))
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + SLICE_BYTES)) - 1)
            yield batch.slice(at, end - at)
            at = end


def encode(df: DataFrame, lexicon: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``df`` with the ids of the whole text in ``out`` (array of int, never null), and in ``decoded`` what they decode to."""
    df = df.drop(*[c for c in (out, decoded) if c and c != text])
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])
    if decoded:
        schema = schema.add(decoded, StringType())
    names, place = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = mapped(lexicon)
        for part in _slices(batches, place):
            ids, bounds = words.encode(part.column(place).cast(pa.string()).fill_null("").to_pylist())
            made = {out: pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))}
            if decoded:
                made[decoded] = words.decode(ids, bounds)
            yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*names, *made])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, lexicon: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``out`` (never null)."""
    df = df.drop(out)
    names, place = df.columns, df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = mapped(lexicon)
        for part in _slices(batches, place):
            lists = part.column(place)
            bounds = np.cumsum(np.append(0, pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
            flat = lists.flatten().cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns, words.decode(flat, bounds)], [*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))
