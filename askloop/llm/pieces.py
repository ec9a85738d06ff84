"""SentencePiece encoding and decoding for merge-type vocabularies.

A score-ordered agenda of adjacent symbol pairs merges the best pair first, leftmost at equal scores, exactly as the
library does. A text is cut where no piece of the vocabulary can cross (before a word mark that follows another symbol,
and around line ends), so a cut is merged once while its ids stay in a worker's bounded cache. Short cuts are merged many at
a time: the agenda is then a matrix of pair scores with a row for each cut, which gives up its best pair in every round;
long cuts have a heap each. Every cut that enters the cache is compared with the sentencepiece library, a batch at a time;
a difference is an error.

Defined cases: a null or empty text has no ids and decodes to an empty text; null ids decode to an empty text; characters
outside the vocabulary become byte pieces; bytes that are no UTF-8 decode to U+FFFD each, ids outside the vocabulary are an
error. Texts of any length are taken whole. Rows keep all their columns, but a column with the name of a new
one is replaced; repeated rows and ids stay as they are.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from sentencepiece import sentencepiece_model_pb2 as model_pb

MARK = "▁"
CACHED_CUTS = 180_000
SHORT_CUT = 32
BLOCK_ROWS = 8_192
SLICE_BYTES = 1 << 20
_Piece = model_pb.ModelProto.SentencePiece


class Pieces:
    """One vocabulary with the cache of cuts already merged."""

    def __init__(self, path: str):
        proto = model_pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, trainer = proto.normalizer_spec, proto.trainer_spec
        if trainer.model_type != model_pb.TrainerSpec.BPE or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix:
            raise ValueError("a merge-type vocabulary with byte pieces and leading word marks is needed")
        if norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("texts must reach the vocabulary unchanged but for a leading word mark")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (_Piece.NORMAL, _Piece.USER_DEFINED, _Piece.UNUSED)
        if any(p.type in kinds[1:] for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _Piece.NORMAL}
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == _Piece.NORMAL}
        if any(MARK in piece.lstrip(MARK) or ("\n" in piece and piece != "\n") for piece in self.ids):
            raise ValueError("a piece crosses a word mark or a line end")
        bytes_of = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _Piece.BYTE}
        self.byte_ids = [bytes_of[f"<0x{b:02X}>"] for b in range(256)]
        self.shown = [self._shown(p) for p in proto.pieces]
        self.controls = {i for i, p in enumerate(proto.pieces) if p.type == _Piece.CONTROL}
        self.marked = {i for piece, i in self.ids.items() if piece.startswith(MARK)}
        self.cuts = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+").findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.lead = len(self.library.encode("\n"))
        self._number_symbols(len(proto.pieces))

    def _number_symbols(self, n: int) -> None:
        """Symbol numbers: a piece has its id, any other character ``n`` + its code point. Pairs sorted for look-up."""
        self.n = n
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i

        def number(symbol: str) -> int | None:
            known = self.ids.get(symbol)
            return n + ord(symbol) if known is None and len(symbol) == 1 else known

        pairs = {}
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                a, b = number(piece[:at]), number(piece[at:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = i
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ids = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.score_of = np.full(n, -np.inf, np.float32)
        for piece, score in self.scores.items():
            self.score_of[self.ids[piece]] = score

    @staticmethod
    def _shown(piece) -> bytes:
        if piece.type == _Piece.BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == _Piece.CONTROL:
            return b""
        if piece.type == _Piece.UNKNOWN:
            return " ⁇ ".encode()
        return piece.piece.replace(MARK, " ").encode()

    def merge(self, cut: str) -> list[int]:
        """Ids of one cut. The agenda holds (-score, left, right, joined length); a changed side makes an entry void."""
        symbols = list(cut)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        scores, agenda = self.scores, []
        for i in range(n - 1):
            score = scores.get(symbols[i] + symbols[i + 1])
            if score is not None:
                agenda.append((-score, i, i + 1, 2))
        heapq.heapify(agenda)
        while agenda:
            _, left, right, length = heapq.heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = a + b, ""
            following = after[right]
            after[left] = following
            if following >= 0:
                before[following] = left
            for one, two in ((before[left], left), (left, following)):
                if one >= 0 and two >= 0:
                    joined = symbols[one] + symbols[two]
                    score = scores.get(joined)
                    if score is not None:
                        heapq.heappush(agenda, (-score, one, two, len(joined)))
        out = []
        for symbol in filter(None, symbols):
            known = self.ids.get(symbol)
            if known is None:
                out.extend(self.byte_ids[b] for b in symbol.encode())
            else:
                out.append(known)
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The id and score of each pair's piece; the score is -inf where there is none."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = self.pair_keys[at] == keys
        ids = np.where(found, self.pair_ids[at], 0)
        return ids, np.where(found, self.score_of[ids], np.float32(-np.inf))

    def merge_block(self, cuts: list[str]) -> list[bytes]:
        """Packed ids of short cuts, merged side by side."""
        sizes = np.array([len(c) for c in cuts])
        width = int(sizes.max())
        filled = np.arange(width) < sizes[:, None]
        symbols = np.full((len(cuts), width), -1, np.int64)
        symbols[filled] = self.of_char[np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32)]
        scores = np.full((len(cuts), width), -np.inf, np.float32)
        if width > 1:
            held = filled[:, 1:]
            scores[:, :-1][held] = self._joined(symbols[:, :-1][held], symbols[:, 1:][held])[1]
        out, rows, columns = symbols.copy(), np.arange(len(cuts)), np.arange(width)
        while len(rows):
            best = scores.argmax(axis=1)  # the leftmost of equal scores
            live = scores[np.arange(len(rows)), best] > -np.inf
            if not live.all():
                out[rows[~live]] = symbols[~live]
                rows, symbols, scores, best = rows[live], symbols[live], scores[live], best[live]
                if not len(rows):
                    break
            each = np.arange(len(rows))
            merged, _ = self._joined(symbols[each, best], symbols[each, best + 1])
            moved = columns[None, :-1] > best[:, None]
            np.copyto(symbols[:, :-1], symbols[:, 1:].copy(), where=moved)
            np.copyto(scores[:, :-1], scores[:, 1:].copy(), where=moved)
            symbols[:, -1], scores[:, -1] = -1, -np.inf
            symbols[each, best] = merged
            following = symbols[each, np.minimum(best + 1, width - 1)]
            has = (best + 1 < width) & (following >= 0)
            scores[each, best] = -np.inf
            scores[each[has], best[has]] = self._joined(merged[has], following[has])[1]
            has = best > 0
            scores[each[has], best[has] - 1] = self._joined(symbols[each[has], best[has] - 1], merged[has])[1]
        sizes = (out >= 0).sum(axis=1).tolist()
        packed, odd = out.astype(np.int32), (out >= self.n).any(axis=1).tolist()
        return [
            np.array(self._with_bytes(row[:k].tolist()), np.int32).tobytes() if o else row[:k].tobytes()
            for row, k, o in zip(packed, sizes, odd)
        ]

    def _with_bytes(self, symbols: list[int]) -> list[int]:
        out = []
        for s in symbols:
            out.extend([s] if s < self.n else [self.byte_ids[b] for b in chr(s - self.n).encode()])
        return out

    def learn(self, cuts: list[str]) -> dict[str, bytes]:
        """Merge new cuts, compare them with the library and return their packed ids."""
        short = sorted((c for c in cuts if len(c) <= SHORT_CUT), key=len)
        found = {c: np.array(self.merge(c), np.int32).tobytes() for c in cuts if len(c) > SHORT_CUT}
        for i in range(0, len(short), BLOCK_ROWS):
            block = short[i : i + BLOCK_ROWS]
            found.update(zip(block, self.merge_block(block)))
        for i in range(0, len(cuts), BLOCK_ROWS):
            block = cuts[i : i + BLOCK_ROWS]
            expected = self.library.encode(["\n" + c for c in block], num_threads=1)
            checked = np.fromiter(chain.from_iterable(x[self.lead :] for x in expected), np.int32)
            sizes = np.array([len(x) - self.lead for x in expected])
            if (sizes * 4 != [len(found[c]) for c in block]).any() or checked.tobytes() != b"".join(map(found.get, block)):
                wrong = [c for c, x in zip(block, expected) if np.array(x[self.lead :], np.int32).tobytes() != found[c]]
                raise ValueError(f"ids differ from the library's for {wrong[0][:100]!r}")
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Packed 32-bit ids of each text."""
        cut_texts = [self.cuts(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.cache) > CACHED_CUTS:
            self.older, self.cache = self.cache, {}
        known = self.cache
        missing = {cut for cuts in cut_texts for cut in cuts if cut not in known}
        if missing:
            for cut in [c for c in missing if c in self.older]:
                known[cut] = self.older[cut]
                missing.discard(cut)
            known.update(self.learn(list(missing)))
        return [b"".join(map(known.__getitem__, cuts)) for cuts in cut_texts]

    def decode(self, ids: list[int]) -> str:
        if ids and min(ids) < 0:
            raise ValueError("ids must not be negative")
        if not self.controls.isdisjoint(ids):  # they show nothing, but end a run of byte pieces
            parts = [[]]
            for i in ids:
                parts.append([]) if i in self.controls else parts[-1].append(i)
            parts = [p for p in parts if p]
            return "".join([self._text(p, k == 0) for k, p in enumerate(parts)])
        return self._text(ids, True)

    def _text(self, ids: list[int], first: bool) -> str:
        raw = b"".join(map(self.shown.__getitem__, ids))
        if first and ids and ids[0] in self.marked:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _replaced(raw)


def _replaced(raw: bytes) -> str:
    """UTF-8 with U+FFFD for every single byte that starts no valid character."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as e:
            out += [raw[at : at + e.start].decode(), "�"]
            at += e.start + 1
    return "".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


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


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids", decoded: str | None = None, linger: bool = True) -> DataFrame:
    """``df`` with the ids of the whole text in ``out`` (array of int, never null), and in ``decoded`` what they decode to.

    Workers keep their merged cuts from task to task, unless ``linger`` is False, as where they serve other stages after this.
    """
    df = df.drop(*[c for c in (out, decoded) if c and c != text])
    schema = StructType([*df.schema.fields, StructField(out, ArrayType(IntegerType()))])
    if decoded:
        schema = schema.add(decoded, StringType())
    names, place = df.columns, df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for part in _slices(batches, place):
            packed = vocabulary.encode(part.column(place).to_pylist())
            flat, ends = np.frombuffer(b"".join(packed), np.int32), np.cumsum([0, *(len(p) // 4 for p in packed)])
            made = {out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))}
            if decoded:
                made[decoded] = _texts(vocabulary, flat, ends)
            yield pa.RecordBatch.from_arrays([*part.columns, *made.values()], [*names, *made])
        if not linger:
            vocabulary.cache, vocabulary.older = {}, {}

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids in ``out`` (never null)."""
    df = df.drop(out)
    names, place = df.columns, df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pieces(path)
        for part in _slices(batches, place):
            lists = part.column(place)
            ends = np.cumsum(np.append(0, pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)))
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*part.columns, _texts(vocabulary, flat, ends)], [*names, out])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField(out, StringType())]))


def _texts(vocabulary: Pieces, flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.array([vocabulary.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())
