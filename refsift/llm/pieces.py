"""SentencePiece encoding and decoding by a streaming Viterbi search.

A text gets one space in front and every space becomes the sign U+2581. For every place of the text the search keeps
the best path to it, as the last piece and where that starts. In a unigram model the best path has the largest sum of
scores (of equal sums the earlier start). A BPE model's scores are merge ranks, not costs; there, the merges of a text's
beginning are its only valid path, and a piece may follow another exactly if merging the two pieces' text gives the two
back. So the step from piece to piece is allowed or not, each place has one surviving path, and the ids are those of
the library's merges. Which pairs are allowed is asked of the library once and remembered.

The search keeps a window of the longest piece's length. As soon as all surviving paths run through one boundary, the
ids before it are committed and forgotten, so memory is bounded however long the text. Two kinds of boundary are known
beforehand: none of the model's pieces runs from another sign into U+2581, and none holds a code point that it does
not know; such a code point stands as its UTF-8 bytes. Between such boundaries the search depends on the segment only,
so each distinct segment of a slice is searched once: short segments of common code points many at a time in numpy,
others by `Stream`.

Defined cases: null and empty texts have no ids; white space of any kind and U+2581 itself come back unchanged;
repeated rows get equal ids; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bytebpe import Remembered
from .common import tidy
from .textvec import SLICE, U64, codepoints, slices, string_buffers

MARK = 0x2581
#: Stands for a U+2581 of the text itself; private, and in no vocabulary.
ESCAPED = 0x10FFFF
UNKNOWN = 10.0
UNIGRAM, BPE = 1, 2
#: Remembered answers about pairs of pieces (a power of two).
PAIRS = 1 << 21
#: Segments up to so many code points are searched together.
SHORT = 64
COMMON = 255


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _as_varint(value: int) -> bytes:
    out = b""
    while value > 127:
        out += bytes([value & 127 | 128])
        value >>= 7
    return out + bytes([value])


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """Number, wire type and value of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 2:
            size, at = _varint(data, at)
            value: bytes | int = data[at : at + size]
            at += size
        elif tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = 4 if tag & 7 == 5 else 8
            value = data[at : at + size]
            at += size
        yield tag >> 3, tag & 7, value


def model_type(proto: bytes) -> int:
    """trainer_spec.model_type: field 3 of field 2; a unigram model where it is absent."""
    for number, _, value in _fields(proto):
        if number == 2:
            return next((v for n, _, v in _fields(value) if n == 3), UNIGRAM)
    return UNIGRAM


def without_prefix(proto: bytes) -> bytes:
    """The model with normalizer_spec.add_dummy_prefix (field 3 of field 3) off; the last value of a field holds."""
    out = b""
    for number, wire, value in _fields(proto):
        if wire != 2:
            raise ValueError("not a SentencePiece model")
        body = value + b"\x18\x00" if number == 3 else value
        out += _as_varint(number << 3 | wire) + _as_varint(len(body)) + body
    return out


class Vocabulary:
    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_proto=proto)
        size = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.scores = np.array([sp.get_score(i) for i in range(size)])
        self.bytes_of: list[bytes] = [b""] * size
        self.byte_id = [-1] * 256
        for i in range(size):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.bytes_of[i] = piece.replace("▁", " ").encode()
        if min(self.byte_id) < 0:
            raise ValueError("the model has no byte pieces")
        self.longest = max(map(len, self.ids))
        self.size = size
        self.unknown = float(min(self.scores[i] for i in self.ids.values())) - UNKNOWN
        self.merges = None
        if (kind := model_type(proto)) == BPE:
            self.scores[:] = self.unknown = 0.0
            self.merges = SentencePieceProcessor(model_proto=without_prefix(proto))
            self.name = {i: p for p, i in self.ids.items()}
            self.asked: dict[tuple[int, int], bool] = {}
        elif kind != UNIGRAM:
            raise ValueError("neither a unigram nor a BPE model")
        self.letters = frozenset(c for p in self.ids for c in p)
        self.mark_only_leads = not any("▁" in p.lstrip("▁") for p in self.ids)

    def pairs(self, pairs: list[tuple[int, int]]) -> list[bool]:
        """Whether the second piece may follow the first."""
        texts = [self.name[a] + self.name[b] for a, b in pairs]
        return [got == [a, b] for got, (a, b) in zip(self.merges.encode(texts, num_threads=1), pairs, strict=True)]

    def follows(self, last: int, piece: int) -> bool:
        if self.merges is None or last < 0:
            return True
        if (last, piece) not in self.asked:
            if len(self.asked) >= PAIRS:
                self.asked.clear()
            self.asked[last, piece] = self.merges.encode(self.name[last] + self.name[piece]) == [last, piece]
        return self.asked[last, piece]

    def spelled(self, char: str) -> list[int]:
        """A code point as byte pieces."""
        return [self.byte_id[b] for b in ("▁" if ord(char) == ESCAPED else char).encode()]


class Stream:
    """The search for one text that comes in parts."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.text = ""  # the window: signs after the last commit
        self.best = [0.0]
        #: (start, id or -1 for bytes) for each place of the window; at the window's start the last committed id
        self.back: list[tuple[int, int]] = [(0, -1)]

    def _search(self) -> None:
        v, text = self.v, self.text
        for j in range(len(self.best), len(text) + 1):
            best, back = -np.inf, (j - 1, -1)
            for i in range(max(0, j - v.longest), j):
                piece = v.ids.get(text[i:j])
                if piece is not None:
                    cost = self.best[i] + v.scores[piece]
                    if cost > best and v.follows(self.back[i][1], piece):
                        best, back = cost, (i, piece)
            if text[j - 1] not in v.ids and self.best[j - 1] + v.unknown > best:
                best, back = self.best[j - 1] + v.unknown, (j - 1, -1)
            self.best.append(best)
            self.back.append(back)

    def _path(self, end: int) -> list[int]:
        out: list[int] = []
        while end:
            start, piece = self.back[end]
            out += [piece] if piece >= 0 else reversed(self.v.spelled(self.text[start]))
            end = start
        return out[::-1]

    def _boundary(self) -> int:
        """The last place that the paths to every open end run through. Open are the places from which a piece may
        still reach signs to come: the last `longest` ones."""
        places = set(range(max(0, len(self.text) - self.v.longest + 1), len(self.text) + 1))
        while len(places) > 1:
            last = max(places)
            places.discard(last)
            places.add(self.back[last][0])
        return places.pop()

    def feed(self, part: str) -> list[int]:
        """Takes signs (spaces already U+2581) and gives the ids that are certain by now."""
        out: list[int] = []
        for at in range(0, len(part), 4 * self.v.longest):
            self.text += part[at : at + 4 * self.v.longest]
            self._search()
            at_boundary = self._boundary()
            if at_boundary:
                out += self._path(at_boundary)
                lower = self.best[at_boundary]
                self.text = self.text[at_boundary:]
                self.best = [b - lower for b in self.best[at_boundary:]]
                last = self.back[at_boundary][1]
                self.back = [(0, last), *((i - at_boundary, p) for i, p in self.back[at_boundary + 1 :])]
        return out

    def end(self) -> list[int]:
        return self._path(len(self.text))


class Coder(Remembered):
    """encode() and decode() of many texts."""

    def __init__(self, proto: bytes):
        super().__init__()
        v = self.v = Vocabulary(proto)
        known = np.zeros(0x110000, bool)
        known[[ord(c) for c in v.letters]] = True
        self.known_cp = known
        singles = sorted((c for c in v.letters if c in v.ids), key=lambda c: (c != "▁", v.ids[c]))[:COMMON]
        self.pair_key, self.pair_ok = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        self.column = np.zeros(0x110000, np.uint8)
        self.column[[ord(c) for c in singles]] = np.arange(1, len(singles) + 1)
        self._trie({c: k + 1 for k, c in enumerate(singles)})
        self.piece_bytes = np.frombuffer(b"".join(v.bytes_of), np.uint8)
        self.piece_at = np.concatenate([[0], np.cumsum([len(b) for b in v.bytes_of])])

    def _trie(self, columns: dict[str, int]) -> None:
        """Steps of the tree of all pieces of common code points; 0 is the root and, as a target, no step."""
        steps: dict[tuple[int, int], int] = {}
        piece_of = [-1]
        for piece, i in self.v.ids.items():
            if all(c in columns for c in piece):
                state = 0
                for c in piece:
                    nxt = steps.get((state, columns[c]))
                    if nxt is None:
                        nxt = steps[state, columns[c]] = len(piece_of)
                        piece_of.append(-1)
                    state = nxt
                piece_of[state] = i
        self.steps = np.zeros((len(piece_of), COMMON + 1), np.uint16 if len(piece_of) < 65536 else np.int32)
        for (s, c), t in steps.items():
            self.steps[s, c] = t
        self.steps = self.steps.ravel()
        self.piece_of = np.array(piece_of, np.int32)

    def _follow(self, last: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether each piece may follow the other; answers are remembered in a table of PAIRS places."""
        key = last.astype(np.int64) * self.v.size + piece
        slot = ((key.astype(U64) * U64(0x9E3779B97F4A7C15)) >> U64(20)).astype(np.int64) & (PAIRS - 1)
        out = self.pair_ok[slot]
        new = np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            some, first, inverse = np.unique(key[new], return_index=True, return_inverse=True)
            found = np.array(self.v.pairs([divmod(k, self.v.size) for k in some.tolist()]))
            out[new] = found[inverse]
            self.pair_key[slot[new[first]]], self.pair_ok[slot[new[first]]] = some, found
        return out

    def _together(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of short segments of common code points."""
        cps, at = codepoints(segments)
        lengths = np.diff(at)
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], at[:-1][order]
        n, most = len(segments), int(lengths[0])
        columns = np.concatenate([self.column[cps], np.zeros(most, np.uint8)])
        best = np.full((most + 1, n), -np.inf)
        best[0] = 0.0
        back, piece = np.zeros((most + 1, n), np.int16), np.zeros((most + 1, n), np.int32)
        for i in range(most):
            lanes = np.arange(int(np.searchsorted(-lengths, -i, "left")))
            state = np.zeros(len(lanes), np.int64)
            for d in range(min(self.v.longest, most - i)):
                if d:
                    inside = lengths[lanes] > i + d
                    lanes, state = lanes[inside], state[inside]
                state = self.steps[state * (COMMON + 1) + columns[starts[lanes] + i + d]].astype(np.int64)
                going = state > 0
                lanes, state = lanes[going], state[going]
                if not len(lanes):
                    break
                found = self.piece_of[state]
                full = np.flatnonzero(found >= 0)
                at_lane, what = lanes[full], found[full]
                cost = best[i, at_lane] + self.v.scores[what]
                better = cost > best[i + d + 1, at_lane]
                if i and self.v.merges is not None:
                    asked = np.flatnonzero(better)
                    better[asked] = self._follow(piece[i, at_lane[asked]], what[asked])
                at_lane = at_lane[better]
                best[i + d + 1, at_lane] = cost[better]
                back[i + d + 1, at_lane] = i
                piece[i + d + 1, at_lane] = what[better]
        ids = np.zeros((most, n), np.uint32)
        counts = np.zeros(n, np.int64)
        end, lanes = lengths.copy(), np.arange(n)
        while len(lanes):
            ids[most - 1 - counts[lanes], lanes] = piece[end[lanes], lanes]
            counts[lanes] += 1
            end[lanes] = back[end[lanes], lanes]
            lanes = lanes[end[lanes] > 0]
        per = np.empty(n, np.int64)
        per[order] = counts
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        out_at = np.cumsum(per) - per
        within = np.arange(per.sum()) - np.repeat(out_at, per)
        return ids[most - np.repeat(per, per) + within, np.repeat(rank, per)].astype("<u4"), per

    def _alone(self, segment: str) -> list[int]:
        if len(segment) == 1 and segment not in self.v.letters:
            return self.v.spelled(segment)
        stream = Stream(self.v)
        return stream.feed(segment) + stream.end()

    def fresh(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, segments), np.int64, len(segments))
        cps, at = codepoints(segments)
        rare = np.concatenate([[0], np.cumsum(self.column[cps] == 0)])
        easy = (sizes <= SHORT) & (rare[at[1:]] == rare[at[:-1]])
        counts = np.zeros(len(segments), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        step = 1 << 15
        place = np.flatnonzero(easy)
        for i in range(0, len(place), step):
            some = place[i : i + step]
            ids, per = self._together([segments[k] for k in some.tolist()])
            counts[some] = per
            parts.append((some, ids))
        alone = {k: np.array(self._alone(segments[k]), "<u4") for k in np.flatnonzero(~easy).tolist()}
        for k, ids in alone.items():
            counts[k] = len(ids)
        out_at = np.concatenate([[0], np.cumsum(counts)])
        flat = np.zeros(out_at[-1], "<u4")
        for some, ids in parts:
            per = counts[some]
            flat[np.arange(len(ids)) + np.repeat(out_at[some] - (np.cumsum(per) - per), per)] = ids
        for k, ids in alone.items():
            flat[out_at[k] : out_at[k + 1]] = ids
        return flat, counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids (uint32) of all texts, and the n + 1 offsets into them."""
        raw, _ = codepoints(full := [" " + t if t else "" for t in texts])
        lengths = np.fromiter(map(len, full), np.int64, len(full))
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        cps = raw.copy()
        cps[raw == MARK] = ESCAPED
        cps[raw == 0x20] = MARK
        if not len(cps):
            return np.zeros(0, "<u4"), np.zeros(len(texts) + 1, np.int64)
        head = np.zeros(len(cps), bool)
        head[offsets[:-1][lengths > 0]] = True
        cut = head.copy()
        strange = ~self.known_cp[cps]
        cut |= strange
        cut[1:] |= strange[:-1]
        if self.v.mark_only_leads:
            cut[1:] |= (cps[1:] == MARK) & (cps[:-1] != MARK)
        starts = np.flatnonzero(cut)
        ids, out_at, _ = self.segments(cps.tobytes().decode("utf-32-le", "surrogatepass"), cps, starts)
        return ids, out_at[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts, and the n + 1 offsets into them; the space in front is gone."""
        per = np.diff(self.piece_at)[ids]
        out_at = np.concatenate([[0], np.cumsum(per)])
        data = self.piece_bytes[np.arange(out_at[-1]) + np.repeat(self.piece_at[:-1][ids] - out_at[:-1], per)]
        at = out_at[offsets]
        keep = np.ones(len(data), bool)
        heads = at[:-1][at[:-1] < at[1:]]
        keep[heads] = False
        return data[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def encode(docs: DataFrame, model: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_sha256, round_trip (and ids): one row per row of docs.

    model: path, on the driver, of a SentencePiece model with byte pieces. decoded_sha256 is of the text that decoding
    the ids gives, round_trip whether that is the text itself."""
    with open(model, "rb") as f:
        proto = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(proto.value)
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for i, j in slices(offsets, 2 * SLICE):
                ids, at = coder.encode(texts[i:j])
                back, back_at = coder.decode(ids, at)
                same, crc, sha = [], [], []
                for k in range(j - i):
                    decoded = back[back_at[k] : back_at[k + 1]].tobytes()
                    same.append(decoded == data[offsets[i + k] : offsets[i + k + 1]].tobytes())
                    crc.append(zlib.crc32(ids[at[k] : at[k + 1]].tobytes()))
                    sha.append(hashlib.sha256(decoded).hexdigest())
                arrays = [batch.column(0).slice(i, j - i), pa.array(np.diff(at)), pa.array(crc, pa.int64()), pa.array(sha), pa.array(same)]
                if with_ids:
                    arrays.append(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean{', ids array<int>' * with_ids}")
