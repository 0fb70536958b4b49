"""Ids of a byte-level BPE tokenizer for many texts at once.

Texts are cut into the tokenizer's pre-tokens with numpy; each distinct pre-token of a slice is encoded once
and its ids are copied to all its places. Where the merges of the tokenizer's JSON are in the order of the ids they
make, as is usual, merging by lowest id gives the same ids, and a pre-token goes to the faster `tiktoken` merger built
from that JSON; otherwise it goes to the `tokenizers` library. The cut follows the usual pattern of byte-level BPE
(contractions, then letters, digits or other signs with one space before them, then white space but for the last sign
before a word). Texts with an apostrophe (contractions) or with unassigned code points (whose class depends on the
Unicode version) go to the library whole.
"""

from __future__ import annotations

import os
import unicodedata
from itertools import chain, repeat

import numpy as np

from .textvec import U64, codepoints, run_hashes

SPACE, LETTER, NUMBER, OTHER, UNSURE = range(5)
_BLANKS = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Distinct pre-tokens remembered between slices.
REMEMBERED = 300_000
#: Signs after which a sentence may end.
STOPS = frozenset(".!?\n")


def classes() -> np.ndarray:
    """The class of every code point. Made once, on the driver, and sent to tasks beside the tokenizer."""
    by = {"L": LETTER, "N": NUMBER}
    out = np.empty(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))
        out[c] = UNSURE if kind == "Cn" else by.get(kind[0], OTHER)
    out[_BLANKS] = SPACE
    out[ord("'")] = UNSURE
    return out


def pretoken_starts(cps: np.ndarray, kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens start. kind: the class of each code point."""
    n = len(cps)
    head = np.zeros(n, bool)
    head[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    # a run of words signs after white space of the same text: the last blank starts a pre-token
    after = np.flatnonzero(run & ~head & (kind != SPACE))
    after = after[kind[after - 1] == SPACE]
    joined = after[cps[after - 1] == 0x20]
    run[after - 1] = True
    run[joined] = False
    return np.flatnonzero(run)


def byte_letters() -> dict[str, int]:
    """The usual printable stand-ins of byte-level vocabularies: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merger(config: str):
    """A merger by lowest id, or None where it could give other ids than the merges of the JSON."""
    import json

    from tiktoken._tiktoken import CoreBPE

    model = json.loads(config)["model"]
    vocab, merges = model["vocab"], [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocab.get(a + b) for a, b in merges]
    letters = byte_letters()
    if None in made or made != sorted(made) or len(set(made)) < len(made) or not all(x in vocab for x in letters):
        return None
    single = {x: vocab[x] for x in letters}
    if made and max(single.values()) > made[0]:
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in [*single.items(), *((a + b, vocab[a + b]) for a, b in merges)]}
    return CoreBPE(ranks, {}, r"\S+|\s+")


class Remembered:
    """Ids of text segments: each distinct one is encoded once, until `most` are held."""

    most = REMEMBERED

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.at, self.stop = np.zeros(0, "<u4"), np.zeros(1, np.int64), np.zeros(0, bool)

    def fresh(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of segments one after another, and how many each has."""
        raise NotImplementedError

    def places(self, segments: list[str]) -> np.ndarray:
        """Where at, flat and stop hold each segment."""
        place = np.fromiter(map(self.known.get, segments, repeat(-1)), np.int64, len(segments))
        new = np.flatnonzero(place < 0)
        if len(new):
            if len(self.known) + len(new) > self.most:
                self._forget()
                new = np.arange(len(segments))
            unseen = [segments[i] for i in new.tolist()]
            flat, sizes = self.fresh(unseen)
            base = len(self.known)
            place[new] = np.arange(base, base + len(new))
            self.known.update(zip(unseen, range(base, base + len(new)), strict=True))
            self.flat = np.concatenate([self.flat, flat])
            self.at = np.concatenate([self.at, self.at[-1] + np.cumsum(sizes)])
            self.stop = np.concatenate([self.stop, np.fromiter((not STOPS.isdisjoint(p) for p in unseen), bool, len(unseen))])
        return place

    def segments(self, whole: str, cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids of all segments of a text cut at starts, the places in them where each segment begins, and its place."""
        hashes = run_hashes((cps.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15), starts)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        ends = np.append(starts[1:], len(cps))
        place = self.places([whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])[inverse]
        begin = self.at[place]
        per = self.at[place + 1] - begin
        out_at = np.concatenate([[0], np.cumsum(per)])
        ids = self.flat[np.arange(out_at[-1], dtype=np.int32) + np.repeat((begin - out_at[:-1]).astype(np.int32), per)]
        return ids, out_at, place


class ByteBPE(Remembered):
    """encode(): ids of all texts, one after another; offsets of the texts; where a sentence ends."""

    def __init__(self, config: str, kinds: np.ndarray | None = None):
        """config: the tokenizer's JSON; kinds: what classes() gives."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(config)
        self.library.encode_special_tokens = True
        self.merger = _merger(config)
        self.kinds = classes() if kinds is None else kinds
        super().__init__()

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def fresh(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.merger is None:
            found = self._ids(segments)
        else:
            one = self.merger.encode_single_piece
            found = [one(p.encode("utf-8", "surrogatepass")) for p in segments]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", sizes.sum()), sizes

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids (uint32) of all texts; n + 1 offsets into them; for each id whether a sentence may end after it."""
        cps, offsets = codepoints(texts)
        kind = self.kinds[cps]
        odd = np.zeros(len(texts), bool)
        strange = np.flatnonzero(kind == UNSURE)
        odd[np.searchsorted(offsets, strange, "right") - 1] = True
        starts = pretoken_starts(cps, kind, offsets)
        whole = "".join(texts)
        if len(starts):
            ids, out_at, place = self.segments(whole, cps, starts)
            stops = np.zeros(len(ids), bool)
            stops[out_at[1:][self.stop[place]] - 1] = True
            text_at = out_at[np.searchsorted(starts, offsets)]
        else:
            ids, stops, text_at = np.zeros(0, "<u4"), np.zeros(0, bool), np.zeros(len(texts) + 1, np.int64)
        if not odd.any():
            return ids, text_at, stops
        place = np.flatnonzero(odd)
        again = {i: np.array(x, "<u4") for i, x in zip(place.tolist(), self._ids([texts[i] for i in place]), strict=True)}
        dots = np.array([i for i in range(self.library.get_vocab_size()) if not STOPS.isdisjoint((self.library.id_to_token(i) or "").replace("Ċ", "\n"))], np.int64)
        parts, marks = [], []
        for i in range(len(texts)):
            part = again.get(i, ids[text_at[i] : text_at[i + 1]])
            parts.append(part)
            marks.append(np.isin(part, dots) if i in again else stops[text_at[i] : text_at[i + 1]])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.concatenate(marks)
