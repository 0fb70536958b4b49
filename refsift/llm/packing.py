"""Packing token ids into sequences of at most LIMIT, in order, by dynamic programming.

A document is its ids and then END. Cuts may fall at the end of every document (no penalty), at the end of every
sentence (SENTENCE) or, every STRIDE ids where neither is near, inside one (INSIDE). A sequence is padded to LIMIT unless
its length is a power of two, and costs its padding, the penalty of its last cut and EACH. The cheapest cuts of a block of
ids are found by best[j] = min over i of best[i] + cost(i, j): padding is linear in i, so the minimum over the window of
LIMIT ids comes from a monotone queue; lengths that are powers of two are further transitions.

Every input partition is packed by itself, in its order, with no shuffle. Blocks of about BLOCK ids are packed at a
time; the ids after a block's last full cut go on to the next, so memory is bounded by a block and a document.

Defined cases: null and empty texts are END alone; a text of any length is cut as often as needed; repeated rows are
packed as often as they occur; a null doc_id is carried through; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .bytebpe import ByteBPE, classes
from .common import tidy
from .textvec import SLICE, slices

LIMIT = 2048
END = 1
SENTENCE, INSIDE, EACH = 6, 24, 12
STRIDE = 64
BLOCK = 1 << 18

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut_places(total: int, document_ends: np.ndarray, sentence_ends: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Places (0 first, total last) where cuts may fall, and the penalty of each."""
    known = np.unique(np.concatenate([[0, total], document_ends, sentence_ends]))
    gaps = np.diff(known)
    more = (gaps - 1) // stride
    fill = np.repeat(known[:-1], more) + stride * (np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more) + 1)
    places = np.unique(np.concatenate([known, fill]))
    penalty = np.full(len(places), INSIDE, np.int64)
    penalty[np.searchsorted(places, sentence_ends)] = SENTENCE
    penalty[np.searchsorted(places, document_ends)] = 0
    penalty[-1] = 0
    return places, penalty


def best_cuts(places: np.ndarray, penalty: np.ndarray, limit: int = LIMIT) -> list[int]:
    """Indices into places of the cheapest cuts, the first 0 and the last len(places) - 1."""
    n = len(places)
    exact: list[list[int]] = [[] for _ in range(n)]
    power = 1
    while power <= limit:
        at = np.searchsorted(places, places - power)
        for j in np.flatnonzero((places[np.minimum(at, n - 1)] == places - power) & (places >= power)).tolist():
            exact[j].append(int(at[j]))
        power *= 2
    where, extra = places.tolist(), penalty.tolist()
    best, back = [0] * n, [0] * n
    queue: deque[int] = deque([0])  # indices i, best[i] + places[i] ascending
    for j in range(1, n):
        here = where[j]
        while here - where[queue[0]] > limit:
            queue.popleft()
        i = queue[0]
        cost = best[i] + limit - here + where[i]
        for k in exact[j]:
            if best[k] < cost:
                cost, i = best[k], k
        best[j], back[j] = cost + extra[j] + EACH, i
        level = best[j] + here
        while queue and best[queue[-1]] + where[queue[-1]] >= level:
            queue.pop()
        queue.append(j)
    cuts, j = [n - 1], n - 1
    while j:
        j = back[j]
        cuts.append(j)
    return cuts[::-1]


class Packer:
    """Takes documents one after another and gives rows (document, start, length, crc, tokens, sequence, offset, ids)."""

    def __init__(self, first_sequence: int, limit: int = LIMIT):
        self.limit = limit
        self.sequence = first_sequence
        self.parts: list[tuple] = []  # (document, place of ids in it, its tokens, ids, ends of sentences in ids)
        self.held = 0

    def add(self, document, ids: np.ndarray, sentence_ends: np.ndarray) -> Iterator[tuple]:
        self.parts.append((document, 0, len(ids), ids, sentence_ends))
        self.held += len(ids)
        if self.held >= BLOCK:
            yield from self.flush(last=False)

    def flush(self, last: bool = True) -> Iterator[tuple]:
        if not self.parts:
            return
        ends = np.cumsum([len(p[3]) for p in self.parts])
        begins = ends - np.array([len(p[3]) for p in self.parts])
        ids = np.concatenate([p[3] for p in self.parts])
        stops = np.concatenate([p[4] + b for p, b in zip(self.parts, begins.tolist(), strict=True)])
        places, penalty = cut_places(len(ids), ends, stops)
        cuts = places[best_cuts(places, penalty, self.limit)].tolist()
        done = len(cuts) - 1
        if not last:  # what follows decides about the last cuts: keep two full lengths
            while done > 1 and cuts[-1] - cuts[done] < 2 * self.limit:
                done -= 1
        part = 0
        for a, b in zip(cuts[:done], cuts[1 : done + 1], strict=True):
            offset = 0
            while offset < b - a:
                while ends[part] <= a + offset:
                    part += 1
                document, start, tokens, _, _ = self.parts[part]
                to = min(b, int(ends[part]))
                piece = ids[a + offset : to]
                yield (document, start + a + offset - int(begins[part]), len(piece), zlib.crc32(piece.tobytes()), tokens, self.sequence, offset, piece)
                offset += len(piece)
            self.sequence += 1
        left = cuts[done]
        rest = []
        for k in range(part, len(self.parts)):
            if ends[k] > left:
                document, start, tokens, own, marks = self.parts[k]
                skip = max(0, left - int(begins[k]))
                rest.append((document, start + skip, tokens, own[skip:], marks[marks > skip] - skip))
        self.parts = rest
        self.held = sum(len(p[3]) for p in rest)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, with_ids: bool = False) -> DataFrame:
    """One row per piece. tokenizer: path, on the driver, of a byte-level BPE of the tokenizers library."""
    with open(tokenizer, encoding="utf-8") as f:
        config = docs.sparkSession.sparkContext.broadcast((f.read(), classes()))
    field = docs.schema["doc_id"].dataType
    kind = to_arrow_type(field)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7])]
        if with_ids:
            arrays.append(pa.array([x.astype(np.int32) for x in columns[7]], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(arrays, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBPE(*config.value)
        packer = Packer(TaskContext.get().partitionId() << 40, limit)
        rows: list[tuple] = []
        for batch in batches:
            ids_of, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            sizes = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
            for i, j in slices(sizes, SLICE // 2):
                ids, at, stops = encoder.encode(texts[i:j])
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(END)).astype("<u4")
                    rows += packer.add(ids_of[i + k], own, np.flatnonzero(stops[at[k] : at[k + 1]]) + 1)
                if len(rows) >= 4096:
                    yield rows_of(rows)
                    rows = []
        rows += packer.flush()
        if rows:
            yield rows_of(rows)

    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {field.simpleString()}, {COLUMNS}{', ids array<int>' * with_ids}")
