"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how often over the corpus.

A text is encoded by a byte-level BPE (A, with a space in front) and a SentencePiece model (B, which adds the space
itself), without special tokens. Places in the bytes where tokens of both end cut them into groups. An A and a B token
whose byte ranges overlap are linked; since no token is empty, each stretch between two ends of either is one link.

A pair of ids is one 64-bit key, B's id in the upper half. Each task adds up the keys of its texts by np.unique, HELD
different ones at most before it hands them on; these partial counts are range-partitioned by key and sorted, and equal
neighbours are summed. The counts, in key order, are written as shards, and every shard once more as a plain array of
sorted keys and counts that tasks map into memory. The keys of some texts are looked up there by searchsorted, so a task
holds no more than its own keys, however many pairs the corpus has. The highest count of each B id is an array of the
vocabulary's size.

Tokens are written once, to the shared folder, and read by both the count and the look-up. Where that folder is no
mounted path, executors fetch the shards through Spark (addFile) and map their own copies.

Defined cases: null and empty texts, and those whose tokens' joined bytes of A or B are not the text with a space in
front, have no tokens: zeros and an empty digest; special tokens' strings are plain text; a text of any length is one
row; repeated rows count as often as they occur; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable, Iterator
from itertools import chain
from urllib.parse import unquote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import ByteBPE, byte_letters, classes
from .common import Workspace, shipped, tidy
from .pieces import MARK, Coder
from .textvec import SLICE, slices, string_buffers

#: Segments whose ids each tokenizer remembers; two of them share a task's memory.
REMEMBERED = 100_000
#: Different keys that a task holds.
HELD = 1 << 20
#: Partial counts a shard, and shards at most.
SHARD_ROWS, MOST_SHARDS = 1 << 20, 8192


class Bytes:
    """What each id of a vocabulary spells."""

    def __init__(self, spelled: list[bytes]):
        self.data = np.frombuffer(b"".join(spelled), np.uint8)
        self.sizes = np.array([len(b) for b in spelled], np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.sizes)])

    def join(self, ids: np.ndarray) -> np.ndarray:
        return _gather(self.data, self.at[:-1][ids], self.sizes[ids])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The pieces of data one after another."""
    before = np.cumsum(sizes) - sizes
    return data[np.repeat(starts - before, sizes) + np.arange(sizes.sum())]


def byte_level(tokenizer: ByteBPE) -> Bytes:
    letters = byte_letters()
    names = (tokenizer.library.id_to_token(i) or "" for i in range(tokenizer.library.get_vocab_size()))
    return Bytes([bytes(letters.get(c, 0) for c in name) for name in names])


class Pieces(Coder):
    """The library's ids, segment by segment: it finds those of a new segment sooner than the search that this class has
    of its own, and here the ids alone count."""

    def __init__(self, proto: bytes):
        super().__init__(proto)
        if self.v.merges is not None:
            self.pair_key = self.pair_ok = None  # the search's own memory

    def fresh(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.v.merges is None:
            return super().fresh(segments)
        found = self.v.merges.encode(segments, num_threads=1)
        for k, segment in enumerate(segments):
            if len(segment) == 1 and segment not in self.v.letters:  # as its bytes
                found[k] = self.v.spelled(segment)
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), "<u4", sizes.sum()), sizes


class Aligner:
    """Tokens of both kinds for many texts at once."""

    def __init__(self, config: str, proto: bytes, kinds: np.ndarray | None = None):
        self.a, self.b = ByteBPE(config, kinds), Pieces(proto)
        self.a.most = self.b.most = REMEMBERED
        self.spelled = byte_level(self.a), Bytes(self.b.v.bytes_of)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids (int32) and the n + 1 places where texts begin, of A and of B; none where joined bytes differ."""
        # the library takes U+2581 for a space, so a text that holds one doesn't come back
        usable = [t if t and chr(MARK) not in t else "" for t in texts]
        whole = [" " + t if t else "" for t in usable]
        found = [self.a.encode(whole)[:2], self.b.encode(usable)]
        data, offsets = string_buffers(pa.array(whole, pa.string()))
        good = np.array([bool(t) for t in usable])
        for k, ((ids, at), spelled) in enumerate(zip(found, self.spelled, strict=True)):
            made = np.concatenate([[0], np.cumsum(spelled.sizes[ids])])[at]
            if k == 0 and np.array_equal(made, offsets):  # byte-level tokens are the text's bytes, if all are there
                continue
            joined = spelled.join(ids)
            if not np.array_equal(made, offsets) or not np.array_equal(joined, data):
                good &= np.array([np.array_equal(joined[made[i] : made[i + 1]], data[offsets[i] : offsets[i + 1]]) for i in range(len(texts))])
        out = []
        for ids, at in found:
            sizes = np.where(good, np.diff(at), 0)
            out.append((ids[np.repeat(good, np.diff(at))].astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])))
        return out


class Aligned:
    """Groups and links of texts one after another."""

    def __init__(self, spelled: tuple[Bytes, Bytes], a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray):
        self.a, self.b, self.a_at, self.b_at = a, b, a_at, b_at
        self.a_ends, self.b_ends = np.cumsum(spelled[0].sizes[a]), np.cumsum(spelled[1].sizes[b])
        whole = int(self.a_ends[-1]) + 1 if len(a) else 1
        # a mark at each place where a token ends
        self.a_marks, self.b_marks = np.zeros(whole, bool), np.zeros(whole, bool)
        self.a_marks[self.a_ends], self.b_marks[self.b_ends] = True, True
        self.upto = np.cumsum(self.a_marks & self.b_marks, dtype=np.int32)
        text_ends = np.concatenate([[0], self.a_ends])[a_at[1:]]
        self.groups = np.diff(self.upto[text_ends], prepend=0).astype(np.int64)
        self.links = np.diff(a_at) + np.diff(b_at) - self.groups

    def keys(self) -> np.ndarray:
        """A key for each link, text by text."""
        ends = np.flatnonzero(self.a_marks | self.b_marks)
        a = np.cumsum(self.a_marks, dtype=np.int32)[ends] - self.a_marks[ends]
        b = np.cumsum(self.b_marks, dtype=np.int32)[ends] - self.b_marks[ends]
        return self.b[b].astype(np.int64) << 32 | self.a[a]

    def written(self, digits: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3` of all texts, and the n + 1 offsets. digits: of each id five signs, and how many count."""
        n, m = len(self.a), len(self.b)
        both = self.a_marks & self.b_marks
        group_a, group_b = self.upto[self.a_ends] - both[self.a_ends], self.upto[self.b_ends] - both[self.b_ends]
        in_a, in_b = np.bincount(group_a), np.bincount(group_b)
        place_a, place_b = np.arange(n) + (np.cumsum(in_b) - in_b)[group_a], np.arange(m) + np.cumsum(in_a)[group_b]
        ids, after = np.empty(n + m, np.int64), np.full(n + m, ord(","), np.uint8)
        ids[place_a], ids[place_b] = self.a, self.b
        after[place_a[np.append(group_a[1:] != group_a[:-1], True)[:n]]] = ord("|")
        after[place_b[np.append(group_b[1:] != group_b[:-1], True)[:m]]] = ord(";")
        table, counts = digits
        sizes = counts[ids] + 1
        last = self.a_at[1:] + self.b_at[1:] - 1
        some = np.diff(self.a_at) > 0
        sizes[last[some]] -= 1  # no sign after a text's last id
        ends = np.cumsum(sizes)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        starts = ends - sizes
        for width in range(1, table.shape[1] + 1):  # ids of as many digits together
            mine = np.flatnonzero(counts[ids] == width)
            for k in range(width):
                out[starts[mine] + k] = table[ids[mine], k]
        inner = np.ones(n + m, bool)
        inner[last[some]] = False
        out[ends[inner] - 1] = after[inner]
        return out, np.concatenate([[0], ends])[np.concatenate([[0], self.a_at[1:] + self.b_at[1:]])]


def decimal_digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each number under size its decimal signs, from the left, and how many they are."""
    counts = np.array([len(str(i)) for i in range(size)], np.int64)
    table = np.zeros((size, int(counts.max())), np.uint8)
    for i in range(size):
        table[i, : counts[i]] = np.frombuffer(str(i).encode(), np.uint8)
    return table, counts


def _packed(ids: np.ndarray, at: np.ndarray, kind: str) -> pa.Array:
    """Ids of each text as bytes, which take half the room of integers in what Spark and its workers exchange."""
    width = np.dtype(kind).itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids, kind))])


def _flat(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(whole).view(kind).astype(np.int32), (at - at[0]) // np.dtype(kind).itemsize


def kind_of(spelled: tuple[Bytes, Bytes]) -> str:
    """Of the ids as bytes."""
    return "<u2" if max(len(s.sizes) for s in spelled) <= 1 << 16 else "<u4"


def _slices(batch: pa.RecordBatch, kind: str) -> Iterator[tuple[pa.RecordBatch, tuple[np.ndarray, ...]]]:
    """Rows of about SLICE / 8 tokens, and their A ids, places, B ids and places."""
    a_at = np.frombuffer(batch.column(1).buffers()[1], np.int32)[batch.column(1).offset :][: len(batch) + 1] // np.dtype(kind).itemsize
    for i, j in slices(a_at, SLICE // 8):
        part = batch.slice(i, j - i)
        yield part, (*_flat(part.column(1), kind), *_flat(part.column(2), kind))


class Counted:
    """Sorted counts in shards of arrays that are mapped into memory."""

    def __init__(self, paths: list[str]):
        self.shards = [np.load(p, mmap_mode="r") for p in paths]
        self.shards = sorted((s for s in self.shards if s.shape[1]), key=lambda s: s[0, 0])
        self.firsts = np.array([s[0, 0] for s in self.shards], np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Counts of distinct sorted keys that all occur."""
        out = np.empty(len(keys), np.int64)
        cuts = np.append(np.searchsorted(keys, self.firsts), len(keys))
        for shard, i, j in zip(self.shards, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if i < j:
                out[i:j] = shard[1, np.searchsorted(shard[0], keys[i:j])]
        return out


def _as_array(source: str, target: str) -> None:
    """Write a Parquet shard as an array of keys and counts; whole or not at all, and the same each time."""
    if not os.path.exists(target):
        found = pq.ParquetFile(source).read()
        own = f"{target}.{uuid.uuid4().hex}"
        with open(own, "wb") as f:
            np.save(f, np.stack([found.column("key").to_numpy(), found.column("n").to_numpy()]))
        os.replace(own, target)


def _arrays(counts: DataFrame) -> Callable[[], Counted]:
    """What gives a task the counts. counts: key and n, as written to the shared folder."""
    spark = counts.sparkSession
    files = sorted(counts.inputFiles())  # MOST_SHARDS at most
    parts = [urlsplit(f) for f in files]
    if all(p.scheme in ("", "file") for p in parts):
        local = [unquote(p.path) for p in parts]
        targets = [f"{os.path.dirname(p)}/_{os.path.basename(p)}.npy" for p in local]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for source, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    _as_array(source, target)
                yield batch

        if targets:
            todo = spark.createDataFrame(list(zip(local, targets, strict=True)), "source string, target string")
            todo.repartition(len(targets)).mapInArrow(run, "source string, target string").count()
        return lambda: Counted(targets)
    for f in files:
        spark.sparkContext.addFile(f)
    names = [os.path.basename(unquote(p.path)) for p in parts]

    def fetched() -> Counted:
        paths = [SparkFiles.get(n) for n in names]
        for p in paths:
            _as_array(p, f"{p}.npy")
        return Counted([f"{p}.npy" for p in paths])

    return fetched


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of sorted counts."""
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")  # runs that are sorted already are merged
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[heads], np.add.reduceat(counts, heads)


def _partial(spelled_of: Callable[[], tuple[Bytes, Bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spelled_of()
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for batch in batches:
            for _, tokens in _slices(batch, kind_of(spelled)):
                parts.append(np.unique(Aligned(spelled, *tokens).keys(), return_counts=True))
                held += len(parts[-1][0])
                if held >= HELD:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                    if held >= HELD // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts[0]], names=["key", "n"])
                        parts, held = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(parts)], names=["key", "n"])

    return run


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of equal keys; keys come in order, and the last one of a batch may go on in the next."""
    key, left = None, 0
    for batch in batches:
        keys, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        some, sums = keys[heads], np.add.reduceat(n, heads)
        if key is not None:
            if some[0] == key:
                sums[0] += left
            else:
                some, sums = np.concatenate([[key], some]), np.concatenate([[left], sums])
        key, left = int(some[-1]), int(sums[-1])
        if len(some) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(some[:-1]), pa.array(sums[:-1])], names=["key", "n"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([left], pa.int64())], names=["key", "n"])


def align(docs: DataFrame, tokenizer: str, model: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, a, b: ids of A and B as little-endian bytes, see `kind_of`; one row a row of docs), (key, n: links of a pair of ids over all of them, key being
    B's id * 2^32 + A's). tokenizer, model: paths, on the driver, of a byte-level BPE and a SentencePiece model."""
    space = Workspace(docs.sparkSession, "alignment")
    tokens, counts, _ = _aligned(docs, tokenizer, model, space)
    return tokens, counts


def _aligned(docs: DataFrame, tokenizer: str, model: str, space: Workspace) -> tuple[DataFrame, DataFrame, tuple[Bytes, Bytes]]:
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f, open(model, "rb") as g:
        made = f.read(), g.read(), classes()
    shared = spark.sparkContext.broadcast(made)
    aligner = Aligner(*made)
    spelled = aligner.spelled
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*shared.value)
        for batch in batches:
            _, sizes = string_buffers(batch.column(1))
            for i, j in slices(sizes, SLICE // 2):
                texts = [t or "" for t in batch.column(1).slice(i, j - i).to_pylist()]
                lists = [_packed(ids, at, kind_of(aligner.spelled)) for ids, at in aligner.encode(texts)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["doc_id", "a", "b"])

    tokens = space.cut(docs.select("doc_id", "text").mapInArrow(tidy(encode), f"doc_id {kind}, a binary, b binary"), "tokens")
    partial = space.cut(tokens.mapInArrow(tidy(_partial(shipped(spark, spelled))), "key long, n long"), "partial")
    shards = max(1, min(MOST_SHARDS, -(-partial.count() // SHARD_ROWS)))
    counts = space.cut(partial.repartitionByRange(shards, "key").sortWithinPartitions("key").mapInArrow(_runs, "key long, n long"), "counts")
    space.drop(partial)
    return tokens, counts, spelled


def measure(docs: DataFrame, tokenizer: str, model: str) -> DataFrame:
    """The contract's row for every document."""
    space = Workspace(docs.sparkSession, "alignment")
    tokens, counts, spelled = _aligned(docs, tokenizer, model, space)
    counted_of = _arrays(counts)
    size_b = len(spelled[1].sizes)
    highest = np.zeros(size_b, np.int64)
    for row in counts.groupBy(F.shiftright("key", 32).alias("b")).agg(F.max("n").alias("n")).collect():  # a row an id of B
        highest[row["b"]] = row["n"]
    known_of = shipped(docs.sparkSession, (spelled, highest))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled, highest = known_of()
        counted = counted_of()
        digits = decimal_digits(max(len(s.sizes) for s in spelled))
        for batch in batches:
            for part, tokens in _slices(batch, kind_of(spelled)):
                found = Aligned(spelled, *tokens)
                keys = found.keys()
                some, place = np.unique(keys, return_inverse=True)
                n = counted.of(some)
                best = (n == highest[some >> 32])[place]
                at = np.concatenate([[0], np.cumsum(found.links)])
                upto_best, upto_n = np.concatenate([[0], np.cumsum(best)]), np.concatenate([[0], np.cumsum(n[place])])
                signs, signs_at = found.written(digits)
                sha = [hashlib.sha256(signs[x:y]).hexdigest() if x < y else "" for x, y in zip(signs_at[:-1].tolist(), signs_at[1:].tolist(), strict=True)]
                columns = [np.diff(tokens[1]), np.diff(tokens[3]), found.groups, found.links, np.diff(upto_best[at]), np.diff(upto_n[at])]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(sha, pa.string())], names=names)

    return tokens.mapInArrow(tidy(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
