"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets.

A document's set holds the distinct hashes of its five-word shingles. Two documents are linked if their sets' Jaccard
similarity is at least 3/4; the answer is the smallest doc_id reachable over links.

1. Rows with equal sets form a class; its smallest doc_id stands for it.
2. A class's signature has CHUNKS * WIDTH symbols, each the low 16 bits of a mixed minimum (b-bit MinHash). By the
   pigeonhole principle, two signatures that differ in at most CHUNKS * (ERRORS + 1) - 1 symbols differ in at most ERRORS
   symbols of some chunk. The allowed errors are enumerated: a key for each chunk and each choice of symbols that are
   left out. So every pair within that distance (31 of 96) shares a key. A pair at similarity 3/4 shares one with
   probability 1 - 5e-6 whatever its distance. MORE further symbols of 8 bits sharpen the distance only.
3. Members of a key are compared with the key's hub first: the member that shares most keys. The rows are as many as
   the keys, never pairs of a group. Every pair within the guaranteed distance (SURE) is confirmed on its full sets; of
   the pairs beyond it that met by chance, those that differ in over FAR of all symbols (4.7 standard deviations beyond
   the mean at 3/4) are left. Confirmed links are contracted to components. A second turn does so with a hub of another
   component.
4. Keys that still join different components are compared member by member, in blocks of at most BLOCK members, by
   signature first, each pair under the first key that it shares. Members that are in a near pair get their full sets, and
   the same pairs are confirmed on them block by block: all within SURE, and near ones beyond it. What is shuffled are
   members of blocks, and links that join something, never pairs. No key and no partner is left out.

A set is held as 64-bit hashes: n_shingles and the confirmation are exact but for collisions of these, of which a text
of a million shingles has one with a probability of 3e-8.

Defined cases: null and empty texts, and texts of white space only, have no shingles and are linked with nothing; a
text of fewer than five words is one shingle; repeated rows share a class; rows that share a doc_id but not a text are
joined through that id; a row whose doc_id is null takes part in no link and is its own component (null); ids must be
of an integer type, others are refused with a TypeError; an empty table gives an empty result; further columns are
ignored by `link` and carried through by `deduplicate`, which leaves one row of those that share the id that stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Workspace, freed_shuffles, once, tidy
from .components import components
from .textvec import U64, Words, mix64, seeded, shingle_hashes, slices, string_buffers

WORDS = 5
#: Linked: 100 * intersection >= SIMILAR * union.
SIMILAR = 75
CHUNKS, WIDTH, ERRORS = 16, 6, 1
SYMBOLS = CHUNKS * WIDTH
#: Pairs whose signatures differ in at most so many of the SYMBOLS share a key, and are all confirmed.
SURE = CHUNKS * (ERRORS + 1) - 1
MORE = 256
FAR = 126
#: For members of open keys only: so many further symbols of 8 bits, and in how many of them a pair may differ; before
#: that, in how many of the SYMBOLS. (4.3 and 4.7 standard deviations beyond the mean at 3/4.)
WIDE = 768
FAR_WIDE, FAR_FIRST = 243, 44
BLOCK = 1024
#: Turns in which members are compared with one member of their key.
HUBS = 2

_SCHEMA = "doc_id long, n_shingles long, same binary, signature binary"


def _least(hashes: np.ndarray, offsets: np.ndarray, count: int, seed: int) -> Iterator[np.ndarray]:
    """For each of count hash functions, the mixed minimum of every set (uint32); every set must have elements."""
    small = (hashes >> U64(32)).astype(np.uint32)
    flips = (seeded(count, seed) >> U64(32)).astype(np.uint32)
    factors = (seeded(count, seed + 6) >> U64(31)).astype(np.uint32) | np.uint32(1)
    for flip, factor in zip(flips, factors, strict=True):
        yield np.minimum.reduceat((small ^ flip) * factor, offsets[:-1]) * np.uint32(0x9E3779B1)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """SYMBOLS symbols of 16 bits and MORE of 8 bits for each set."""
    first = np.empty((len(offsets) - 1, SYMBOLS), np.uint16)
    rest = np.empty((len(offsets) - 1, MORE), np.uint8)
    for k, least in enumerate(_least(hashes, offsets, SYMBOLS + MORE, 23)):
        if k < SYMBOLS:
            first[:, k] = least >> np.uint32(16)
        else:
            rest[:, k - SYMBOLS] = least >> np.uint32(24)
    return [a.tobytes() + b.tobytes() for a, b in zip(first, rest, strict=True)]


def _widened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rep, shingles) to (rep, wide)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            column = part.column(1)
            hashes, offsets = column.flatten().to_numpy().view(U64), column.offsets.to_numpy()
            out = np.empty((part.num_rows, WIDE), np.uint8)
            for k, least in enumerate(_least(hashes, (offsets - offsets[0]).astype(np.int64), WIDE, 61)):
                out[:, k] = least >> np.uint32(24)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in out], pa.binary())], names=["rep", "wide"])


def symbols(signed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of 16 bits and those of 8 bits, a row for each signature."""
    raw = np.frombuffer(b"".join(signed), np.uint8).reshape(-1, 2 * SYMBOLS + MORE)
    return np.ascontiguousarray(raw[:, : 2 * SYMBOLS]).view(np.uint16), raw[:, 2 * SYMBOLS :]


def near(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Places of the pairs of rows that differ in at most SURE of the SYMBOLS, or in at most FAR of all symbols."""
    apart = (a[0] != b[0]).sum(axis=1)
    good = apart <= SURE
    some = np.flatnonzero(~good & (apart <= FAR))
    good[some] = apart[some] + (a[1][some] != b[1][some]).sum(axis=1) <= FAR
    return np.flatnonzero(good)


def keys(symbols: np.ndarray) -> np.ndarray:
    """The join keys of each signature: for every chunk, one for each choice of ERRORS symbols to leave out."""
    left_out = list(combinations(range(WIDTH), ERRORS))
    weights = seeded(WIDTH, 31)
    salts = seeded(CHUNKS * len(left_out), 37).reshape(CHUNKS, len(left_out))
    out = np.empty((len(symbols), CHUNKS * len(left_out)), U64)
    with np.errstate(over="ignore"):
        parts = mix64(symbols.reshape(-1, CHUNKS, WIDTH).astype(U64) + U64(1)) * weights
        whole = parts.sum(axis=2, dtype=U64)
        for j, gone in enumerate(left_out):
            out[:, j::len(left_out)] = mix64(whole - parts[:, :, list(gone)].sum(axis=2, dtype=U64) + salts[:, j])
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        ids = batch.column(0)
        for i, j in slices(offsets):
            base = offsets[i]
            sets = _sets(data[base : offsets[j]], offsets[i : j + 1] - base)
            sizes = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(sizes)
            flat = np.concatenate([*sets, np.zeros(0, U64)])
            found: list[bytes | None] = [None] * (j - i)
            if len(full):
                signed = signatures(flat, np.concatenate([[0], np.cumsum(sizes[full])]))
                for row, k in enumerate(full):
                    found[k] = signed[row]
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes), pa.array(same, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "n_shingles", "same", "signature"])


def _sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of each text's shingle hashes."""
    hashes, at = shingle_hashes(Words(data, offsets), WORDS)
    return [np.unique(hashes[at[k] : at[k + 1]]) for k in range(len(offsets) - 1)]


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = string_buffers(batch.column(1))
        for i, j in slices(offsets):
            sets = _sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
            flat = np.concatenate([*sets, np.zeros(0, U64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(ends, pa.array(flat))], names=["rep", "shingles"])


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, same (digest of the set), signature."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(tidy(_described), _SCHEMA)


def full_sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, shingles (the sorted set) of the documents named in reps. The texts are dealt out by id at every size; the
    sets of documents that share no key are never kept."""
    plain = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text"))
    found = plain.join(reps.select("rep").hint("merge"), "rep", "left_semi").mapInArrow(tidy(_shingled), "rep long, shingles array<long>")
    return found.where(F.size("shingles") > 0)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        step = 2048
        for i in range(0, len(ids), step):
            made = keys(symbols(batch.column(1).slice(i, step).to_pylist())[0])
            yield pa.RecordBatch.from_arrays([pa.array(made.ravel().view(np.int64)), pa.array(np.repeat(ids[i : i + step], made.shape[1]))], names=["key", "rep"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, signature of a, of b), the ids of those that `near` names."""
    for batch in batches:
        if batch.num_rows:
            good = near(symbols(batch.column(2).to_pylist()), symbols(batch.column(3).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(good)) for c in (0, 1)], names=["a", "b"])


def _of_groups(sizes: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j), i < j, of all pairs within runs of the given sizes; about `most` pairs at once."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows = np.arange(len(ends))
    each = ends - rows - 1
    upto = np.cumsum(each)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right")))
        per = each[at:to]
        left = np.repeat(rows[at:to], per)
        yield left, left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(per) - per, per)
        at = to


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by key, one, two: some whole groups of equal values at once."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = pa.Table.from_batches([batch])
        held = part if held is None else pa.concat_tables([held, part]).combine_chunks()
        key, one, two = (held.column(c).to_numpy() for c in range(3))
        last = np.flatnonzero((key == key[-1]) & (one == one[-1]) & (two == two[-1]))[0]
        if last:  # the last group may go on in the next batch
            yield held.slice(0, last).combine_chunks()
            held = held.slice(last).combine_chunks()
    if held is not None:
        yield held


def _heads(rows: pa.Table) -> np.ndarray:
    key, one, two = (rows.column(c).to_numpy() for c in range(3))
    return np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))


def _near_pairs(rows: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near pairs of different components within the groups of rows, each pair in one group only. Rows: key,
    one, two, block, rep, comp, first symbols, wide. Within a pair of different blocks only rows of different blocks are
    compared."""
    key, one, two, block, rep, comp = (rows.column(c).to_numpy() for c in range(6))
    signed = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    wide = np.frombuffer(b"".join(rows.column(7).to_pylist()), np.uint8).reshape(-1, WIDE)
    for i, j in _of_groups(np.diff(_heads(rows), append=len(key)), 1 << 16):
        open_ = (comp[i] != comp[j]) & ((one[i] == two[i]) | (block[i] != block[j]))
        i, j = i[open_], j[open_]
        apart = signed[i] != signed[j]
        distance = apart.sum(axis=1)
        good = np.flatnonzero(distance <= FAR_FIRST)
        sure = distance[good] <= SURE
        good = good[sure | ((wide[i[good]] != wide[j[good]]).sum(axis=1) <= FAR_WIDE)]
        i, j, apart = i[good], j[good], apart[good].reshape(-1, CHUNKS, WIDTH)
        first = np.argmax(apart.sum(axis=2) <= ERRORS, axis=1)
        wrong = np.argmax(apart[np.arange(len(i)), first], axis=1)
        mine = keys(signed[i])[np.arange(len(i)), first * WIDTH + wrong].view(np.int64) == key[i]
        yield i[mine], j[mine]


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows that `_near_pairs` takes, those that are in a pair: as many as members at most, never as pairs."""
    for rows in _groups(batches):
        met = np.zeros(rows.num_rows, bool)
        for i, j in _near_pairs(rows):
            met[i] = met[j] = True
        yield from rows.filter(pa.array(met)).combine_chunks().to_batches()


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) between the rows that `_across` gives, with their full sets (the ninth column): every near pair is
    confirmed on its sets, except where links of the group have joined its two already, so a group of n rows gives fewer
    than n links."""
    for rows in _groups(batches):
        rep, label = rows.column(4).to_numpy(), rows.column(5).to_numpy().copy()
        ends = np.concatenate([_heads(rows), [rows.num_rows]])
        group = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        column = rows.column(8).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        offsets = column.offsets.to_numpy().astype(np.int64)
        offsets -= offsets[0]
        known, codes = np.unique(column.flatten().to_numpy(), return_inverse=True)
        marked = np.zeros(len(known), np.int64)
        a, b = [], []
        for i, j in _near_pairs(rows):
            for x in np.split(np.arange(len(i)), np.flatnonzero(np.diff(i)) + 1):
                if not len(x):
                    continue
                one, others = int(i[x[0]]), j[x]
                others = others[label[others] != label[one]]
                if not len(others):
                    continue
                own = codes[offsets[one] : offsets[one + 1]]
                marked[own] = 1
                sizes = offsets[others + 1] - offsets[others]
                starts = np.cumsum(sizes) - sizes
                flat = codes[np.repeat(offsets[others] - starts, sizes) + np.arange(int(sizes.sum()))]
                common = np.add.reduceat(marked[flat], starts)
                marked[own] = 0
                for other in others[100 * common >= SIMILAR * (len(own) + sizes - common)]:
                    if label[other] != label[one]:
                        within = slice(ends[group[one]], ends[group[one] + 1])
                        label[within][label[within] == label[other]] = label[one]
                        a.append(min(rep[one], rep[other]))
                        b.append(max(rep[one], rep[other]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, sets: DataFrame, space: Workspace) -> DataFrame:
    """Of pairs (a, b), those whose full sets are similar enough."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("sa", "sb")).cast("long")
    told = both.select("a", "b", common.alias("common"), (F.size("sa") + F.size("sb")).cast("long").alias("total"))
    return space.cut(told.where(100 * F.col("common") >= SIMILAR * (F.col("total") - F.col("common"))).select("a", "b"), "confirmed")


def _signed(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    one = signed.select(F.col("rep").alias("a"), F.col("signature").alias("one"))
    two = signed.select(F.col("rep").alias("b"), F.col("signature").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").mapInArrow(tidy(_near), "a long, b long")


def _named(members: DataFrame, links: DataFrame | None, space: Workspace) -> DataFrame:
    """members with comp, the component that links give each."""
    if links is None:
        return members.withColumn("comp", F.col("rep"))
    comp = components(links, space).select(F.col("node").alias("rep"), "comp")
    return members.join(comp, "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))


def _open(named: DataFrame) -> DataFrame:
    """Members of keys that hold more than one component."""
    keys_of = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return named.join(keys_of, "key", "left_semi").select("key", "rep", "comp")


def _hub_pairs(named: DataFrame, weights: DataFrame, turn: int) -> DataFrame:
    """Each member of a key beside the key's hub, where their components differ. The hub is the member that shares
    most keys with others (ties: the smallest id): the text that a group's copies were made from rather than a copy.
    In later turns hubs of the components of earlier hubs are passed over."""
    m = (named.select("key", "rep", "comp") if turn == 0 else _open(named)).join(weights, "rep")
    best = F.max_by(F.struct("rep", "comp"), F.struct("weight", -F.col("rep"))).alias("hub")
    met = m.join(m.groupBy("key").agg(best), "key")
    for _ in range(turn):
        left = met.where(F.col("comp") != F.col("hub.comp")).drop("hub")
        met = m.join(left.groupBy("key").agg(best), "key")
    met = met.where(F.col("comp") != F.col("hub.comp"))
    return met.select(F.least("rep", "hub.rep").alias("a"), F.greatest("rep", "hub.rep").alias("b")).distinct()


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be of an integer type: the smallest one names a component")
    spark = docs.sparkSession
    space = Workspace(spark, "near")
    with freed_shuffles(spark):
        told = space.cut(describe(docs), "told")
        thin = told.select("doc_id", "n_shingles", "same")
        classes = space.cut(thin.where("doc_id is not null and same is not null").groupBy("same").agg(F.min("doc_id").alias("rep")), "classes")
        firsts = told.where("doc_id is not null and same is not null").select(F.col("doc_id").alias("rep"), "same", "signature").join(classes, ["same", "rep"], "left_semi")
        signed = space.cut(firsts.select("rep", "signature").distinct(), "signed")
        keyed = signed.mapInArrow(tidy(_keyed), "key long, rep long")
        shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        members = space.cut(keyed.join(shared, "key").select("key", "rep", "n"), "members")
        weights = space.cut(members.groupBy("rep").agg(F.sum("n").alias("weight")), "weights")
        # rows that share an id are linked by it below, so whichever set of an id confirms a link confirms one of its rows
        sets = space.cut(full_sets(docs, weights), "sets")
        links = tried = None
        for turn in range(HUBS):
            named = _named(members, links, space)
            pairs = _hub_pairs(named, weights, turn)
            if tried is not None:
                pairs = pairs.join(tried, ["a", "b"], "left_anti")
            pairs = space.cut(pairs, "hubs")
            found = _confirmed(space.cut(_signed(pairs, signed), "close"), sets, space)
            links, tried = (found, pairs) if links is None else (links.unionByName(found), tried.unionByName(pairs))
        named = _named(members, links, space)
        rest = space.cut(_open(named), "rest")
        space.drop(members)
        counts = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        dealt = rest.join(counts, "key").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("key", "rep", "comp", "block", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
        wide = space.cut(sets.join(rest.select("rep").distinct(), "rep", "left_semi").mapInArrow(tidy(_widened), "rep long, wide binary").distinct(), "wide")
        dealt = dealt.join(signed.select("rep", F.substring("signature", 1, 2 * SYMBOLS).alias("first")), "rep").join(wide, "rep")
        columns = ["key", "one", "two", "block", "rep", "comp", "first", "wide"]
        dealt = dealt.select(*columns).repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "rep")
        crossed = dealt.mapInArrow(tidy(_across), "key long, one int, two int, block int, rep long, comp long, first binary, wide binary")
        crossed = space.cut(crossed, "crossed")
        own = sets.join(crossed.select("rep").distinct(), "rep", "left_semi").dropDuplicates(["rep", "shingles"])
        crossed = crossed.join(own, "rep").select(*columns, "shingles")
        crossed = crossed.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "rep")
        more = space.cut(crossed.mapInArrow(tidy(_linked), "a long, b long").distinct(), "linked")
        shared_ids = _shared_ids(thin, classes)
        edges = links.unionByName(more).unionByName(shared_ids)
        final = components(edges, space)
        answer = thin.join(classes, "same", "left").join(final.select(F.col("node").alias("rep"), "comp"), "rep", "left")
        answer = answer.select("doc_id", "n_shingles", F.coalesce("comp", "rep", "doc_id").alias("component_id"))
        answer = space.cut(answer, "answer")
        space.drop(told, signed, sets, rest)
    return answer.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _shared_ids(thin: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    own = thin.where("doc_id is not null and same is not null").join(classes, "same").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    return own.where("a < b").select("a", "b")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, one document of each group, with all their columns."""
    space = Workspace(docs.sparkSession, "near-keep")
    told = link(docs)
    gone = space.cut(told.where(~F.col("kept")).select(F.col("doc_id").alias("_rs_id")).distinct(), "gone")
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_rs_id")), "left_anti")
    often = told.where("kept").groupBy(F.col("doc_id").alias("_rs_id")).agg(F.count(F.lit(1)).alias("n")).where("_rs_id is not null and n > 1")
    return once(kept, space.cut(often.select("_rs_id", F.lit(0).alias("_rs_same")), "often"), F.lit(0))
