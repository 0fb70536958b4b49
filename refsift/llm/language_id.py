"""Language identification by cross-parsing entropy.

For every language, a suffix automaton of a bounded sample of its labelled text is built. A text is parsed greedily
into the longest phrases that occur in the sample; the entropy estimate is phrases * log2(sample length) / letters, and
the language with the smallest estimate wins. Numpy steps many blocks of BLOCK symbols at once through the automaton,
whose transitions lie in a double array; the blocks of a text are then joined to the parse of the whole.

The model is fitted on distinct texts drawn by hash: about DOCS a language (of many languages fewer, MOST_DOCS
altogether), of any length; of a longer text WINDOW code points from a place drawn by hash are read, so at most some
MOST_DOCS * WINDOW code points come to the driver, however often a text is repeated. Of these texts every third, up to CLEAN, is kept for the
cuts below; each of the others gives an equal part of LETTERS code points (one shorter than that gives all of itself,
and what it leaves goes to the others), from a place drawn by its hash. So with DOCS texts some 270 texts of about 240
code points make a language's model, no row is left out for its length, and none fills the model. Only text and lang of
rows outside the held-out fifth are read for it.

`predict` also tells whether a text is strange, that is, unlike every language: its best entropy is over the cut of that
language at its length. Cuts come from labelled texts that are in no sample: for each of LENGTHS the 99th percentile of
the entropies of their beginnings, and some slack, which falls with the length. A length with fewer than FEWEST such
texts takes the cut of the next shorter one; without any the cut is STRANGE.

Defined cases: null, empty and letterless texts are `und` with score 0.0; letters unseen in every sample end a phrase in
every language; ties go to the alphabetically first language; without labelled rows every text is `und`; repeated rows
get equal answers; a null doc_id is never held out; an empty table gives an empty result; more columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped, tidy
from .textvec import codepoints, slices

DOCS = 400
MOST_DOCS = 8_000
WINDOW = 8192
LETTERS = 64_000
BLOCK = 256
#: So many blocks or fewer are parsed anew one by one.
FEW = 48
#: How sharply differences of entropy (bits a symbol) turn into the score.
SHARPNESS = 8.0
#: A text whose best entropy is over so many bits a symbol shares hardly more than single letters with any sample (a
#: foreign script has about 15), however short it is.
STRANGE = 10.0
#: Clean texts that the cuts by length are read from, of each language, and how many a length needs.
CLEAN, FEWEST = 200, 20
#: A cut is so many bits over the 99th percentile of clean texts: SLACK, and SHORT by the root of the letters.
SLACK, SHORT = 1.75, 6.0
#: Lengths in symbols that have a cut of their own.
LENGTHS = tuple(1 << k for k in range(2, 14))
#: More languages than these in the labels are an error, not a cut.
MOST_LANGUAGES = 512


def _unicode_letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Alphabet:
    """Maps code points to symbols: 0 between words, 1.. the letters of the samples, the last any other letter. The map
    is made where the model is, and travels with it."""

    def __init__(self, letters: list[int], low: np.ndarray | None = None):
        """low: for each code point its lower-case letter, or 0."""
        self.letters = sorted(letters)
        self.size = len(self.letters) + 2
        low = _unicode_letters() if low is None else low
        kind = np.uint16 if self.size < 65536 else np.int32
        place = np.zeros(0x110000, kind)
        place[self.letters] = np.arange(1, len(self.letters) + 1)
        self._map = np.where(low == 0, 0, np.where(place[low] > 0, place[low], self.size - 1)).astype(kind)

    def symbols(self, cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of every text, runs of non-letters as one 0, and the n + 1 offsets."""
        raw = self._map[cps]
        keep = np.ones(len(raw), bool)
        keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
        heads = offsets[:-1][offsets[:-1] < offsets[1:]]
        keep[heads] = raw[heads] != 0  # no blank at a text's head
        before = np.concatenate([[0], np.cumsum(keep)])
        return raw[keep], before[offsets]


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the automaton of all substrings; state 0 is the root."""
    nexts: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols.tolist():
        cur = len(nexts)
        nexts.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nexts


def places_of(nexts: list[dict[int, int]], size: int) -> tuple[list[int], int]:
    """For each state a place in one shared array, such that no two transitions meet at place + symbol (a double array):
    its length is about that of the transitions, whatever the size of the alphabet. States without transitions, and the
    root, which no step leads back to, share the last place, where nothing lies."""
    room = sum(map(len, nexts)) + 2 * size
    taken, used = bytearray(room), bytearray(room)
    places = [-1] * len(nexts)
    begin: dict[int, int] = {}  # for each number of transitions where to look first
    for s in sorted(range(1, len(nexts)), key=lambda s: -len(nexts[s])):
        edges = sorted(nexts[s])
        if not edges:
            break
        least, others = edges[0], edges[1:]
        first = begin[len(edges)] = max(0, taken.find(0, begin.get(len(edges), 0)))
        at, tries = taken.find(0, max(least, first)), 0
        while True:
            if at < 0 or at + size >= len(taken):
                taken.extend(bytes(len(taken)))
                used.extend(bytes(len(used)))
                at = taken.find(0, max(at, least))
            place = at - least
            if not used[place] and not any(taken[place + c] for c in others):
                break
            at, tries = taken.find(0, at + 1), tries + 1
        if tries > 32:
            begin[len(edges)] = at
        used[place], places[s] = 1, place
        for c in edges:
            taken[place + c] = 1
    end = taken.rfind(1) + 1
    return [p if p >= 0 else end for p in places], end


class Parser:
    """Counts phrases. A state is its place in `steps`; the entry at place + symbol holds the state it belongs to (upper
    half) and the next one (lower half)."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.length = max(2, len(symbols))
        nexts = suffix_automaton(symbols)
        places, self.start = places_of(nexts, size)  # at start, and after a symbol that the sample lacks
        steps = np.full(self.start + size, -1, np.int64)
        for place, edges in zip(places[1:], nexts[1:], strict=True):
            for c, t in edges.items():
                steps[place + c] = place << 32 | places[t]
        self.steps = steps
        self.restart = np.array([places[nexts[0][c]] if c in nexts[0] else self.start for c in range(size)], np.int64)

    def _step(self, state: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins with the symbol."""
        found = self.steps[state + symbols]
        begins = found >> 32 != state
        return np.where(begins, self.restart[symbols], found & 0xFFFFFFFF), begins

    def phrases(self, grid: np.ndarray, lengths: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Phrases that begin in each block. grid: symbols, a column for each block, longest first; lengths: of the
        blocks; before: the block that precedes each in its text, or -1.

        All blocks are parsed from the start state side by side. Then each is parsed anew from the state that the block
        before it ends in, up to the place where both parses agree, until no block's end changes any more."""
        blocks = grid.shape[1]
        states, counts = np.full((grid.shape[0] + 1, blocks), self.start, np.int32), np.zeros((grid.shape[0] + 1, blocks), np.int32)
        state, count = np.full(blocks, self.start, np.int64), np.zeros(blocks, np.int32)
        active = blocks
        for row in range(grid.shape[0]):
            while active and lengths[active - 1] <= row:
                active -= 1
            if not active:
                break
            state[:active], begins = self._step(state[:active], grid[row, :active])
            count[:active] += begins
            states[row + 1, :active], counts[row + 1, :active] = state[:active], count[:active]
        alone, end, total = count.copy(), state.copy(), count
        entered = np.full(blocks, self.start, np.int64)
        later = np.flatnonzero(before >= 0)
        view, restart = memoryview(self.steps), self.restart.tolist()
        while True:
            todo = later[end[before[later]] != entered[later]]
            if not len(todo):
                return total
            entered[todo] = end[before[todo]]
            mine, made = entered[todo], np.zeros(len(todo), np.int32)
            row = 0
            while len(todo) > FEW:
                over = lengths[todo] <= row
                if over.any():
                    end[todo[over]], total[todo[over]] = mine[over], made[over]
                    todo, mine, made = todo[~over], mine[~over], made[~over]
                    continue
                mine, begins = self._step(mine, grid[row, todo])
                made = made + begins
                row += 1
                agreed = mine == states[row, todo]
                if agreed.any():
                    done = todo[agreed]
                    end[done], total[done] = state[done], made[agreed] + alone[done] - counts[row, done]
                    todo, mine, made = todo[~agreed], mine[~agreed], made[~agreed]
            for k, here, n in zip(todo.tolist(), mine.tolist(), made.tolist(), strict=True):  # a few: one by one
                at, stop = row, int(lengths[k])
                for c, other in zip(grid[row:stop, k].tolist(), states[row + 1 : stop + 1, k].tolist(), strict=True):
                    found = view[here + c]
                    if found >> 32 == here:
                        here = found & 0xFFFFFFFF
                    else:
                        here, n = restart[c], n + 1
                    at += 1
                    if here == other:
                        here, n = int(state[k]), n + int(alone[k] - counts[at, k])
                        break
                end[k], total[k] = here, n


class Model:
    def __init__(self, samples: dict[str, str]):
        """samples: text for each language."""
        self.languages = sorted(samples)
        low = _unicode_letters()
        cps, offsets = codepoints([samples[x] for x in self.languages])
        seen = np.unique(low[cps])
        self.alphabet = Alphabet([int(c) for c in seen if c], low)
        symbols, at = self.alphabet.symbols(cps, offsets)
        self.parsers = [Parser(symbols[at[i] : at[i + 1]], self.alphabet.size) for i in range(len(self.languages))]
        self.cuts = np.full((len(self.languages), len(LENGTHS)), STRANGE)

    def calibrate(self, clean: dict[str, list[str]]) -> None:
        """Sets the cuts by language and length. clean: texts of each language that are in no sample."""
        for k, language in enumerate(self.languages):
            texts, cut = clean.get(language, []), STRANGE
            for j, length in enumerate(LENGTHS):
                texts = [t for t in texts if len(t) >= length]
                letters, bits = self.entropies([t[:length] for t in texts])
                bits = bits[letters > 0, k]
                if len(bits) >= FEWEST:
                    usual = float(np.quantile(bits, 0.99))
                    cut = max(usual, min(STRANGE, usual + SLACK + SHORT / math.sqrt(length)))
                self.cuts[k, j] = cut

    def strange(self, letters: np.ndarray, bits: np.ndarray) -> np.ndarray:
        """Which texts, of so many letters and bits in each language, are unlike every language."""
        if not self.languages:
            return np.ones(len(letters), bool)
        place = np.maximum(0, np.searchsorted(LENGTHS, letters, "right") - 1)
        pick = np.argmin(bits, axis=1)
        return bits[np.arange(len(bits)), pick] > self.cuts[pick, place]

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Letters of each text, and bits a symbol in each language (inf without letters)."""
        cps, offsets = codepoints(texts)
        symbols, at = self.alphabet.symbols(cps, offsets)
        sizes = np.diff(at)
        solid = np.concatenate([[0], np.cumsum(symbols > 0)])
        letters = solid[at[1:]] - solid[at[:-1]]
        per = -(-sizes // BLOCK)
        owner = np.repeat(np.arange(len(texts)), per)
        first = np.concatenate([[0], np.cumsum(per)])[:-1]
        starts = at[:-1][owner] + (np.arange(len(owner)) - first[owner]) * BLOCK
        lengths = np.minimum(BLOCK, at[1:][owner] - starts)
        order = np.argsort(-lengths, kind="stable")
        place = np.argsort(order)
        follows = np.arange(len(owner)) > first[owner]
        before = np.where(follows, place[np.arange(len(owner)) - 1], -1)[order]
        owner, starts, lengths = owner[order], starts[order], lengths[order]
        out = np.full((len(texts), len(self.languages)), np.inf)
        if len(owner):
            padded = np.concatenate([symbols, np.zeros(BLOCK, symbols.dtype)])
            grid = padded[starts[None, :] + np.arange(BLOCK)[:, None]]
            for k, parser in enumerate(self.parsers):
                total = np.bincount(owner, parser.phrases(grid, lengths, before), len(texts))
                some = letters > 0
                out[some, k] = total[some] * math.log2(parser.length) / sizes[some]
        return letters, out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, best entropy of each text, and whether it is strange."""
        letters, bits = self.entropies(texts)
        strange = self.strange(letters, bits)
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.inf), strange
        some = letters > 0
        best = np.where(some, bits.min(axis=1), 0.0)
        weight = np.where(some[:, None], np.exp2(-SHARPNESS * (np.where(some[:, None], bits, 0.0) - best[:, None])), 1.0)
        score = np.where(some, weight.max(axis=1) / weight.sum(axis=1), 0.0)
        pick = np.argmin(bits, axis=1)
        return [self.languages[p] if s else "und" for p, s in zip(pick, some, strict=True)], score, np.where(some, best, np.inf), strange


def parts(texts: list[str], limit: int) -> list[str]:
    """Equal parts of the texts, of about limit code points altogether, each from a place drawn by its text's hash."""
    sizes, left = {}, limit
    for done, i in enumerate(sorted(range(len(texts)), key=lambda i: len(texts[i]))):
        sizes[i] = min(len(texts[i]), max(1, left // (len(texts) - done)))
        left -= sizes[i]
    out = []
    for i, text in enumerate(texts):
        start = zlib.crc32(text.encode("utf-8", "surrogatepass")) % (len(text) - sizes[i] + 1)
        out.append(text[start : start + sizes[i]])
    return out


def sample(docs: DataFrame, docs_a_language: int = DOCS) -> tuple[dict[str, str], dict[str, list[str]]]:
    """The labelled text that the automata are built of, and texts that are no part of it: together about
    docs_a_language distinct texts of each language, MOST_DOCS at most, give or take a tenth."""
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    labelled = labelled.where(F.col("text").isNotNull()).withColumn("_rs_h", F.xxhash64(F.lit(5), "text"))
    # repeated texts are one text here, however many rows have them
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("_rs_h", 0.02).alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in the labels")
    if not counts:
        return {}, {}
    span = 1 << 40
    draw = F.pmod(F.xxhash64(F.lit(7), "_rs_h"), F.lit(span))
    # of equal texts the same part
    first = F.pmod(F.xxhash64(F.lit(6), "text"), F.greatest(F.lit(1), F.length("text") - (WINDOW - 1))) + 1
    read = F.substring(F.col("text"), first.cast("int"), F.lit(WINDOW))
    each = max(1, min(docs_a_language, MOST_DOCS // len(counts)))
    quota = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(span, each * span // max(1, n))))]), F.col("lang"))
    drawn = labelled.where(draw < quota).select("lang", draw.alias("at"), read.alias("text"))
    rows = sorted(drawn.groupBy("lang", "at").agg(F.min("text").alias("text")).collect(), key=lambda r: (r["lang"], r["at"]))
    drawn_texts: dict[str, dict[str, None]] = {k: {} for k in counts}
    for r in rows:
        drawn_texts[r["lang"]][r["text"]] = None  # distinct ones, in the order of the draw
    samples, clean = {}, {}
    for lang, found in drawn_texts.items():
        texts = [t for t in found if t]
        clean[lang] = texts[2::3][:CLEAN]
        used = set(clean[lang])
        if texts:
            samples[lang] = "\n".join(parts([t for t in texts if t not in used], LETTERS))
    return samples, clean


def fit(docs: DataFrame) -> Model:
    samples, clean = sample(docs)
    model = Model(samples)
    model.calibrate(clean)
    return model


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, bits, strange: one row per row of docs."""
    model_of = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            for i, j in slices(sizes):
                language, score, bits, strange = model.predict(texts[i:j])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(language), pa.array(score), pa.array(bits), pa.array(strange)], names=["doc_id", "lang_pred", "score", "bits", "strange"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, lang_pred string, score double, bits double, strange boolean")


def identify(docs: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    told = predict(docs, fit(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "bits")


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with all their columns but those that language identification rejects, each judged by its own
    text: no letters, or unlike every language."""
    model_of = shipped(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            sizes = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])])
            for i, j in slices(sizes):
                language, _, _, strange = model.predict(texts[i:j])
                yield batch.slice(i, j - i).filter(pa.array(~strange & (np.array(language) != "und")))

    return docs.mapInArrow(tidy(run), docs.schema)
