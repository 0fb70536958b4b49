"""Toxicity by compression distance: two zstandard dictionaries, one of ordinary and one of toxic text.

A text is cut into windows of about STRIDE bytes, at the first word that starts in each STRIDE bytes (at the place itself
where none does), so that windows cover all of it and no word of usual length is cut. Each window is compressed under both dictionaries; the bytes
that the toxic one saves are its gain. Both begin with the same trained dictionary of ordinary text, so that what is
usual is cheap under either; it is followed by OWN bytes trained on other ordinary windows, or on toxic ones. A window
is compressed under the own parts alone first, by a quicker search, and gains nothing where the toxic one doesn't save.

Most windows of a toxic text are ordinary. The toxic part is therefore trained anew ROUNDS times, on the PICKED windows of
each toxic text that gain most. Toxic texts are in two halves meanwhile, and those of one half gain under the dictionary
of the other, so that what they have in common counts and not what one of them repeats.

Thresholds come from ordinary texts that are in no dictionary: the evidence of a gain is minus the log of the share of
their windows that gain as much. A text's statistic is the largest, for k of 1 to TOP, of the sum of its k best windows'
evidence less k times the log of its number of windows (and plus log k!), so that long texts get no higher by chance. A
logistic function of it, fitted on texts of both labels that no dictionary has seen, gives the score.

The model is fitted on distinct labelled texts outside the held-out fifth, drawn by hash of the text: about TOXIC and
ORDINARY ones, and of each at most PART code points from a place drawn by hash (all of a shorter one). Scores read whole
texts, and nothing but the text.

Defined cases: a text without a sign other than blanks (null, empty, blank) scores 0.0; labels that are null or neither 0
nor 1 are left out; of several labels of a document the smallest counts; a text that rows of both labels share is not
learned from; with labels of one class, or fewer than FEWEST texts of either, every other text scores the share of
label 1 (0.0 without labels); repeated rows get equal answers, and count once in the fit however many they are; a null doc_id is never held out;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped, tidy
from .textvec import BLANK, slices, string_buffers

STRIDE = 32
LEVEL = 16
#: The quick comparison: a lazy search of few steps.
QUICK = {"strategy": zstandard.STRATEGY_LAZY2, "min_match": 4, "search_log": 4}
#: Bytes of the common dictionary, and of each dictionary's own part.
COMMON, OWN = 1 << 20, 1 << 15
ROUNDS, PICKED = 2, 3
#: Windows that a dictionary is trained on, at most.
SAMPLES = 400_000
TOP = 6
#: Texts that the model is fitted on, and code points of each.
TOXIC, ORDINARY, PART = 2_000, 8_000, 16_384
FEWEST = 4
#: A toxic text that is missed weighs as much as so many ordinary ones that are accused.
MISSED = 3.0
#: predicted is 1 from this score on.
CUT = 0.5
#: Gains are counted from -SPAN to SPAN bytes.
SPAN = 40


class Windows:
    """The windows of UTF-8 texts, lower-cased beforehand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        """data: bytes of the texts one after another; offsets: n + 1 places in data, the first 0."""
        solid = ~BLANK[data]
        first = solid.copy()
        if len(data):
            first[1:] &= ~solid[:-1]
            heads = offsets[:-1][offsets[:-1] < offsets[1:]]
            first[heads] = solid[heads]
        starts = np.append(np.flatnonzero(first), len(data) + STRIDE)
        sizes = np.diff(offsets)
        per = -(-sizes // STRIDE)
        owner = np.repeat(np.arange(len(sizes)), per)
        place = offsets[:-1][owner] + STRIDE * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        end = offsets[1:][owner]
        word = starts[np.searchsorted(starts, place)]
        at = np.where(word < np.minimum(place + STRIDE, end), word, place)
        at[np.append(True, owner[1:] != owner[:-1])[: len(owner)]] = offsets[:-1][sizes > 0]
        to = np.append(at[1:], 0)
        to[np.append(owner[1:] != owner[:-1], True)[: len(owner)]] = offsets[1:][sizes > 0]
        count = np.concatenate([[0], np.cumsum(solid)])
        some = count[to] > count[at]
        self.data, self.owner, self.at, self.to, self.texts = data.tobytes(), owner[some], at[some], to[some], len(sizes)

    def each(self) -> list[bytes]:
        return [self.data[a:b] for a, b in zip(self.at.tolist(), self.to.tolist(), strict=True)]


def windows_of(texts: pa.Array) -> Iterator[Windows]:
    """Windows of texts, slice by slice."""
    data, offsets = string_buffers(pc.utf8_lower(texts))
    for i, j in slices(offsets):
        yield Windows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def trained(windows: list[bytes], size: int) -> bytes:
    """A dictionary of size bytes at most, a quarter of the windows' bytes at most; the windows themselves where they are
    too few to train on."""
    some = [w for w in windows if len(w) >= 8]
    # mixed: the trainer takes its segments from stretches of the samples in turn
    some = [some[i] for i in np.random.default_rng(1).permutation(len(some))[:SAMPLES].tolist()]
    size = min(size, sum(map(len, some)) // 4)
    try:
        return zstandard.train_dictionary(max(size, 512), some, k=64, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(some)[-max(size, 512) :]


def compressor(dictionary: bytes, **ways: int) -> Callable[[bytes], bytes]:
    found = zstandard.ZstdCompressionDict(dictionary)
    plain = {"write_content_size": 0, "write_checksum": 0, "write_dict_id": 0}
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(dictionary), **ways, **plain)
    found.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=found, compression_params=settings).compress


class Model:
    """Dictionaries, thresholds and the logistic function; compressors are made where they are used."""

    def __init__(self, common: bytes, ordinary: bytes, toxic: bytes, share: float):
        self.common, self.ordinary, self.toxic, self.share = common, ordinary, toxic, share
        self.evidence = np.zeros(2 * SPAN + 1)
        self.slope, self.bias = 1.0, 0.0
        self._made = None

    def __getstate__(self):
        return self.__dict__ | {"_made": None}

    def gains(self, windows: list[bytes], all_whole: bool = False) -> np.ndarray:
        """Bytes that the toxic dictionary saves, from 0 (-SPAN or less) to 2 * SPAN; 0 too where its own part saves
        nothing against the ordinary one's, unless all_whole."""
        if self._made is None:
            own = [compressor(part, **QUICK) for part in (self.ordinary, self.toxic)]
            self._made = *own, *(compressor(self.common + part) for part in (self.ordinary, self.toxic))
        quick, quick_toxic, plain, toxic = self._made
        out = np.zeros(len(windows), np.int64)
        some = [i for i, w in enumerate(windows) if all_whole or len(quick_toxic(w)) < len(quick(w))]
        out[some] = np.clip([len(plain(windows[i])) - len(toxic(windows[i])) for i in some], -SPAN, SPAN) + SPAN
        return out

    def calibrate(self, gains: np.ndarray) -> None:
        """Evidence by the gains of windows of ordinary texts."""
        counts = np.bincount(gains, minlength=2 * SPAN + 1) + 0.02
        self.evidence = -np.log(np.cumsum(counts[::-1])[::-1] / counts.sum())

    def statistic(self, windows: Windows) -> np.ndarray:
        """One number a text, -inf without windows."""
        e = self.evidence[self.gains(windows.each())]
        per = np.bincount(windows.owner, minlength=windows.texts)
        order = np.lexsort((-e, windows.owner))
        owner, e = windows.owner[order], e[order]
        rank = np.arange(len(e)) - (np.cumsum(per) - per)[owner]
        owner, e, rank = owner[rank < TOP], e[rank < TOP], rank[rank < TOP]
        table = np.full((windows.texts, TOP), -np.inf)
        # of k windows of n there are about n^k / k! choices
        table[owner, rank] = e - np.log(per[owner]) + np.log(rank + 1.0)
        with np.errstate(invalid="ignore"):
            return np.max(np.cumsum(table, axis=1), axis=1)

    def fit(self, statistics: np.ndarray, toxic: np.ndarray, weights: np.ndarray) -> None:
        """The logistic function of the statistic, with a light pull towards a slope of one half."""
        x = np.clip(statistics, -8, 16)
        w = np.array([0.5, 0.0])
        z = np.stack([x, np.ones_like(x)], axis=1)
        pull = np.array([0.5, 1e-3])
        bound = (z * (weights / 4)[:, None]).T @ z + np.diag(pull)  # no curvature is above it, so no step is too long
        for _ in range(1000):
            slope = z.T @ (weights * (_sigmoid(z @ w) - toxic)) + pull * (w - [0.5, 0.0])
            w = w - np.linalg.solve(bound, slope)
        self.slope, self.bias = max(0.05, float(w[0])), float(w[1])

    def score(self, windows: Windows) -> np.ndarray:
        some = np.bincount(windows.owner, minlength=windows.texts) > 0
        if not self.toxic:
            return np.where(some, self.share, 0.0)
        found = np.clip(self.statistic(windows), -8, 16)
        return np.where(some, _sigmoid(self.slope * found + self.bias), 0.0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _favoured(parts: list[list[bytes]], model: Model) -> list[bytes]:
    """The windows of each text that gain most."""
    return [part[i] for part in parts for i in np.argsort(-model.gains(part, all_whole=True), kind="stable")[:PICKED].tolist()]


def train(ordinary: list[str], toxic: list[str], share: float) -> Model:
    """ordinary, toxic: distinct texts; share: of toxic ones among all labelled ones."""
    if len(ordinary) < FEWEST or len(toxic) < FEWEST:
        return Model(b"", b"", b"", share)

    def each(texts: list[str]) -> list[list[bytes]]:
        return [w.each() for text in texts for w in windows_of(pa.array([text], pa.string()))]

    def flat(parts: list[list[bytes]]) -> list[bytes]:
        return [w for part in parts for w in part]

    usual, bad = each(ordinary), each(toxic)
    learned = [part for i, part in enumerate(bad) if i % 4]  # every fourth text is for the logistic function
    halves = learned[0::2], learned[1::2]
    common, own, parts = trained(flat(usual[0::3]), COMMON), trained(flat(usual[1::3]), OWN), [trained(flat(half), OWN) for half in halves]
    for _ in range(ROUNDS):
        picks = [_favoured(half, Model(common, own, part, share)) for half, part in zip(halves, parts[::-1], strict=True)]
        parts = [trained(part, OWN) for part in picks]
    model = Model(common, own, trained(picks[0] + picks[1], OWN), share)
    unseen = flat(usual[2::3])
    model.calibrate(model.gains(unseen))
    texts, marks = ordinary[2::3] + toxic[0::4], [0] * len(ordinary[2::3]) + [1] * len(toxic[0::4])
    statistics = np.concatenate([model.statistic(w) for w in windows_of(pa.array(texts, pa.string()))])
    y = np.array(marks, np.float64)
    some = np.isfinite(statistics)
    statistics, y = statistics[some], y[some]
    weights = np.where(y == 1, MISSED * share / max(1.0, y.sum()), (1 - share) / max(1.0, (1 - y).sum())) * len(y)
    model.fit(statistics, y, weights)
    return model


def _text_hash() -> Column:
    return F.xxhash64(F.lit(61), "text")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, toxic."""
    spark = docs.sparkSession
    marked = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy(F.col("doc_id").alias("_rs_id")).agg(F.min("toxic").cast("int").alias("toxic"))
    learned = docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # ids and hashes alone are joined; texts follow for the chosen ones
    hashes = learned.select("doc_id", _text_hash().alias("h")).join(marked, F.col("doc_id") == F.col("_rs_id"))
    texts = hashes.groupBy("h").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_rs_most")).where(F.col("toxic") == F.col("_rs_most")).select("h", "toxic")
    counts = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = counts.get(1, 0) / total if total else 0.0
    if len(counts) < 2:
        return train([], [], share)
    span = 1 << 40
    quota = F.when(F.col("toxic") == 1, min(span, TOXIC * span // counts[1])).otherwise(min(span, ORDINARY * span // counts[0]))
    # about TOXIC + ORDINARY rows of two numbers
    chosen = [(r["h"], r["toxic"]) for r in texts.where(F.pmod(F.xxhash64(F.lit(62), "h"), F.lit(span)) < quota).collect()]
    if not chosen:
        return train([], [], share)
    picked = F.broadcast(spark.createDataFrame(chosen, "_rs_h long, toxic int"))
    first = F.pmod(F.xxhash64(F.lit(63), "text"), F.greatest(F.lit(1), F.length("text") - (PART - 1))) + 1
    part = F.substring(F.col("text"), first.cast("int"), F.lit(PART))
    found = learned.select(_text_hash().alias("h"), "text").join(picked, F.col("h") == F.col("_rs_h")).select("h", "toxic", part.alias("part"))
    each = found.groupBy("h", "toxic").agg(F.min("part").alias("part")).toArrow()  # one part a chosen text
    rows = sorted(zip(each.column(0).to_pylist(), each.column(1).to_pylist(), each.column(2).to_pylist(), strict=True))
    rows = [r for r in rows if r[2].strip()]
    return train([p for _, y, p in rows if y == 0], [p for _, y, p in rows if y == 1], share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of docs."""
    model_of = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            at = 0
            for windows in windows_of(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, windows.texts), pa.array(model.score(windows))], names=["doc_id", "score"])
                at += windows.texts

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    told = score(docs, fit(docs, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
