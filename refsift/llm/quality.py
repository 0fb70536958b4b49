"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration.

Every token has a random index vector with NONZERO entries of +1 or -1, drawn from its hash; a token's vector is the
sum of the index vectors of the tokens within REACH places of it (and its own) over all texts but those of the held-out
fifth, scaled to length one. A word gives two tokens: its lower-cased form, and its shape (runs of letters, capitals, digits and of any other
character collapsed; one shape of its own for a word that repeats the one before it). A document is the mean of its words' and of its shapes' vectors. On these means a network of one
hidden layer is trained in numpy; its logit is divided by a temperature fitted on rows that training left out.

The sums are whole numbers, added up by task and then by bucket, so they are the same however the rows are dealt. The
network is fitted on a sample by hash of about TRAIN_DOCS labelled rows, none of them from the held-out fifth. A score
reads the whole text and nothing else.

Defined cases: a text without words (null, empty, blank) scores 0.0 and is predicted 0; labels that are null or neither
0 nor 1 are left out; of several labels of a document the smallest counts, and of several texts that share an id one is
learned from; with labels of one class or none every other text scores the share of label 1 (0.5 without labels); repeated rows get equal answers; a null doc_id is never held
out; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped, tidy
from .textvec import BLANK, U64, Words, mix64, run_hashes, seeded, slices, string_buffers

DIM = 64
NONZERO = 4
REACH = 2
WORD_BUCKETS, SHAPE_BUCKETS = 1 << 15, 1 << 12
TRAIN_DOCS = 12_000
HIDDEN = 24
EPOCHS = 60
#: predicted is 1 from this score on.
CUT = 0.3

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = 1
_CLASS[65:91] = 2
_CLASS[48:58] = 3
_CLASS[128:] = 1
_CLASS_HASH = seeded(256, 41)
#: The shape of a word that repeats the one before it.
_AGAIN = U64(0x5DEECE66D)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket and shape bucket of each word, and the n + 1 places where texts begin."""
    words = Words(data, offsets)
    kind = _CLASS[data]
    solid = ~BLANK[data]
    head = np.zeros(len(data), bool)
    head[words.starts] = True
    keep = solid.copy()
    keep[1:] &= (kind[1:] != kind[:-1]) | head[1:]
    place = np.flatnonzero(keep)
    starts = np.searchsorted(place, words.starts)
    shapes = run_hashes(_CLASS_HASH[kind[place]], starts)
    again = np.zeros(len(starts), bool)
    again[1:] = words.hashes[1:] == words.hashes[:-1]
    again[words.before[:-1][words.before[:-1] < len(starts)]] = False
    shapes[again] = _AGAIN
    return (words.hashes & U64(WORD_BUCKETS - 1)).astype(np.int32), (shapes & U64(SHAPE_BUCKETS - 1)).astype(np.int32), words.before


class Contexts:
    """Sums of the index vectors of the tokens near each token; an index vector is NONZERO entries of +1 or -1."""

    def __init__(self, buckets: int, seed: int):
        draws = mix64(seeded(buckets * NONZERO, seed)).reshape(buckets, NONZERO)
        self.signs = np.where(draws & U64(1 << 20), 1, -1).astype(np.int64)
        self.places = (draws % U64(DIM)).astype(np.int64)
        self.sums = np.zeros(buckets * DIM, np.int64)

    def add(self, stream: np.ndarray, before: np.ndarray) -> None:
        """stream: tokens of texts; before: places where texts begin."""
        text = np.repeat(np.arange(len(before) - 1), np.diff(before))
        size = 1 << 17
        for at in range(0, len(stream), size):
            for step in range(1, REACH + 1):
                same = at + np.flatnonzero(text[at + step : at + size + step] == text[at : at + size][: max(0, len(text) - at - step)])
                one, two = stream[same].astype(np.int64), stream[same + step].astype(np.int64)
                for mine, other in ((one, two), (two, one)):
                    for j in range(NONZERO):
                        np.add.at(self.sums, mine * DIM + self.places[other, j], self.signs[other, j])

    def rows(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The buckets with sums, and these, in blocks."""
        table = self.sums.reshape(-1, DIM)
        for i in range(0, len(table), 4096):
            some = i + np.flatnonzero(table[i : i + 4096].any(axis=1))
            yield some, table[some]

    def vectors(self) -> np.ndarray:
        """Unit-length token vectors: the sums and the token's own index vector."""
        out = self.sums.reshape(-1, DIM).astype(np.float64)
        for j in range(NONZERO):
            out[np.arange(len(out)), self.places[:, j]] += self.signs[:, j]
        return (out / np.maximum(1e-6, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def pooled(table: np.ndarray, stream: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Mean of the tokens' rows for each text; zeros without tokens."""
    counts = np.diff(before)
    out = np.zeros((len(counts), table.shape[1]), np.float32)
    full = np.flatnonzero(counts)
    step = 1 << 17
    at = 0
    while at < len(full):  # texts of about `step` tokens at once
        to = max(at + 1, int(np.searchsorted(before[full], before[full[at]] + step, "right")) - 1)
        to = min(to, len(full))
        lo, hi = before[full[at]], before[full[to - 1] + 1]
        out[full[at:to]] = np.add.reduceat(table[stream[lo:hi]], before[full[at:to]] - lo, axis=0)
        at = to
    return out / np.maximum(1, counts)[:, None]


class Network:
    """Two layers: tanh(x a + b) c + d, standardised inputs, one temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-4
        order = rng.permutation(len(x))
        held = order[: max(1, len(x) // 5)]
        used = order[len(held) :] if len(order) > 1 else order
        z = ((x - self.mean) / self.scale).astype(np.float64)
        self.w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.w]
        step = 0
        for _ in range(EPOCHS):
            rng.shuffle(used)
            for i in range(0, len(used), 128):
                part = used[i : i + 128]
                hidden = np.tanh(z[part] @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3]) - y[part]) / len(part)
                back = error[:, None] * self.w[2] * (1 - hidden**2)
                slopes = [z[part].T @ back + 1e-4 * self.w[0], back.sum(axis=0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True)]
                step += 1
                for k, g in enumerate(slopes):
                    m, v = moments[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    self.w[k] = self.w[k] - 0.003 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        logits, truth = self._logits(z[held]), y[held]
        grid = np.exp(np.linspace(-2, 3, 101))
        self.temperature = float(grid[int(np.argmin([_loss(logits / t, truth) for t in grid]))])

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _loss(logits: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, logits) - y * logits))


class Vectors:
    """Token vectors and the pooling of texts."""

    def __init__(self, texts: list[str] | None = None):
        self.contexts: tuple[Contexts, Contexts] | None = Contexts(WORD_BUCKETS, 43), Contexts(SHAPE_BUCKETS, 47)
        if texts is not None:
            self.add(*string_buffers(pa.array(texts, pa.string())))
            self.close()

    def add(self, data: np.ndarray, offsets: np.ndarray) -> None:
        words, shapes, before = tokens(data, offsets)
        self.contexts[0].add(words, before)
        self.contexts[1].add(shapes, before)

    def put(self, buckets: np.ndarray, sums: np.ndarray) -> None:
        both = np.zeros((WORD_BUCKETS + SHAPE_BUCKETS, DIM), np.int64)
        both[buckets] = sums
        self.contexts[0].sums, self.contexts[1].sums = both[:WORD_BUCKETS].ravel(), both[WORD_BUCKETS:].ravel()

    def close(self) -> None:
        self.words, self.shapes = (c.vectors() for c in self.contexts)
        self.contexts = None

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, shapes, before = tokens(data, offsets)
        return np.concatenate([pooled(self.words, words, before), pooled(self.shapes, shapes, before)], axis=1)


class Model:
    """What scoring needs. The first layer is linear in the means, so it is applied to the tables beforehand."""

    def __init__(self, vectors: Vectors | None, network: Network | None, share: float):
        self.share = share
        self.network = network
        if network is not None:
            inner = network.w[0] / network.scale[:, None]
            self.words = (vectors.words @ inner[:DIM]).astype(np.float32)
            self.shapes = (vectors.shapes @ inner[DIM:]).astype(np.float32)
            self.bias = network.w[1] - network.mean @ inner

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, shapes, before = tokens(data, offsets)
        some = np.diff(before) > 0
        if self.network is None:
            return np.where(some, self.share, 0.0)
        hidden = np.tanh(pooled(self.words, words, before) + pooled(self.shapes, shapes, before) + self.bias)
        logits = (hidden @ self.network.w[2] + self.network.w[3]) / self.network.temperature
        return np.where(some, _sigmoid(logits), 0.0)


def _draw(column: str, seed: int, rows: int, of: int):
    span = 1 << 40
    return F.pmod(F.xxhash64(F.lit(seed), F.col(column)), F.lit(span)) < min(span, rows * span // max(1, of))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The context sums of a task's texts: as many rows as there are buckets, at most."""
    own = Vectors()
    for batch in batches:
        data, offsets = string_buffers(batch.column(0))
        for i, j in slices(offsets, 1 << 19):  # beside the tables, little memory is left
            own.add(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    for first, contexts in zip((0, WORD_BUCKETS), own.contexts, strict=True):
        for buckets, sums in contexts.rows():
            at = pa.array(np.arange(0, sums.size + 1, DIM, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array((buckets + first).astype(np.int32)), pa.ListArray.from_arrays(at, pa.array(sums.ravel()))], names=["bucket", "v"])


def learn_vectors(texts: DataFrame) -> Vectors:
    """Token vectors of all texts; text is the only column."""
    added = texts.mapInArrow(tidy(_sums), "bucket int, v array<bigint>").groupBy("bucket").agg(*[F.sum(F.get("v", F.lit(i))).alias(f"v{i}") for i in range(DIM)])
    found = added.toArrow()  # a row a bucket, 36,864 at most
    vectors = Vectors()
    vectors.put(found.column(0).to_numpy(), np.stack([found.column(i + 1).to_numpy() for i in range(DIM)], axis=1))
    vectors.close()
    return vectors


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """labels: doc_id, quality."""
    spark = docs.sparkSession
    marked = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = marked.agg(F.count(F.lit(1)), F.sum("quality")).first()
    n, ones = counts[0], counts[1] or 0
    if not 0 < ones < n:
        return Model(None, None, ones / n if n else 0.5)
    # about TRAIN_DOCS ids: a table of a few hundred kilobytes, whatever the size of the corpus
    chosen = F.broadcast(marked.where(_draw("doc_id", 53, TRAIN_DOCS, n)).select(F.col("doc_id").alias("_rs_id"), "quality"))
    whole = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).where(~held_out(F.col("doc_id")))
    vectors = learn_vectors(whole.select("text"))
    vectors_of = shipped(spark, vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = vectors_of()
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets):
                x = vectors.pool(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.ListArray.from_arrays(at, pa.array(x.astype(np.float32).ravel()))], names=["doc_id", "quality", "x"])

    kinds = dict(docs.dtypes)["doc_id"], dict(labels.dtypes)["quality"]
    found = whole.join(chosen, F.col("doc_id") == F.col("_rs_id")).select("doc_id", "text", "quality").mapInArrow(tidy(run), f"doc_id {kinds[0]}, quality {kinds[1]}, x array<float>")
    # one text of each chosen id, however many rows share it
    each = found.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).select("doc_id", "r.*")
    rows = sorted(((r["doc_id"], r["quality"], r["x"]) for r in each.collect()))
    y = np.array([r[1] for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        return Model(None, None, ones / n)
    return Model(vectors, Network(np.array([r[2] for r in rows], np.float64), y), ones / n)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score: one row per row of docs."""
    model_of = shipped(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            data, offsets = string_buffers(batch.column(1))
            for i, j in slices(offsets):
                found = model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found.astype(np.float64))], names=["doc_id", "score"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, score double")


def keep(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """The rows of docs with all their columns that score cut or more, each judged by its own text."""
    model_of = shipped(docs.sparkSession, model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            data, offsets = string_buffers(batch.column(place))
            for i, j in slices(offsets):
                found = model.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield batch.slice(i, j - i).filter(pa.array(found >= cut))

    return docs.mapInArrow(tidy(run), docs.schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for every document."""
    told = score(docs, fit(docs, labels))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))
