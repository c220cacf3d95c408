"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters over WIDTH bytes run over the whole document.  Overlapping chunks of CHUNK bytes,
each starting half a chunk after the one before, are max-pooled per filter; a small hidden layer
turns each chunk's maxima into one logit, and the mean over all chunks gives the probability.
Training is Adam on the whole texts of a bounded sample: at most `max_rows` labelled documents,
chosen by a hash of the id, one row an id.

Scores depend on the text alone.  Null and empty texts are scored as a single empty chunk.
Documents with a null id are never learned from and count as held out.  Repeated rows repeat in
the result; extra columns are ignored by `score` and carried by `keep_good`.  Without labels of
either class every score is 0.5, except that with labels of one class it is that class.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import crc_mod, hash_sample, row_chunks, string_views

WIDTH, FILTERS, HIDDEN, CHUNK = 8, 16, 12, 256
HALF = CHUNK // 2
PAD = 256
MAX_ROWS, EPOCHS = 3000, 6
CUT = 0.3


def lay_out(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each padded to whole half-chunks and by WIDTH at least, and each text's number of half-chunks."""
    sizes = np.diff(offsets)
    halves = np.maximum(2, -(-(sizes + WIDTH) // HALF))
    out = np.full(int(halves.sum()) * HALF + WIDTH, PAD, np.int16)
    starts = np.concatenate([[0], np.cumsum(halves)[:-1]]) * HALF
    shift = np.repeat(starts - offsets[:-1], sizes)
    out[np.arange(len(flat)) + shift] = flat
    return out, halves


def convolve(symbols: np.ndarray, halves: np.ndarray, filters: np.ndarray, tile: int = 1 << 14) -> np.ndarray:
    """Maximum of each filter over each half-chunk of start positions; filters: (WIDTH, 257, FILTERS).

    Starts from which a filter would reach into the next text don't count.
    """
    over = ((np.cumsum(halves) * HALF)[:, None] - np.arange(WIDTH - 1, 0, -1)[None, :]).ravel()
    n = (len(symbols) - WIDTH) // HALF
    out = np.empty((n, filters.shape[2]), np.float32)
    step = tile // HALF
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        x = symbols[lo * HALF : hi * HALF + WIDTH]
        size = (hi - lo) * HALF
        run = filters[0][x[:size]]
        for j in range(1, WIDTH):
            run += filters[j][x[j : j + size]]
        a, b = np.searchsorted(over, (lo * HALF, hi * HALF))
        run[over[a:b] - lo * HALF] = -np.inf
        out[lo:hi] = run.reshape(hi - lo, HALF, -1).max(axis=1)
    return out


class Model:
    """Filters, hidden layer and output of the network."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.filters = (rng.normal(size=(WIDTH, 257, FILTERS)) * 0.2).astype(np.float32)
        self.filters[:, PAD] = 0
        self.hidden = (rng.normal(size=(FILTERS, HIDDEN)) / 4).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = (rng.normal(size=HIDDEN) / 3).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.fixed: float | None = None

    @property
    def parts(self) -> list[np.ndarray]:
        return [self.filters, self.hidden, self.hidden_bias, self.out, self.bias]

    def probability(self, flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of label 1, for each text."""
        n = len(offsets) - 1
        if self.fixed is not None or n == 0:
            return np.full(n, self.fixed or 0.0)
        symbols, halves = lay_out(flat, offsets)
        pooled = convolve(symbols, halves, self.filters)
        ends = np.cumsum(halves)
        chunks = np.maximum(pooled[:-1], pooled[1:])
        last = np.zeros(len(chunks), bool)
        last[ends[:-1] - 1] = True  # would join two texts
        logits = np.tanh(chunks @ self.hidden + self.hidden_bias) @ self.out
        logits[last] = 0
        run = np.concatenate([[0], np.cumsum(logits.astype(np.float64))])
        starts = ends - halves
        mean = (run[ends - 1] - run[starts]) / (halves - 1)
        return 1 / (1 + np.exp(-np.clip(mean + float(self.bias[0]), -30, 30)))


def pooled_at(symbols: np.ndarray, halves: np.ndarray, filters: np.ndarray, tile: int = 1 << 14) -> tuple[np.ndarray, np.ndarray]:
    """Like convolve, with the start position of each maximum."""
    over = ((np.cumsum(halves) * HALF)[:, None] - np.arange(WIDTH - 1, 0, -1)[None, :]).ravel()
    n = (len(symbols) - WIDTH) // HALF
    best, at = np.empty((n, FILTERS), np.float32), np.empty((n, FILTERS), np.int64)
    step = tile // HALF
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        x = symbols[lo * HALF : hi * HALF + WIDTH]
        size = (hi - lo) * HALF
        run = filters[0][x[:size]]
        for j in range(1, WIDTH):
            run += filters[j][x[j : j + size]]
        a, b = np.searchsorted(over, (lo * HALF, hi * HALF))
        run[over[a:b] - lo * HALF] = -np.inf
        grid = np.ascontiguousarray(run.reshape(hi - lo, HALF, FILTERS).transpose(0, 2, 1))
        place = grid.argmax(axis=2)
        best[lo:hi] = np.take_along_axis(grid, place[:, :, None], 2)[:, :, 0]
        at[lo:hi] = place + (np.arange(lo, hi) * HALF)[:, None]
    return best, at


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 0, batch: int = 16) -> Model:
    """Whole texts, a batch of documents at a time."""
    model = Model(seed)
    n = len(labels)
    if n == 0 or labels.min() == labels.max():
        model.fixed = 0.5 if n == 0 else float(labels[0])
        return model
    rng = np.random.default_rng(seed + 1)
    share = labels.mean()
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)) ** 0.5
    m, v, t = [np.zeros_like(p) for p in model.parts], [np.zeros_like(p) for p in model.parts], 0
    columns = np.arange(FILTERS)
    for epoch in range(epochs):
        order = rng.permutation(n)
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for lo in range(0, n, batch):
            docs = order[lo : lo + batch]
            parts = [np.frombuffer(texts[d], np.uint8) for d in docs]
            symbols, halves = lay_out(np.concatenate(parts), np.concatenate([[0], np.cumsum([*map(len, parts)])]))
            best, at = pooled_at(symbols, halves, model.filters)
            inside = np.ones(len(best), bool)
            inside[np.cumsum(halves) - 1] = False  # the last half-chunk of a text begins no chunk
            own = np.flatnonzero(inside)
            second = best[own + 1] > best[own]
            pooled, at = np.where(second, best[own + 1], best[own]), np.where(second, at[own + 1], at[own])
            counts = halves - 1
            owner = np.repeat(np.arange(len(docs)), counts)
            hidden = np.tanh(pooled @ model.hidden + model.hidden_bias)
            logit = np.bincount(owner, hidden @ model.out, len(docs)) / counts + model.bias[0]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            d = ((p - labels[docs]) * weight[docs] / len(docs)).astype(np.float32)
            d_chunk = (d / counts)[owner].astype(np.float32)
            d_hidden = d_chunk[:, None] * model.out[None, :] * (1 - hidden**2)
            d_pooled = (d_hidden @ model.hidden.T).ravel()
            g = [np.zeros_like(p) for p in model.parts]
            for j in range(WIDTH):
                key = symbols[at + j].astype(np.int64) * FILTERS + columns
                g[0][j] = np.bincount(key.ravel(), d_pooled, 257 * FILTERS).reshape(257, FILTERS)
            g[1], g[2], g[3], g[4] = pooled.T @ d_hidden, d_hidden.sum(0), hidden.T @ d_chunk, d.sum(keepdims=True)
            t += 1
            for k, part in enumerate(model.parts):
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] ** 2 - v[k])
                part -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-7)).astype(np.float32)
    return model


def sample(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, modulus: int = 5) -> DataFrame:
    """(doc_id, quality, text): at most `max_rows` labelled documents that may be learned from.

    An id with several labels counts as good if one says so; an id on several rows gives its
    first text in order.  Each task collapses such rows before they move.
    """
    may = labels.where((crc_mod(F.col("doc_id"), modulus) != 0) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    some = may.where(hash_sample(["doc_id"], 17, max_rows, may.count())).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = some.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")  # max_rows rows at most
    return rows.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, epochs: int = EPOCHS, seed: int = 0) -> Model:
    """Train on the bounded sample."""
    got = sorted(map(tuple, sample(docs, labels, max_rows).collect()), key=lambda r: r[0])
    return train([(text or "").encode() for _, _, text in got], np.array([q for _, q, _ in got], np.float64), epochs, seed)


def _scores(model: Model, column: pa.Array) -> np.ndarray:
    offsets, flat = string_views(column)
    parts = [model.probability(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in row_chunks(offsets, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros(0)


def score(docs: DataFrame, model: Model, cut: float = CUT, modulus: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(held.value, batch.column(1)))], ["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == 0, F.lit(True))
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """Rows of docs with a score of at least cut, all columns."""
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(held.value, batch.column(at)) >= cut))

    return docs.mapInArrow(run, docs.schema)
