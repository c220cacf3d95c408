"""Language identification: averaged hashed subword embeddings with a linear softmax, in numpy.

Subwords are byte n-grams of 2, 3 and 4 bytes over the text with ASCII letters lowered and every
other ASCII byte turned into a blank, hashed into BUCKETS embeddings.  The average of a text's
embeddings feeds a linear softmax; both are trained by stochastic gradient descent on the whole
texts of a bounded sample: at most `max_rows` documents, chosen by a hash of the id, one row an id.
A temperature fitted on a part kept back calibrates the probabilities, and a score below the
calibrated `floor` marks the prediction as rejected, without changing it.

At prediction the embeddings are multiplied by the softmax's weights beforehand, so a whole text
costs one table lookup per n-gram.  Null texts and texts without a letter get `und` and score 0,
as do all texts if no language could be learned.  Null ids are never learned from and count as
not held out.  Repeated rows repeat; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partyloom.llm.common import crc_mod, hash_sample, row_chunks, segment_sum, string_views

ORDERS = (2, 3, 4)
BUCKETS, DIM = 1 << 14, 16
MAX_ROWS, EPOCHS = 2500, 6
#: Bytes of one long text that are looked at at once.
TILE = 1 << 20
UNKNOWN = "und"


def _fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    for b in range(128):
        c = chr(b)
        out[b] = ord(c.lower()) if c.isalpha() else 0x20
    return out


FOLD = _fold()
LETTER = np.array([chr(b).isalpha() if b < 128 else False for b in range(256)])


def grams(flat: np.ndarray) -> list[np.ndarray]:
    """Bucket of the n-gram that starts at each byte, for each order; the last starts are missing."""
    x = FOLD[flat].astype(np.uint32)
    out = []
    for n in ORDERS:
        size = max(0, len(x) - n + 1)
        h = np.full(size, 2166136261 ^ n, np.uint32)
        for j in range(n):
            h = (h ^ x[j : j + size]) * np.uint32(16777619)
        out.append(((h ^ (h >> np.uint32(15))) & np.uint32(BUCKETS - 1)).astype(np.int32))
    return out


def tiled(flat: np.ndarray):
    """The buckets of all n-grams of one text, an array for each tile and order."""
    for lo in range(0, len(flat), TILE):
        for order, bucket in zip(ORDERS, grams(flat[lo : lo + TILE + max(ORDERS) - 1]), strict=True):
            yield bucket[: min(TILE, max(0, len(flat) - lo - order + 1))]


@dataclass
class Model:
    """langs and, for each bucket, the calibrated logits; a score below floor counts as rejected."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    floor: float = 0.0

    def predict(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, probability) of each text."""
        n = len(offsets) - 1
        total, count = np.zeros((n, len(self.langs))), np.zeros(n)
        if n == 1 and len(flat) > TILE:  # one long text: sums of tiles, so memory doesn't grow with it
            for bucket in tiled(flat):
                total[0] += self.table[bucket].sum(axis=0, dtype=float)
                count[0] += len(bucket)
            return self._best(total, count)
        for order, bucket in zip(ORDERS, grams(flat), strict=True):
            value = self.table[bucket]
            ends = np.maximum(offsets[1:] - order + 1, offsets[:-1])  # n-grams never cross texts
            run = np.zeros((len(bucket) + 1, len(self.langs)))
            np.cumsum(value, axis=0, out=run[1:])
            some = ends > offsets[:-1]
            total[some] += run[ends[some]] - run[offsets[:-1][some]]
            count += ends - offsets[:-1]
        return self._best(total, count)

    def _best(self, total: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        logits = total / np.maximum(count, 1)[:, None] + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def train(texts: list[bytes], langs: list[str], epochs: int = EPOCHS, seed: int = 0) -> Model | None:
    """None if there is no text to learn from."""
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(k) for k in langs])
    rng = np.random.default_rng(seed)
    emb = (rng.normal(size=(BUCKETS, DIM)) * 0.1).astype(np.float32)
    out, bias = (rng.normal(size=(DIM, len(names))) * 0.3).astype(np.float32), np.zeros(len(names), np.float32)
    bags = []
    for text in texts:
        times = np.zeros(BUCKETS, np.int64)
        for bucket in tiled(np.frombuffer(text, np.uint8)):
            times += np.bincount(bucket, minlength=BUCKETS)
        k = np.flatnonzero(times)
        bags.append((k, (times[k] / max(1, times.sum())).astype(np.float32)))
    order = rng.permutation(len(y))
    back = order[: len(order) // 5]  # kept back for calibration
    learn = order[len(order) // 5 :]
    for epoch in range(epochs):
        rate = np.float32(2.0 * (1 - epoch / epochs) + 0.05)
        for i in rng.permutation(learn):
            k, c = bags[i]
            mean = c @ emb[k]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            d_mean = out @ p
            out -= 0.25 * rate * np.outer(mean, p)
            bias -= 0.1 * rate * p
            emb[k] -= rate * 10 * c[:, None] * d_mean[None, :]
    held = back if len(back) else learn
    z = np.stack([bags[i][1] @ emb[bags[i][0]] @ out + bias for i in held]) if len(held) else np.zeros((0, len(names)))

    def loss(t: float) -> float:
        s = z * t
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(held)), y[held]]).mean())

    t = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0, 2.8, 4.0), key=loss) if len(held) else 1.0
    floor = 0.0
    if len(held):
        s = np.exp(z * t - (z * t).max(axis=1, keepdims=True))
        s /= s.sum(axis=1, keepdims=True)
        right = s.argmax(axis=1) == y[held]
        top = np.sort(s.max(axis=1)[right])
        floor = float(top[int(0.01 * len(top))]) if len(top) else 1.0
    return Model(names, (emb @ out * t).astype(np.float32), (bias * t).astype(np.float64), floor)


def sample(docs: DataFrame, max_rows: int = MAX_ROWS, modulus: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, lang, text): at most `max_rows` documents that may be learned from.

    An id on several rows gives its first language and text in order; each task collapses such
    rows before they move.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where((crc_mod(F.col("doc_id"), modulus) != out) & F.col("lang").isNotNull())
    some = rows.where(hash_sample(["doc_id"], 29, max_rows, rows.count()))
    one = some.groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("r")).select("doc_id", "r.*")
    return one.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(max_rows)


def fit(docs: DataFrame, max_rows: int = MAX_ROWS, modulus: int = 3, out: int = 1, epochs: int = EPOCHS, seed: int = 0) -> Model | None:
    """Train on documents with a language whose crc32(doc_id) mod `modulus` is not `out`."""
    got = sorted(map(tuple, sample(docs, max_rows, modulus, out).collect()), key=lambda r: r[0])
    return train([(text or "").encode() for _, _, text in got], [lang for _, lang, _ in got], epochs, seed)


def has_letter(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    if len(offsets) == 2 and len(flat) > TILE and any(LETTER[flat[a : a + TILE]].any() for a in range(0, len(flat), TILE)):
        return np.ones(1, bool)
    found = segment_sum(LETTER[flat].astype(np.int64), offsets) > 0
    wide = segment_sum((flat >= 128).astype(np.int64), offsets) > 0
    for i in np.flatnonzero(~found & wide).tolist():
        found[i] = any(map(str.isalpha, flat[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8")))
    return found


def predict(docs: DataFrame, model: Model | None, modulus: int = 3, out: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS rows at most

    def run(batches):
        m = held.value
        for batch in batches:
            offsets, flat = string_views(batch.column(1))
            n = len(offsets) - 1
            lang, score = np.full(n, UNKNOWN, object), np.zeros(n)
            if m is not None:
                for a, b in row_chunks(offsets, 1 << 18):
                    part, cut = flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    best, p = m.predict(part, cut)
                    known = has_letter(part, cut)
                    lang[a:b] = np.where(known, np.array(m.langs, object)[best], UNKNOWN)
                    score[a:b] = np.where(known, p, 0.0)
            rejected = score < (m.floor if m is not None else 1.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(rejected)], ["doc_id", "lang_pred", "score", "rejected"])

    done = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), modulus) == out, F.lit(False))
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")
