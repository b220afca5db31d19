"""Quality classifier over random-indexing word vectors.

Every word, and every word shape (its runs of capitals, small letters, digits
and signs; a mark of its own where a word repeats the one before), is hashed to
a slot. A slot's vector is the sum of the fixed random index vectors of its
neighbours in the training texts. A text pools the vectors of its slots, and a
two-layer network scores the pool; a temperature fitted on held-back training
rows calibrates its probabilities.

The classifier is fitted on at most ``SAMPLE_PER_CLASS`` labelled texts of each
class. The model is of fixed size and goes with the tasks; scoring is one pass
over the texts without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import BoundedCache, map_slices, utf8

#: Labelled texts of a class that the classifier is fitted on, by smallest hash of the id.
SAMPLE_PER_CLASS = 1500
WORD_SLOTS, SHAPE_SLOTS, DIM, HIDDEN = 4096, 1024, 48, 32
SLOTS = WORD_SLOTS + SHAPE_SLOTS
REPEATED = WORD_SLOTS  # the first shape slot
WINDOW = 2
SEED = 20_240_601


def _index_vectors() -> np.ndarray:
    """Sparse ternary vectors: four entries of +1 or -1 for each slot."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((SLOTS, DIM), np.float32)
    for i in range(SLOTS):
        out[i, rng.choice(DIM, 4, replace=False)] = rng.choice([-1.0, 1.0], 4)
    return out


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one A, a and 0; runs of one sign as that sign."""
    kinds = ("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    out: list[str] = []
    for k in kinds:
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


def _slots(word: bytes) -> int:
    text = word.decode("utf-8", "replace")
    core = re.sub(r"[\W_]+", "", text).lower()
    return (xxhash.xxh3_64_intdigest(core) % WORD_SLOTS) << 16 | (WORD_SLOTS + 1 + xxhash.xxh3_64_intdigest(shape(text)) % (SHAPE_SLOTS - 1))


_CACHE = BoundedCache(_slots, "quality")


def slots(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(word slots, shape slots) of a text in order; empty for a null text."""
    BoundedCache.claim("quality")
    words = (text or b"").split()
    both = np.fromiter(map(_CACHE.__getitem__, words), np.int64, len(words))
    word, form = both >> 16, both & 0xFFFF
    if len(words) > 1:
        form[1:][word[1:] == word[:-1]] = REPEATED
    return word, form


def counts(text: bytes | None) -> np.ndarray:
    return np.bincount(np.concatenate(slots(text)), minlength=SLOTS)


@dataclass
class Network:
    """Slot vectors, input scaling, the two layers and the temperature."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def score(self, slot_counts: np.ndarray) -> np.ndarray:
        return _sigmoid(_logits(self, (pooled(slot_counts, self.vectors) - self.mean) / self.scale) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _logits(net: Network, x: np.ndarray) -> np.ndarray:
    return np.tanh(x @ net.w1 + net.b1) @ net.w2 + net.b2


def pooled(slot_counts: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of a text's words, of its word shapes, and the share of each frequent shape's slot."""
    c = slot_counts.astype(np.float32)
    n = np.maximum(c[:, :WORD_SLOTS].sum(1, keepdims=True), 1)
    words, shapes = c[:, :WORD_SLOTS] / n, c[:, WORD_SLOTS:] / n
    return np.hstack([words @ vectors[:WORD_SLOTS], shapes @ vectors[WORD_SLOTS:]])


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 400, rate: float = 0.02, decay: float = 1e-3) -> tuple:
    """Full-batch Adam on weighted cross entropy."""
    rng = np.random.default_rng(SEED)
    p = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    weight = weight / weight.sum()
    for t in range(1, rounds + 1):
        h = np.tanh(x @ p[0] + p[1])
        d = (_sigmoid(h @ p[2] + p[3]) - y) * weight
        dh = d[:, None] * p[2] * (1 - h * h)
        grads = [x.T @ dh + decay * p[0] / len(x), dh.sum(0), h.T @ d + decay * p[2] / len(x), d.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            p[i] = p[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def _temperature(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    grid = np.geomspace(0.3, 8, 60)
    loss = [-(weight * np.log(np.where(y == 1, q := _sigmoid(z / t), 1 - q) + 1e-12)).sum() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _learned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each training text, and one row with this task's sum of context vectors."""
    index = _index_vectors()
    context = np.zeros((SLOTS, DIM), np.float64)
    seen = False
    for batch in batches:
        out = []
        for text in batch.column(1).to_pylist():
            for ids in slots(text):
                for gap in range(1, WINDOW + 1):
                    a, b = ids[:-gap], ids[gap:]
                    pairs, n = np.unique(np.concatenate([a * SLOTS + b, b * SLOTS + a]), return_counts=True)
                    np.add.at(context, pairs // SLOTS, index[pairs % SLOTS] * n[:, None])
            c = counts(text)
            at = np.flatnonzero(c)
            out.append(np.stack([at, c[at]]).astype(np.uint32).tobytes())
            seen = True
        yield pa.record_batch([batch.column(0).cast(pa.int32()), pa.array(out, pa.binary())], names=["label", "data"])
    if seen:
        yield pa.record_batch([pa.array([None], pa.int32()), pa.array([context.tobytes()], pa.binary())], names=["label", "data"])


def _dense(packed: list[bytes]) -> np.ndarray:
    c = np.zeros((len(packed), SLOTS), np.float32)
    for i, data in enumerate(packed):
        at, n = np.frombuffer(data, np.uint32).reshape(2, -1)
        c[i, at] = n
    return c


#: Tasks of the training pass; each sends one matrix of context sums.
TRAIN_TASKS = 6


def fit(labelled: DataFrame, docs: DataFrame, held_out=None, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network | None:
    """Fit on ``labelled`` (doc_id, label) rows whose id is in ``docs``, without those where ``held_out`` holds.

    Picks the rows by id before any text is read: labels of another value than
    0 and 1, null ids and ids with two different labels teach nothing; of the
    texts of a repeated id the first in byte order teaches. Returns None unless
    both classes have a text.
    """
    rows = labelled.where(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1))
    if held_out is not None:
        rows = rows.where(~held_out)
    rows = rows.groupBy(F.col(doc_id).alias("picked_id")).agg(F.min(label).alias("label"), F.max(label).alias("other")).where(F.col("label") == F.col("other")).drop("other")
    shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if set(shares) != {0, 1}:
        return None
    by_hash = Window.partitionBy("label").orderBy("order", "picked_id")
    drawn = rows.withColumn("order", F.xxhash64("picked_id"))
    for kind, n in shares.items():
        # only about twice the sample is sorted; that fewer than the sample are left has no odds to speak of
        if n > 4 * SAMPLE_PER_CLASS:
            drawn = drawn.where((F.col("label") != kind) | (F.col("order") < -(2**63) + 2**64 * 2 * SAMPLE_PER_CLASS // n))
    picked = drawn.withColumn("nth", F.row_number().over(by_hash)).where(F.col("nth") <= SAMPLE_PER_CLASS).select("picked_id", "label")
    sample = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text")).join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("label", "text", "doc_id")
    # sums of whole numbers: the order of rows and tasks changes nothing
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("row")).select("row.*").coalesce(TRAIN_TASKS)
    found = map_slices(sample, _learned, "label int, data binary").collect()
    rows_ = sorted(((r["label"], bytes(r["data"])) for r in found if r["label"] is not None))
    if {r[0] for r in rows_} != {0, 1}:
        return None
    context = np.sum([np.frombuffer(r["data"], np.float64).reshape(SLOTS, DIM) for r in found if r["label"] is None], axis=0)
    norms = np.linalg.norm(context, axis=1, keepdims=True)
    # a slot that was never met keeps its own index vector, so that it still tells texts apart
    vectors = np.where(norms > 0, context / np.where(norms > 0, norms, 1), _index_vectors() / 2).astype(np.float32)
    del found
    y = np.array([r[0] for r in rows_], np.float64)
    x = np.vstack([pooled(_dense([r[1] for r in rows_[k : k + 128]]), vectors) for k in range(0, len(rows_), 128)]).astype(np.float64)
    del rows_
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / scale
    # the sample is balanced by class; the loss is weighted back to the labels' own shares
    weight = np.where(y == 1, shares[1] / (y == 1).sum(), shares[0] / (y == 0).sum())
    order = np.random.default_rng(SEED).permutation(len(y))
    back = order[: max(2, len(y) // 5)]
    rest = np.setdiff1d(order, back)
    part = Network(vectors, mean, scale, *_train(x[rest], y[rest], weight[rest]), 1.0) if len(set(y[rest])) == 2 else None
    temperature = _temperature(_logits(part, x[back]), y[back], weight[back]) if part is not None else 1.0
    return Network(vectors, mean, scale, *_train(x, y, weight), temperature)


def scored(docs: DataFrame, net: Network | None, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``name``: the probability that a text's quality is 1.

    Null and empty texts get the score of a text without words; without a
    fitted network every score is 1, so that nothing is rejected unjudged.
    """
    keep = docs.columns if keep is None else keep
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], utf8(text).alias("_text_to_score"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` double"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            out = np.ones(len(texts))
            for start in range(0, len(texts), 256) if net is not None else ():
                out[start : start + 256] = net.score(np.stack([counts(t) for t in texts[start : start + 256]]))
            yield pa.record_batch([*batch.columns[:-1], pa.array(out)], names=[*keep, name])

    return map_slices(slim, score, schema)
