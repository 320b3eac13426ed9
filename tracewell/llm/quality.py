"""Document quality by random-indexing word vectors and a small numpy network.

Every hashed word has a sparse random index vector; a word's vector is the sum of the index vectors around its
occurrences, gathered over all documents in whole numbers, so that any order of summing gives the same. Vectors are
pooled for each document and go through a two-layer network, whose probabilities are calibrated by a temperature.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

#: Labelled rows in training, at most: the bound of what the driver collects.
MAX_TRAIN = 8000
#: Hash buckets of words, numbers in a vector, non-zero numbers in an index vector, neighbours on either side.
BUCKETS, DIM, SPARSE, REACH = 1 << 13, 32, 4, 2
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 0.01, 1e-3
#: Rows of vectors that travel together, and partial sums added in one group.
BLOCK, FAN_IN = 512, 128
#: Tokens whose neighbours are summed at once.
CHUNK = 100_000

#: A token is a run of letters and digits or a run of other visible characters.
_TOKEN = re.compile(r"\w+|[^\w\s]+")


def bucket(token: str) -> int:
    return learn.word_hash(token) % BUCKETS


def tokens(text: str, lookup: learn.Lookup) -> np.ndarray:
    return lookup.numbers(_TOKEN.findall(text.lower()))


def index_vectors() -> np.ndarray:
    """(BUCKETS + 1, DIM): SPARSE entries of each row are 1 or -1; the last row is zero."""
    rng = np.random.default_rng(learn.SEED)
    out = np.zeros((BUCKETS + 1, DIM), dtype=np.float32)
    at = np.argsort(rng.random((BUCKETS, DIM)), axis=1)[:, :SPARSE]
    out[np.arange(BUCKETS)[:, None], at] = rng.choice([-1.0, 1.0], (BUCKETS, SPARSE))
    return out


def add_contexts(total: np.ndarray, docs: list[np.ndarray], index: np.ndarray) -> None:
    """Adds to total (BUCKETS, DIM) the index vectors of each token's neighbours, within its document."""
    gap = np.full(REACH, BUCKETS)
    ids = np.concatenate([x for d in docs for x in (gap, d)] + [gap])
    v = index[ids]
    near = np.zeros_like(v)
    for k in range(1, REACH + 1):
        near[k:] += v[:-k]
        near[:-k] += v[k:]
    for j in range(DIM):
        total[:, j] += np.rint(np.bincount(ids, weights=near[:, j], minlength=BUCKETS + 1)[:BUCKETS]).astype(np.int64)


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    total, index, lookup, held, n = np.zeros((BUCKETS, DIM), dtype=np.int64), index_vectors(), learn.Lookup(bucket), [], 0
    for batch in batches:
        for text in batch.column(0):
            if text.is_valid:
                held.append(tokens(text.as_py(), lookup))
                n += len(held[-1])
            if n > CHUNK:
                add_contexts(total, held, index)
                held, n = [], 0
    if held:
        add_contexts(total, held, index)
    part = TaskContext.get().partitionId()
    yield pa.record_batch([pa.array([part] * (BUCKETS // BLOCK), pa.int64()), pa.array(range(BUCKETS // BLOCK), pa.int64()), pa.array([total[k : k + BLOCK].tobytes() for k in range(0, BUCKETS, BLOCK)], pa.binary())], names=["part", "block", "sums"])


def _add(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(BLOCK * DIM, dtype=np.int64)
    for x in rows["sums"]:
        total += np.frombuffer(x, dtype=np.int64)
    return pd.DataFrame({"part": [rows["part"].iloc[0] // FAN_IN], "block": [rows["block"].iloc[0]], "sums": [total.tobytes()]})


def contexts(docs: DataFrame) -> np.ndarray:
    """(BUCKETS, DIM) sums over all documents; a group adds FAN_IN partial sums, level by level, and one matrix reaches the driver."""
    text = docs.select("text")
    parts = text.rdd.getNumPartitions()
    rows = text.mapInArrow(_partial, "part long, block long, sums binary")
    while True:
        rows = rows.groupBy(F.expr(f"part div {FAN_IN}"), "block").applyInPandas(_add, "part long, block long, sums binary")
        parts = -(-parts // FAN_IN)
        if parts <= 1:
            break
    total = np.zeros((BUCKETS, DIM), dtype=np.int64)
    for r in rows.collect():
        total[r.block * BLOCK : (r.block + 1) * BLOCK] += np.frombuffer(r.sums, dtype=np.int64).reshape(BLOCK, DIM)
    return total


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Vectors of length 1 after what all words have in common is taken off; words never seen keep a zero vector."""
    x = sums.astype(np.float64)
    unit = lambda v: v / np.maximum(np.sqrt((v**2).sum(axis=1, keepdims=True)), 1e-9)
    seen = np.abs(x).sum(axis=1, keepdims=True) > 0
    common_part = x.sum(axis=0) / max(np.sqrt((x.sum(axis=0) ** 2).sum()), 1e-9)
    x = unit(x)
    return (unit(x - (x @ common_part)[:, None] * common_part) * seen).astype(np.float32)


def pool(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of a document's word vectors, the length of the mean, how alike neighbours are, and the count."""
    if not len(ids):
        return np.zeros(2 * DIM + 3, dtype=np.float32)
    x = vectors[ids]
    mean = x.mean(axis=0)
    spread = np.sqrt(np.maximum((x * x).mean(axis=0) - mean * mean, 0))
    alike = float(np.einsum("ij,ij->", x[1:], x[:-1])) / max(1, len(ids) - 1)
    return np.concatenate((mean, spread, [np.sqrt((mean * mean).sum()), alike, np.log1p(len(ids)) / 5])).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(((x - self.center) / self.scale) @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def fit(examples: list[tuple[int, str, int]], vectors: np.ndarray) -> Model:
    """Trains on three quarters of the examples and sets the temperature on the rest; the same examples give the same model."""
    rng, lookup = np.random.default_rng(learn.SEED), learn.Lookup(bucket)
    width = 2 * DIM + 3
    x = np.array([pool(tokens(t, lookup), vectors) for _, t, _ in examples], dtype=np.float64).reshape(-1, width)
    y = np.array([v for _, _, v in examples], dtype=np.float64)
    check = np.array([learn.word_hash(str(d)) % 4 == 0 for d, _, _ in examples], dtype=bool) & (len(examples) >= 40)
    train = np.flatnonzero(~check)
    base = x[train] if len(train) else np.zeros((1, width))
    model = Model(vectors, base.mean(axis=0), np.maximum(base.std(axis=0), 1e-3), rng.normal(0, np.sqrt(2 / width), (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), 0.0, 1.0)
    if not len(train):
        return model
    params = [model.w1, model.b1, model.w2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    f2 = s2 = 0.0
    z, t = (x - model.center) / model.scale, 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        order = rng.permutation(train)
        for start in range(0, len(order), BATCH):
            i = order[start : start + BATCH]
            t += 1
            h = np.maximum(z[i] @ model.w1 + model.b1, 0)
            g = (learn.sigmoid(h @ model.w2 + model.b2) - y[i]) / len(i)
            back = np.outer(g, model.w2) * (h > 0)
            for k, d in enumerate((z[i].T @ back, back.sum(axis=0), h.T @ g)):
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                params[k] -= rate * (first[k] / (1 - 0.9**t) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8) + DECAY * params[k])
            f2, s2 = 0.9 * f2 + 0.1 * g.sum(), 0.999 * s2 + 0.001 * g.sum() ** 2
            model.b2 -= rate * (f2 / (1 - 0.9**t)) / (np.sqrt(s2 / (1 - 0.999**t)) + 1e-8)
    part = np.flatnonzero(check) if check.sum() >= 10 else train
    logits = model.logits(x[part])
    loss = lambda c: -np.mean(np.log(np.maximum(learn.sigmoid(np.where(y[part] == 1, 1, -1) * logits / c), 1e-12)))
    model.temperature = float(min(np.exp(np.linspace(-2, 2, 81)), key=loss))
    return model


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lookup = model.value, learn.Lookup(bucket)
        for batch in batches:
            x = np.array([pool(tokens(t.as_py() or "", lookup), m.vectors) for t in batch.column(1)], dtype=np.float64).reshape(-1, 2 * DIM + 3)
            score = learn.sigmoid(m.logits(x) / m.temperature)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for every row, from its whole text alone; null and empty texts get the score of no words.

    Repeated rows repeat, null ids stay, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x DIM numbers
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared, threshold), "doc_id long, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Word vectors from all documents, the network from at most `most` labelled rows."""
    return fit(learn.sample(docs, labels, "quality", most), word_vectors(contexts(docs)))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = MAX_TRAIN) -> DataFrame:
    """docs without rows whose score is below the threshold; columns as in docs. The score depends on the text alone."""
    model = train(docs, labels, most)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, lookup = shared.value, learn.Lookup(bucket)
        at = names.index("text")
        for batch in batches:
            x = np.array([pool(tokens(t.as_py() or "", lookup), m.vectors) for t in batch.column(at)], dtype=np.float64).reshape(-1, 2 * DIM + 3)
            yield batch.filter(pa.array(learn.sigmoid(m.logits(x) / m.temperature) >= threshold))

    return docs.mapInArrow(run, schema)


def op7_random_indexing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", learn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
