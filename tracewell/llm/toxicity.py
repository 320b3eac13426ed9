"""Toxicity by a convolutional text classifier, trained in numpy.

Words, and their first four and six letters, are hashed to embeddings, which add up; filters of several widths slide over
the whole text; each filter's largest response goes into a linear layer. Thresholds are calibrated for each language, which is told from the text by its function words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, learn

#: Labelled rows in training, at most; words and word beginnings with an embedding, at most. They bound the driver's work.
MAX_TRAIN, MAX_VOCAB = 6000, 120_000
#: Examples below which several starts are tried, and how many.
FEW, STARTS = 1000, 7
#: Word beginnings of these lengths are embedded too.
HEADS = (4, 6)
DIM, WIDTHS, FILTERS, EPOCHS, BATCH, RATE = 12, (1, 2, 3), 12, 4, 16, 0.01
#: Frequent function words; the language whose words occur most is the text's.
FUNCTION_WORDS = {
    "en": "the of and to is that it was for on are with as be this by at from".split(),
    "de": "der die und das ist von den mit sich des auf für ein eine nicht zu".split(),
    "fr": "le et les des est dans que pour une du sur par qui au avec pas".split(),
    "es": "el los las y por con para del como se su al lo más un una no".split(),
}
LANGUAGES = [*FUNCTION_WORDS, "other"]


def keys(word: str) -> list[int]:
    """Hashes of the bare word and of its beginnings, where it is longer."""
    w = learn.bare(word)
    return [learn.word_hash(w), *(learn.word_hash(f"{w[:k]}\x00") if len(w) > k else 0 for k in HEADS)]


class Words:
    """Numbers of words by the embedding rows they add up: number k has rows sets[k]; number 0 has none.

    With an embedding, vectors holds their sums. Beyond learn.CACHE numbers everything starts anew, between texts.
    """

    def __init__(self, rows: dict[int, int], embedding: np.ndarray | None = None) -> None:
        self.rows, self.embedding = rows, embedding
        self.code = {w: k + 1 for k, ws in enumerate(FUNCTION_WORDS.values()) for w in ws}
        self.clear()

    def clear(self) -> None:
        self.sets: list[tuple[int, ...]] = [(0,) * (1 + len(HEADS))]
        self.known, self.done = {self.sets[0]: 0}, 0
        self.table = np.zeros((1024, DIM), dtype=np.float32)
        self.lookup = learn.Lookup(self.of)

    def of(self, word: str) -> int:
        x = tuple(self.rows.get(h, 0) for h in keys(word))
        if x not in self.known:
            self.known[x] = len(self.sets)
            self.sets.append(x)
        return self.known[x] * 8 + self.code.get(learn.bare(word), 0)

    def numbers(self, text: str) -> tuple[np.ndarray, int]:
        """(number of each word, language of the text)."""
        if self.embedding is not None and len(self.sets) > learn.CACHE:
            self.clear()
        return split_codes(self.lookup.numbers(text.split()))

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        n = len(self.sets)
        if n > self.done:
            while n > len(self.table):
                self.table = np.concatenate((self.table, np.zeros_like(self.table)))
            self.table[self.done : n] = self.embedding[np.array(self.sets[self.done :])].sum(axis=1)
            self.done = n
        return self.table[ids]


@dataclass
class Model:
    rows: dict[int, int]  # hash -> row of the embedding; row 0 stands for all else and stays 0
    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width (width, DIM, FILTERS)
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: np.ndarray  # logit at which each language's score is 0.5
    slope: float = 1.0

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From a text's word vectors: (largest response of each filter, at least 0; where it begins, -1 for 0)."""
        top, at = [], []
        for width, k in zip(WIDTHS, self.filters, strict=True):
            n = len(x) - width + 1
            if n < 1:
                top.append(np.zeros(FILTERS, dtype=np.float32))
                at.append(np.full(FILTERS, -1))
                continue
            y = x[:n] @ k[0]
            for j in range(1, width):
                y += x[j : n + j] @ k[j]
            best = y.argmax(axis=0)
            top.append(y[best, np.arange(FILTERS)])
            at.append(best)
        top, at = np.concatenate(top) + self.bias, np.concatenate(at)
        return np.maximum(top, 0), np.where(top > 0, at, -1)

    def logit(self, x: np.ndarray) -> float:
        return float(self.pooled(x)[0] @ self.out + self.out_bias)


def split_codes(codes: np.ndarray) -> tuple[np.ndarray, int]:
    """(rows, language) from Lookup's numbers."""
    votes = np.bincount(codes & 7, minlength=len(LANGUAGES))[1 : len(LANGUAGES)]
    return codes >> 3, int(votes.argmax()) if votes.any() else len(LANGUAGES) - 1


def fit(examples: list[tuple[int, str, int]], epochs: int = EPOCHS) -> Model:
    """Trains on three quarters of the examples and calibrates thresholds on the rest; the same examples give the same model.

    Where there are fewer than FEW examples a single start may learn them by heart: of STARTS the one is kept that
    ranks the calibration part best.
    """
    if len(examples) >= FEW:
        return _fit(examples, epochs, learn.SEED)[0]
    return max((_fit(examples, epochs, learn.SEED + k) for k in range(STARTS)), key=lambda m: m[1])[0]


def _fit(examples: list[tuple[int, str, int]], epochs: int, seed: int) -> tuple[Model, float]:
    """(model, area under the curve on the part that calibrates it)."""
    rng = np.random.default_rng(seed)
    seen: dict[int, int] = {}
    for _, text, _ in examples:
        for w in {h for w in set(text.split()) for h in keys(w)} - {0}:
            seen[w] = seen.get(w, 0) + 1
    often = sorted((w for w, n in seen.items() if n > 1), key=lambda w: (-seen[w], w))[:MAX_VOCAB]
    rows = {w: i + 1 for i, w in enumerate(often)}
    fan = {w: np.sqrt(1.0 / (w * DIM)) for w in WIDTHS}
    embedding = rng.normal(0, 0.1, (len(rows) + 1, DIM)).astype(np.float32)
    embedding[0] = 0
    model = Model(rows, embedding, [rng.normal(0, fan[w], (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS], np.zeros(FILTERS * len(WIDTHS), dtype=np.float32), rng.normal(0, 0.3, FILTERS * len(WIDTHS)).astype(np.float32), 0.0, np.zeros(len(LANGUAGES)))
    if not examples:
        return model, 0.5
    words = Words(rows)
    data = [(*words.numbers(t), y) for _, t, y in examples]
    sets = np.array(words.sets)
    vectors = lambda ids: model.embedding[sets[ids]].sum(axis=1)
    check = np.array([learn.word_hash(str(d)) % 4 == 0 for d, _, _ in examples]) & (len(examples) >= 40)
    train = np.flatnonzero(~check)
    positive = max(1, sum(data[i][2] for i in train))
    weight = {1: min(10.0, max(1.0, 0.5 * len(train) / positive)), 0: 1.0}
    params = {"bias": model.bias, "out": model.out, **{f"k{i}": k for i, k in enumerate(model.filters)}}
    square = {n: np.full_like(p, 1e-8) for n, p in params.items()}
    rows_square = np.full(len(embedding), 1e-8, dtype=np.float32)
    for epoch in range(epochs):
        rate = RATE / (1 + epoch / 2)
        order = rng.permutation(train)
        for start in range(0, len(order), BATCH):
            grads, where, moves, total = {n: np.zeros_like(p) for n, p in params.items()}, [], [], 0.0
            for i in order[start : start + BATCH]:
                ids, _, y = data[i]
                x = vectors(ids)
                top, at = model.pooled(x)
                g = float(learn.sigmoid(np.array(top @ model.out + model.out_bias)) - y) * weight[y] / BATCH
                total += g
                grads["out"] += g * top
                flow = np.where(at >= 0, g * model.out, 0).astype(np.float32)
                grads["bias"] += flow
                for f in np.flatnonzero(at >= 0):
                    wi, k = divmod(int(f), FILTERS)
                    span = slice(at[f], at[f] + WIDTHS[wi])
                    grads[f"k{wi}"][:, :, k] += flow[f] * x[span]
                    where.append(sets[ids[span]].ravel())
                    moves.append(np.repeat(flow[f] * model.filters[wi][:, :, k], sets.shape[1], axis=0))
            for n, p in params.items():
                square[n] = 0.95 * square[n] + 0.05 * grads[n] ** 2
                p -= rate * (grads[n] / np.sqrt(square[n] + 1e-6) + 1e-4 * p)
            model.out_bias -= rate * total * 4
            if where:
                span, move = np.concatenate(where), np.concatenate(moves)
                rows_, back = np.unique(span, return_inverse=True)
                sums = np.zeros((len(rows_), DIM), dtype=np.float32)
                np.add.at(sums, back, move)
                rows_square[rows_] += (sums**2).mean(axis=1)
                model.embedding[rows_] -= 5 * rate * sums / np.sqrt(rows_square[rows_] + 1e-6)[:, None]
                model.embedding[0] = 0
    part = np.flatnonzero(check) if check.sum() >= 10 else train
    logits, truth, langs = np.array([model.logit(vectors(data[i][0])) for i in part]), np.array([data[i][2] for i in part]), np.array([data[i][1] for i in part])
    model.thresholds[:] = best_threshold(logits, truth)
    for k in range(len(LANGUAGES)):
        own = langs == k
        if truth[own].sum() >= 5 and (1 - truth[own]).sum() >= 5:
            model.thresholds[k] = best_threshold(logits[own], truth[own])
    return model, learn.auc(logits, truth)


def best_threshold(logits: np.ndarray, y: np.ndarray) -> float:
    """Midway between the two logits where cutting gives the best F1; 0 without both labels. The lower of equal cuts lies higher."""
    if not len(y) or y.min() == y.max():
        return 0.0
    order = np.argsort(-logits, kind="stable")
    s, t = logits[order], y[order]
    hit = np.cumsum(t)
    f1 = 2 * hit / (np.arange(1, len(t) + 1) + t.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k] - 1)


def _score(model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        words = Words(m.rows, m.embedding)
        for batch in batches:
            x = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(1)):
                ids, language = words.numbers(text.as_py() or "")
                x[i] = m.logit(words.vectors(ids)) - m.thresholds[language]
            score = learn.sigmoid(m.slope * x)
            yield pa.record_batch([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) for every row, from its whole text alone; null and empty texts get the score of no words.

    Repeated rows repeat, null ids stay, an empty table gives no rows, other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by MAX_VOCAB
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score(shared, threshold), "doc_id long, score double, predicted int")


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """A model fit to at most `most` labelled rows; without any it gives every text the same score."""
    return fit(learn.sample(docs, labels, "toxic", most))


def op5_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", learn.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
