"""What the trained operators share: the split by doc_id, the bounded labelled sample, and word lookup."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 17
#: Words remembered by a worker; the memory starts anew beyond that.
CACHE = 400_000
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def remainder(doc_id: F.Column) -> F.Column:
    """crc32(doc_id as text) mod 5; a null id counts as the empty text, so it is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def held_out(doc_id: F.Column) -> F.Column:
    return remainder(doc_id) == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> list[tuple[int, str, int]]:
    """(doc_id, text, label) of at most `most` labelled rows outside the held-out fifth, in a fixed pseudo-random order.

    Only this bounded sample reaches the driver. Rows without a label, doc_id or text are no examples.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    known = known.withColumn("h", order).orderBy("h", "doc_id", "y").limit(most)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id")  # at most `most` rows
    rows = rows.orderBy("h", "doc_id", "text").limit(most).select("doc_id", "text", "y").toPandas()
    return list(zip(rows["doc_id"].tolist(), rows["text"].tolist(), rows["y"].tolist(), strict=True))


class Lookup(dict):
    """word -> number, by a function called once for each word while it is remembered."""

    def __init__(self, of: Callable[[str], int], most: int = CACHE) -> None:
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = self.of(word)
        return x

    def numbers(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def bare(word: str) -> str:
    """The word in lower case without what isn't a letter or digit at its ends."""
    return _EDGE.sub("", word.lower())


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    from_, rank = np.unique(score, return_inverse=True)
    counts = np.bincount(rank)
    mid = np.cumsum(counts) - (counts - 1) / 2
    p, n = int((y == 1).sum()), int((y != 1).sum())
    return float((mid[rank][y == 1].sum() - p * (p + 1) / 2) / (p * n)) if p and n else 0.5
