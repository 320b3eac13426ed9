"""Benchmark decontamination by SimHash over item-sized windows, with Spark functions only.

Windows as long as a benchmark item are laid over a text wherever a shingle it shares with the item puts the item's
beginning; where that reaches beyond the text, a window is both cut at the text's end and moved back inside. Windows and items get SimHash fingerprints of their weighted shingles; a multi-index over blocks of the
fingerprints finds all items of the length the window was laid for within the radius, and the weighted Jaccard similarity of the
shingles, each weighing as often as it occurs, decides.

Only every `stride`-th shingle of a text is looked up. That loses nothing: with similarity s, at most (m - s n) / (1 + s)
of a window's m shingles are missing from an item of n, and the stride is chosen for the items at hand so that any m
shingles in a row hold more looked-up ones than that.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, SIMILARITY = 5, 0.8
#: Fingerprints of this many differing bits are candidates. Weighted Jaccard 0.8 is an angle of 0.476, so 9.7 bits of 64
#: are expected to differ, with a standard deviation of 2.9.
RADIUS = 23
BLOCKS = 8
MAX_STRIDE = 8
#: Words of a text whose shingles are looked up together, a multiple of every stride; each row carries so many words and
#: the longest item's on both sides, however long the text.
CHUNK = 840
#: Item shingles that are broadcast at once; a larger benchmark is searched in blocks of this many.
BROADCAST_SHINGLES = 200_000


def words_of(text: str) -> F.Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), "")


def shingle(words: F.Column, at: F.Column, length: int = WORDS) -> F.Column:
    """Hash of the shingle that begins at word `at` (from 1)."""
    return F.xxhash64(*[F.get(words, at + (k - 1)) for k in range(length)])


def shingles(words: F.Column, length: int = WORDS) -> F.Column:
    """Hashes of all shingles; fewer words than a shingle has make one shingle of all of them, none make none."""
    n = F.size(words)
    return F.when(n >= length, F.transform(F.sequence(F.lit(1), F.greatest(n - (length - 1), F.lit(1))), lambda i: shingle(words, i, length))).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def stride_for(counts: list[int], similarity: float = SIMILARITY, most: int = MAX_STRIDE) -> int:
    """The largest stride with which a window's shingles always hold more looked-up ones than may be missing from the item, for every n in counts."""
    for stride in range(most, 1, -1):
        # c of the window's m <= n shingles are shared: c / (n + m - c) >= s, so m - c <= (m - s n) / (1 + s)
        if all(m // stride > math.floor((m - similarity * n) / (1 + similarity) + 1e-9) for n in counts for m in range(math.ceil(similarity * n - 1e-9), n + 1)):
            return stride
    return 1


def tagged(hashes: F.Column) -> F.Column:
    """Hashes in order, each with how often it came before: as a set this has a multiset's intersections and unions."""
    h = F.sort_array(hashes)
    return F.transform(h, lambda x, i: F.xxhash64(x, i - F.array_position(h, x)))


def simhash(hashes: F.Column) -> F.Column:
    """64-bit SimHash: a bit is 1 if it is set in over half of the hashes, repeats included."""
    zero = F.array(*[F.lit(0)] * 64)
    sums = F.aggregate(hashes, zero, lambda acc, h: F.zip_with(acc, F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.when(F.getbit(h, b) == 1, 1).otherwise(-1)), lambda x, y: x + y))
    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(F.get(sums, b) > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))


def index(items: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """items (item_id, n, fp, ...) under (block, key): every value within radius // blocks bits of the item's own, so
    that a fingerprint within the radius agrees with one of them in one block at least."""
    width = 64 // blocks
    flips = [sum(1 << b for b in c) for d in range(min(radius // blocks, width) + 1) for c in combinations(range(width), d)]
    ways = F.array(*[F.struct(F.lit(k).alias("block"), F.lit(f).cast("long").alias("flip")) for k in range(blocks) for f in flips])
    return items.withColumn("w", F.explode(ways)).select("*", F.col("w.block").alias("block"), block_key(F.col("fp"), F.col("w.block"), width).bitwiseXOR(F.col("w.flip")).alias("key")).drop("w")


def block_key(fp: F.Column, block: F.Column, width: int) -> F.Column:
    return F.call_function("shiftrightunsigned", fp, (block * width).cast("int")).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, start, hamming, similarity): for each document and item it holds, the best window.

    start counts words from 0; ties go to the earliest window. Items that hold fewer words than a shingle, or none,
    can't be told from ordinary text and are left out. Null texts hold nothing. Rows that repeat a doc_id count as one
    document; null ids as one more. Items that repeat an id are all searched, the best wins. Extra columns are ignored;
    empty tables give no rows. Long texts are searched whole, CHUNK words at a time.
    """
    items = benchmark.select("item_id", words_of("text").alias("words")).where(F.size("words") >= WORDS)
    items = items.select("item_id", F.size("words").alias("n"), shingles(F.col("words")).alias("hashes"))
    items = common.stored(items.select("item_id", "n", "hashes", tagged(F.col("hashes")).alias("tags"), simhash(F.col("hashes")).alias("fp")), "items")
    counts = [r.n - WORDS + 1 for r in items.select("n").distinct().collect()]  # lengths of items, not items
    if not counts:
        return docs.select("doc_id").limit(0).withColumns({"item_id": F.lit(0).cast("long"), "start": F.lit(0), "hamming": F.lit(0), "similarity": F.lit(0.0)})
    stride = stride_for(counts, similarity)
    anchors = items.select("n", F.posexplode("hashes").alias("at", "hash")).groupBy("hash").agg(F.collect_set(F.struct("n", "at")).alias("places"))
    anchors = common.stored(anchors, "anchors")
    texts = docs.select("doc_id", words_of("text").alias("words")).where(F.size("words") >= WORDS)
    longest = max(counts) + WORDS - 1
    total_words = F.size("words")
    chunks = F.transform(F.sequence(F.lit(0), total_words - WORDS, F.lit(CHUNK)), lambda c: F.struct(c.alias("from"), F.greatest(c - longest, F.lit(0)).alias("base")))
    texts = texts.select("doc_id", "words", total_words.alias("total"), F.explode(chunks).alias("c"))
    texts = texts.select("doc_id", "total", F.col("c.from").alias("from"), F.col("c.base").alias("base"), F.slice("words", F.col("c.base") + 1, F.lit(CHUNK + 2 * longest + WORDS)).alias("words"))
    looked = F.transform(F.sequence(F.col("from") + 1, F.least(F.col("from") + CHUNK, F.col("total") - (WORDS - 1)), F.lit(stride)), lambda i: F.struct(i.alias("i"), shingle(F.col("words"), i - F.col("base")).alias("hash")))
    texts = texts.select("doc_id", "total", "base", "words", F.explode(looked).alias("x")).select("doc_id", "total", "base", "words", F.col("x.i").alias("i"), F.col("x.hash").alias("hash"))
    total = anchors.count()
    parts = max(1, -(-total // BROADCAST_SHINGLES))
    windows = None
    for part in range(parts):
        some = anchors if parts == 1 else anchors.where(F.pmod(F.xxhash64("hash", F.lit(7)), F.lit(parts)) == part)
        hit = texts.join(F.broadcast(some), "hash").select("doc_id", "total", "base", "words", "i", F.explode("places").alias("p"))
        begin, end = F.col("i") - F.col("p.at"), F.col("i") - F.col("p.at") + F.col("p.n") - 1
        moved = F.greatest(F.least(begin, F.col("total") - F.col("p.n") + 1), F.lit(1))
        # a window beyond the text's ends is taken both cut there and moved inside; within the text the two are one
        ways = F.array_distinct(F.array(*[F.struct(x.alias("start"), y.alias("end")) for x, y in ((F.greatest(begin, F.lit(1)), F.least(end, F.col("total"))), (moved, F.least(moved + F.col("p.n") - 1, F.col("total"))))]))
        hit = hit.select("doc_id", "base", "words", F.col("p.n").alias("n"), F.explode(ways).alias("x"))
        hit = hit.select("doc_id", "n", (F.col("x.start") - 1).alias("start"), F.slice("words", F.col("x.start") - F.col("base"), F.col("x.end") - F.col("x.start") + 1).alias("window"))
        windows = hit if windows is None else windows.unionByName(hit)
    # what is shorter than an item by more than the similarity allows can't be near it
    fits = F.size("window") - (WORDS - 1) >= F.lit(similarity) * (F.col("n") - (WORDS - 1)) - 1e-9
    windows = windows.where(fits).distinct()
    windows = windows.select("doc_id", "n", "start", shingles(F.col("window")).alias("hashes"))
    windows = common.stored(windows.select("doc_id", "n", "start", tagged(F.col("hashes")).alias("wtags"), simhash(F.col("hashes")).alias("wfp")), "windows")
    width = 64 // BLOCKS
    keys = windows.select("doc_id", "n", "start", "wfp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block")).withColumn("key", block_key(F.col("wfp"), F.col("block"), width))
    near = keys.join(common.bounded(index(items.select("item_id", "n", "fp"), radius)), ["n", "block", "key"]).withColumn("hamming", F.bit_count(F.col("wfp").bitwiseXOR(F.col("fp"))).cast("int"))
    near = near.where(F.col("hamming") <= radius).select("doc_id", "n", "start", "wfp", "item_id", "fp", "hamming").distinct()
    again = windows.select(*[F.col(c).alias(f"w_{c}") for c in ("doc_id", "n", "start", "wfp")], "wtags")
    same = F.col("doc_id").eqNullSafe(F.col("w_doc_id"))
    for c in ("n", "start", "wfp"):
        same = same & (F.col(c) == F.col(f"w_{c}"))
    near = near.join(common.bounded(items.select("item_id", "n", "fp", "tags"), 20_000), ["item_id", "n", "fp"]).join(again, same)
    share = F.size(F.array_intersect("tags", "wtags")) / F.size(F.array_union("tags", "wtags"))
    near = near.select("doc_id", "item_id", "start", "hamming", share.alias("similarity")).where(F.col("similarity") >= similarity)
    best = near.groupBy("doc_id", "item_id").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "start", "hamming")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.start").alias("start"), F.col("b.hamming").alias("hamming"), (-F.col("b.s")).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """docs without those that hold a benchmark item; columns as in docs. Rows without a doc_id go if one of them holds an item."""
    found = common.stored(leaks(docs, benchmark, **how).select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(common.bounded(found), F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti")


def op6_simhash_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
