"""Mixing sources to target weights by fitting word budgets as subset sums.

Documents are counted by exact length for each source. A source's budget is first met in proportion, then length by
length from the longest, and what is then left is met exactly, where the lengths allow it, by bounded-knapsack dynamic
programming. Documents of a length are taken in a seeded order.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SEED = 20_240_601
#: Documents of one source and length are ranked in groups of about this many.
RANK_ROWS = 50_000
#: Words left for the dynamic programme, at least; it also covers twice the longest document there is a choice of.
DP_WORDS = 4096


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Rows (key, source_size) -> (key, source_size, target).

    Sources in the order of key weigh `weights`, repeating, and share `share` times all words; a target stops at `cap`
    times its source, the excess going to the rest by weight. That ends in one level l with target = min(cap * size,
    l * weight): with the sources by cap * size / weight, the first whose level doesn't exceed its own ratio gives l.
    One row per source, so the one-task windows hold source names, not documents.
    """
    order = Window.orderBy("key")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.withColumn("w", w).withColumn("most", F.col("source_size") * F.lit(float(cap))).withColumn("ratio", F.col("most") / F.col("w"))
    up, every = Window.orderBy("ratio", "key"), Window.partitionBy()
    rows = rows.withColumn("capped", F.coalesce(F.sum("most").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.sum("source_size").over(every) * F.lit(float(share)) - F.col("capped")) / F.col("rest"))
    rows = rows.withColumn("l", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "key", "level"))).over(every)["level"])
    return rows.select("key", "source_size", F.least("most", F.coalesce(F.col("l") * F.col("w"), "most")).alias("target"))


def knapsack(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take, at most counts, so that the total comes as near to budget as it can, below it if two are.

    Sums reachable with the first i lengths are the bits of one integer; for each sum the first length that reached it
    is kept, from which the choice is read back. Sums of more than budget and the longest length are never the nearest.
    """
    most = budget + max((s for s, n in zip(lengths, counts, strict=True) if n), default=0)
    reach, full = 1, (1 << (most + 1)) - 1
    first = np.full(most + 1, -1, dtype=np.int32)
    first[0] = 0
    for i, (size, n) in enumerate(zip(lengths, counts, strict=True)):
        if reach == full:
            break
        after, left, step = reach, min(n, most // size), 1
        while left > 0:
            take = min(step, left)
            after |= (after << (take * size)) & full
            left -= take
            step *= 2
        if new := after & ~reach:
            bits = np.unpackbits(np.frombuffer(new.to_bytes(most // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: most + 1]
            first[bits.astype(bool)] = i
        reach = after
    below = (reach & ((1 << (budget + 1)) - 1)).bit_length() - 1
    above = reach >> (budget + 1)
    above = budget + (above & -above).bit_length() if above else below
    at = above if above - budget < budget - below and above > budget else below
    taken = [0] * len(lengths)
    while at:
        i = first[at]
        while at and first[at] == i:  # sums first reached by i come from one that an earlier length reached
            taken[i] += 1
            at -= lengths[i]
    return taken


def fit(lengths: Sequence[int], counts: Sequence[int], target: float, dp_words: int = DP_WORDS) -> tuple[int, list[int]]:
    """(whole copies of every document, how many of each length are taken once more); lengths are positive and differ."""
    total = sum(s * n for s, n in zip(lengths, counts, strict=True))
    goal = round(target)
    if not total or goal <= 0:
        return 0, [0] * len(lengths)
    copies, rest = divmod(goal, total)
    taken = [int(Fraction(rest, total) * n) for n in counts]
    left = rest - sum(s * k for s, k in zip(lengths, taken, strict=True))
    longest = max((s for s, k, n in zip(lengths, taken, counts, strict=True) if k < n), default=0)
    room = min(max(dp_words, 2 * longest), left)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if left - room < lengths[i]:
            continue
        k = min(counts[i] - taken[i], (left - room) // lengths[i])
        taken[i] += k
        left -= k * lengths[i]
    if left > 0:
        open_ = [i for i in range(len(lengths)) if taken[i] < counts[i] and lengths[i] <= 2 * left]
        for i, k in zip(open_, knapsack([lengths[i] for i in open_], [counts[i] - taken[i] for i in open_], left), strict=True):
            taken[i] += k
    return copies, taken


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", ignore_index=True)
    some = rows[rows["size"] > 0]
    copies, taken = fit(some["size"].tolist(), some["n"].tolist(), float(rows["target"].iloc[0]))
    return some.assign(copies=copies, extra=taken)[["key", "size", "n", "source_size", "target", "copies", "extra"]]


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = SEED) -> DataFrame:
    """docs with size, source_size, target and taken (words that the mix takes of the row: size times 0, 1 or 2).

    Sources stand by code point, null last. Size is the number of words; null and empty texts have none and are never
    taken, in a source of their own they get target 0. Every row is ranked on its own, so repeated rows are taken up
    to the exact count; equal rows are interchangeable. The plan (copies and extra documents for each source and
    length) grows with distinct lengths, not documents. Other columns pass through, except those named like results
    and those that start with two underscores. An empty table gives no rows.
    """
    given = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken") and not c.startswith("__")]
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("t"))
    base = docs.select(*given, key.alias("__key"), common.word_count("text").alias("size") if "text" in docs.columns else "size")
    counts = common.stored(base.groupBy(F.col("__key").alias("key"), "size").agg(F.count("*").alias("n")), "lengths")
    goal = targets(counts.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap)
    goal = common.stored(goal, "targets")
    plan = counts.join(common.bounded(goal), "key").groupBy("key").applyInPandas(_fit_source, "key string, size long, n long, source_size long, target double, copies long, extra long")
    plan = common.stored(counts.join(common.bounded(goal), "key").join(plan.select("key", "size", "copies", "extra"), ["key", "size"], "left"), "mix-plan")
    plan = plan.select(F.col("key").alias("__key"), "size", F.col("n").alias("__n"), "source_size", "target", F.coalesce("copies", F.lit(0)).alias("__copies"), F.coalesce("extra", F.lit(0)).alias("__extra"))
    order = F.xxhash64(F.lit(seed), F.col("doc_id"))
    groups = F.ceil(F.col("__n") / RANK_ROWS)
    rows = base.join(common.bounded(plan), ["__key", "size"]).withColumn("__h", order).withColumn("__g", F.pmod(F.shiftrightunsigned("__h", 20), groups))
    chosen = rows.where("__extra > 0 and __extra < __n")
    # Ranks run over the groups of a length one after another; the groups' own counts say where each begins.
    begin = chosen.where(F.col("__n") > RANK_ROWS).groupBy("__key", "size", "__g").agg(F.count("*").alias("__c"))
    begin = begin.withColumn("__b", F.sum("__c").over(Window.partitionBy("__key", "size").orderBy("__g").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("__c")).drop("__c")
    rank = F.row_number().over(Window.partitionBy("__key", "size", "__g").orderBy("__h", "doc_id"))
    chosen = chosen.withColumn("__r", rank).join(common.bounded(common.stored(begin, "mix-begin")), ["__key", "size", "__g"], "left")
    more = F.when(F.col("__r") + F.coalesce("__b", F.lit(0)) <= F.col("__extra"), 1).otherwise(0)
    plain = rows.where("not (__extra > 0 and __extra < __n)").withColumn("__more", F.when(F.col("__extra") > 0, 1).otherwise(0))
    out = [*given, "size", "source_size", "target", (F.col("size") * (F.col("__copies") + F.col("__more"))).alias("taken")]
    return plain.select(*out).unionByName(chosen.withColumn("__more", more).select(*out))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: documents it takes twice stand there twice, those it doesn't take are gone; columns as in docs, those
    too that are named like a result of mix."""
    own = {c: f"kept column {i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "source")}
    rows = mix(docs.withColumnsRenamed(own), **how)
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return rows.withColumn("__times", times).where("__times > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), "__times"))).select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def op9_budget_fitting(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "source", common.word_count("text").alias("size"))
    return mix(common.stored(docs, "sizes")).select("doc_id", "size", "source_size", "target", "taken")
