"""Near-duplicates by SimHash, found by the generalised pigeonhole principle.

64-bit fingerprints that differ in at most `radius` bits are linked. The bits are split into parts, correlated bits
together; each part gets its own threshold, from -1 (not searched) up, so that the thresholds sum to
radius - parts + 1: two linked fingerprints then agree within the threshold in one part at least. Thresholds come from
a dynamic programme over estimated rows and candidates. Every fingerprint is entered under its parts' values and looked
up under the values within the thresholds, and candidates are verified by their full distance.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORDS, RADIUS = 4, 4
#: Entries under one value of a part that are compared in one task; more are dealt out in pairs of blocks.
BLOCK = 8192
#: Runs of up to this many rows are compared together, larger ones each on their own.
SMALL_RUN = 64
#: Estimated seconds for a row that is dealt out and for a candidate that is verified.
ROW_S, CANDIDATE_S = 3e-6, 1e-8


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text, repeats included; fewer words make one shingle, none make none.

    bytes.lower() changes A-Z alone, and bytes.split() splits at just the six white-space bytes.
    """
    parts = text.lower().split()
    if not parts:
        return np.empty(0, dtype=np.uint64)
    n = max(len(parts) - words + 1, 1)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    ends = (ends[min(words, len(parts)) - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], 42) for s, e in zip(starts, ends, strict=True)), dtype=np.uint64, count=n)


def fold(hashes: list[np.ndarray]) -> np.ndarray:
    """A fingerprint for each array: a bit is 1 if it is set in over half of the hashes."""
    out, sizes = np.zeros(len(hashes), dtype=np.uint64), np.array([len(h) for h in hashes], dtype=np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        bits = np.unpackbits(np.concatenate([hashes[i] for i in some]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_ = np.add.reduceat(bits, np.concatenate(([0], np.cumsum(sizes[some])[:-1])), axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * set_ > sizes[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprint(text: bytes | None, words: int = WORDS) -> int:
    return int(fold([shingle_hashes(text or b"", words)])[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held, n = [], [], 0
            for text in batch.column(1):
                held.append(shingle_hashes(text.as_py() or b"", words))
                n += len(held[-1])
                if n > 100_000:
                    out.append(fold(held))
                    held, n = [], 0
            out.append(fold(held))
            yield pa.record_batch([batch.column(0), pa.array(np.concatenate(out).view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; null and wordless texts have 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _bit_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, both = 0, np.zeros((64, 64), dtype=np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fp), 65_536):
            bits = np.unpackbits(fp[at : at + 65_536].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            n += len(bits)
            both += np.rint(bits.T @ bits).astype(np.int64)
    if n:
        yield pa.record_batch([pa.array(np.arange(65)), pa.array([*both.tolist(), [n] + [0] * 63], pa.list_(pa.int64()))], names=["i", "v"])


def bit_stats(fps: DataFrame) -> tuple[int, np.ndarray]:
    """(count, 64 x 64 matrix of how often two bits are both set), over all fingerprints; 65 x 64 numbers from Spark's sum."""
    rows = fps.select("fp").mapInArrow(_bit_stats, "i long, v array<long>")
    got = rows.groupBy("i").agg(F.array(*[F.sum(F.col("v")[k]) for k in range(64)]).alias("v")).collect()
    both = {r.i: r.v for r in got}
    return (both[64][0], np.array([both[i] for i in range(64)], dtype=np.float64)) if got else (0, np.zeros((64, 64)))


def group_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """64 bits in `parts` groups of near equal size: each takes the free bit most correlated with what it holds."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = set(range(64)), []
    for k in range(parts):
        size = (64 - sum(map(len, out))) // (parts - k)
        group = [min(free, key=lambda i: (-spread[i], i))]
        free.discard(group[0])
        while len(group) < size:
            best = max(free, key=lambda i: (round(float(corr[i, group].sum()), 9), -i))
            group.append(best)
            free.discard(best)
        out.append(sorted(group))
    return out


def within(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Estimated share of pairs that differ in at most t of the bits, t from 0 to most.

    Bits differ with 2p(1-p); what they have in common is met by counting fewer bits: the effective number of
    a group of correlated bits is its size squared over the sum of its squared correlations.
    """
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    corr = (both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    square = float((corr[np.ix_(bits, bits)] ** 2).sum())
    real = min(len(bits), max(1, round(len(bits) ** 2 / max(square, len(bits)))))
    chances = sorted((2 * p[i] * (1 - p[i]) for i in bits), reverse=True)[:real]
    dist = np.array([1.0])
    for q in chances:
        dist = np.convolve(dist, [1 - q, q])
    return [float(dist[: t + 1].sum()) for t in range(most + 1)]


def lookups(width: int, t: int) -> int:
    """Values within t bits of a part, itself included."""
    return sum(math.comb(width, k) for k in range(t + 1))


def allocate(n: int, both: np.ndarray, groups: list[list[int]], radius: int) -> tuple[float, list[int]]:
    """(estimated seconds, threshold of each part), the least by dynamic programming over the sum of thresholds + 1."""
    n = max(n, 1)  # without any, each plan would cost nothing, the one with the most lookups too
    need, parts = radius + 1, len(groups)
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in groups:
        share, after = within(n, both, bits, radius), {}
        for got, (cost, chosen) in best.items():
            for t in range(-1, min(radius, need - got - 1) + 1):
                # one entry, and half of the other lookups: of two values, the smaller one looks up the larger
                more = 0.0 if t < 0 else n * ROW_S * (1 + (lookups(len(bits), t) - 1) / 2) + n * n / 2 * share[t] * CANDIDATE_S
                if (s := got + t + 1) not in after or cost + more < after[s][0]:
                    after[s] = (cost + more, [*chosen, t])
        best = after
    cost, chosen = best.get(need, (math.inf, []))
    return (cost, chosen) if len(chosen) == parts else (math.inf, [])


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """[(bits of a part, its threshold)] for the number of parts that costs least; parts that aren't searched are left out."""
    options = []
    for parts in range(1, radius + 2):
        groups = group_bits(n, both, parts)
        if max(map(len, groups)) <= 63 or parts == 1:
            cost, chosen = allocate(n, both, groups, radius)
            options.append((cost, parts, list(zip(groups, chosen, strict=False))))
    return [(bits, t) for bits, t in min(options)[2] if t >= 0]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def entries(fps: DataFrame, parts: list[tuple[list[int], int]], carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(entries, lookups): rows (part, sig, role, fp, rep, *carry); entries (role 0) stand under their own value, lookups (role 1) under larger values within the part's threshold."""
    own, other = [], []
    for k, (bits, t) in enumerate(parts):
        mask = sum(1 << b for b in bits)
        own.append(F.struct(F.lit(k).alias("part"), F.lit(_signed(mask)).alias("mask"), F.lit(0).cast("long").alias("flip")))
        for d in range(1, t + 1):
            other += [F.struct(F.lit(k).alias("part"), F.lit(_signed(mask)).alias("mask"), F.lit(_signed(sum(1 << b for b in c))).alias("flip")) for c in combinations(bits, d)]

    def rows(ways: list, role: int) -> DataFrame:
        x = fps.select("fp", "rep", *carry, F.explode(F.array(*ways)).alias("w")) if ways else fps.limit(0).select("fp", "rep", *carry, F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("flip")).alias("w"))
        at = F.col("fp").bitwiseAND(F.col("w.mask"))
        x = x.select(F.col("w.part").alias("part"), at.alias("at"), at.bitwiseXOR(F.col("w.flip")).alias("sig"), F.lit(role).alias("role"), "fp", "rep", *carry)
        return (x.where("sig > at") if role else x).drop("at")

    return rows(own, 0), rows(other, 1)


def dealt(fps: DataFrame, parts: list[tuple[list[int], int]], block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """Entries and lookups as rows (part, sig, salt, role, block, fp, rep, *carry): those that agree in the first three are a run, to be compared.

    A value of a part with over `block` entries is dealt out in pairs of blocks, each a run of its own, so that none
    has the entries of more than two blocks. Only runs of one block have lookups.
    """
    own, other = entries(fps, parts, carry)
    hot = common.stored(own.groupBy("part", "sig").agg(F.count("*").alias("n")).where(F.col("n") > block).withColumn("k", F.ceil(F.col("n") / block).cast("int")).drop("n"), "hot")
    rows = own.unionByName(other)
    plain = rows.withColumns({"salt": F.lit(0), "block": F.lit(0)})
    if hot.limit(1).count():
        joined = rows.join(common.bounded(hot), ["part", "sig"], "left")
        mine = F.when(F.col("role") == 0, F.pmod(F.xxhash64("rep"), F.col("k")).cast("int"))
        split = joined.where("k is not null").withColumn("mine", mine).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        lo, hi = F.least(F.coalesce("mine", "j"), "j"), F.greatest(F.coalesce("mine", "j"), "j")
        split = split.select("part", "sig", "role", "fp", "rep", *carry, (lo * F.col("k") + hi + 1).alias("salt"), F.coalesce("mine", F.lit(0)).alias("block"))
        plain = joined.where("k is null").drop("k").withColumns({"salt": F.lit(0), "block": F.lit(0)}).unionByName(split)
    return plain.select("part", "sig", "salt", "role", "block", "fp", "rep", *carry)


def forest(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint the index of its component's first; each is compared with what isn't reached yet."""
    root, rest = np.arange(len(fp)), np.arange(len(fp))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        first = front[0]
        while len(front) and len(rest):
            found = np.zeros(len(rest), dtype=bool)
            for at in range(0, len(front), 256):
                found |= (np.bitwise_count(fp[front[at : at + 256], None] ^ fp[None, rest]) <= radius).any(axis=0)
            front, rest = rest[found], rest[~found]
            root[front] = first
    return root


def _link_run(fp: np.ndarray, rep: np.ndarray, role: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of one large run: a tree for each component of the entries, and each lookup (or entry of the other block) to the components it meets."""
    inside = (role == 0) & (block == block[role == 0].min()) if (role == 0).any() else role == 0
    fi, ri = fp[inside], rep[inside]
    root = forest(fi, radius)
    a, b = [ri], [ri[root]]
    order = np.argsort(root, kind="stable")
    fi, root = fi[order], root[order]
    first = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1]))) if len(root) else np.empty(0, dtype=np.int64)
    fo, ro = fp[~inside], rep[~inside]
    for at in range(0, len(fo) if len(fi) else 0, 256):
        near = np.bitwise_count(fo[at : at + 256, None] ^ fi[None, :]) <= radius
        x, y = np.nonzero(np.logical_or.reduceat(near, first, axis=1))
        a.append(ro[at : at + 256][x])
        b.append(ri[root[first[y]]])
    a, b = np.concatenate(a), np.concatenate(b)
    return a[a != b], b[a != b]


def _link(radius: int):
    def close(t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Links of whole runs that stand one after another."""
        n = len(t["fp"])
        change = np.flatnonzero(np.concatenate(([True], (t["part"][1:] != t["part"][:-1]) | (t["sig"][1:] != t["sig"][:-1]) | (t["salt"][1:] != t["salt"][:-1]), [True])))
        size = np.diff(change)
        a, b = [], []
        large = np.flatnonzero(size > SMALL_RUN)
        for k in large:
            s = slice(change[k], change[k + 1])
            x, y = _link_run(t["fp"][s], t["rep"][s], t["role"][s], t["block"][s], radius)
            a.append(x)
            b.append(y)
        end = np.repeat(change[1:], size)
        end[np.repeat(size > SMALL_RUN, size)] = 0
        at = np.flatnonzero(end - np.arange(n) > 1)
        step = 1
        while len(at):
            x, y = at, at + step
            ok = (np.bitwise_count(t["fp"][x] ^ t["fp"][y]) <= radius) & (t["role"][x] + t["role"][y] < 2) & (t["rep"][x] != t["rep"][y])
            a.append(t["rep"][x[ok]])
            b.append(t["rep"][y[ok]])
            step += 1
            at = at[end[at] - at > step]
        return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ["part", "sig", "salt", "role", "block", "fp", "rep"], None
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not len(t["fp"]):
                continue
            t["fp"] = t["fp"].view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            t = {c: np.concatenate((held[c], t[c])) for c in names} if held else t
            same = (t["part"] == t["part"][-1]) & (t["sig"] == t["sig"][-1]) & (t["salt"] == t["salt"][-1])
            cut = len(same) if not same.all() else 0
            cut = int(np.flatnonzero(~same)[-1]) + 1 if cut else 0
            if cut:
                a, b = close({c: t[c][:cut] for c in names})
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
            held = {c: t[c][cut:] for c in names}
            # Lookups come after the entries of their value: those already compared need not be kept.
            done = (held["role"] == 1).sum()
            if not cut and done > 4 * BLOCK:
                a, b = close(held)
                yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])
                held = {c: held[c][held["role"] == 0] for c in names}
        if held:
            a, b = close(held)
            yield pa.record_batch([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b) pairs of `rep` of fingerprints (distinct fp, rep) within the radius; enough of them to join every component."""
    rows = dealt(fps, plan(*bit_stats(fps), radius), block)
    return rows.repartition("part", "sig", "salt").sortWithinPartitions("part", "sig", "salt", "role").mapInArrow(_link(radius), "a long, b long")


def cluster(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over fingerprints within the radius.

    Copies share a fingerprint and are searched once, so groups of copies add no pairs. Null and wordless texts have
    fingerprint 0 and are linked like any other. Rows without a doc_id share their fingerprint's component, null if no
    row of it has a doc_id. Repeated rows repeat. An empty table gives no rows; other columns are ignored.
    """
    rows = common.stored(fingerprints(docs, words), "fingerprints")
    fps = common.stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null"), "distinct-fingerprints")
    comp = common.components(links(fps, radius))
    of = fps.join(comp, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; columns as in docs.

    Rows that repeat a doc_id are one document, of which any one row stays; rows without a doc_id all stay.
    """
    return one_of_each(docs, cluster(docs, words, radius))


def one_of_each(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The rows of docs that dedup keeps, out being (doc_id, component_id) for every row."""
    gone = common.stored(out.where("doc_id <> component_id").select("doc_id").distinct(), "dropped")
    twice = common.stored(out.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    kept = docs.join(common.bounded(gone), "doc_id", "left_anti").select(*docs.columns)
    if not twice.limit(1).count():
        return kept
    twice = common.bounded(twice)
    once = kept.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(twice, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster(common.read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
