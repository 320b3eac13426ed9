"""Near copies by SimHash, verified by the similarity of their five-word shingles.

Candidates are pairs of texts whose fingerprints, taken over the set of a text's shingles, differ in at most RADIUS bits,
found by simhash's parts, thresholds and lookups. Those whose shingle sets have a Jaccard similarity of 0.8 or more are linked, no others. Two sets
of that similarity are expected to differ in 9.7 of 64 bits, with a standard deviation of 2.9, and in fewer the more
alike they are; 14 is one and a half deviations more.

Where a run of texts is dense, most of them within the radius of one another, each is first compared with its nearest
one alone. Then its texts are searched again, and pairs of different components are compared unless counts of their
shingles show that they can't be alike, so that a large group of near copies is never compared pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, simhash

WORDS, SIMILARITY, RADIUS = 5, 0.8, 14
#: A run with more pairs within the radius than FLOOR and DENSE for each of its entries is dense.
DENSE, FLOOR = 1, 32
#: Parts of the hashes whose shingles are counted; the counts bound what two sets have in common, however they fall.
PARTS = 128
#: Numbers compared at once.
CELLS = 1 << 20


def shingle_set(text: str | None) -> np.ndarray:
    """The text's distinct shingle hashes in ascending order."""
    return np.unique(simhash.shingle_hashes((text or "").encode("utf-8", "surrogatepass"), WORDS))


def set_id(hashes: np.ndarray) -> int:
    """A signed long that stands for the set."""
    h = xxhash.xxh3_64_intdigest(hashes.astype("<u8").tobytes())
    return h - (h >> 63 << 64)


def counts_of(hashes: np.ndarray) -> bytes:
    """How many of the hashes fall into each part; 255 stands for any more."""
    return np.minimum(np.bincount((hashes % np.uint64(PARTS)).astype(np.int64), minlength=PARTS), 255).astype(np.uint8).tobytes()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sizes, fps, counts, held, n = [], [], [], [], [], 0
        for text in batch.column(1):
            s = shingle_set(text.as_py())
            ids.append(set_id(s))
            sizes.append(len(s))
            counts.append(counts_of(s))
            held.append(s)
            n += len(s)
            if n > 100_000:
                fps.append(simhash.fold(held))
                held, n = [], 0
        fps.append(simhash.fold(held))
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(np.concatenate(fps).view(np.int64)), pa.array(counts, pa.binary())], names=["doc_id", "h", "sid", "n", "fp", "counts"])


def possible(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets with these counts (a row each) can have the similarity."""
    most = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    return (most * (1 + similarity) >= similarity * (nx.astype(np.int64) + ny) - 1e-6) | ((x == 255) & (y == 255)).any(axis=1)


def _compare(x: dict[str, np.ndarray], y: dict[str, np.ndarray], radius: int, similarity: float, triangle: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in x, places in y, distances), x by x, of pairs within the radius, of sizes that allow the similarity and of
    different labels; both go by ascending n. With triangle, x is y and pairs count once."""
    at = 0
    while at < len(x["n"]):
        lo = int(np.searchsorted(y["n"], np.ceil(similarity * x["n"][at] - 1e-9)))
        to = at + max(1, min(4096, CELLS // max(1, len(y["n"]) - lo)))
        n, fp = x["n"][at:to], x["fp"][at:to]
        hi = int(np.searchsorted(y["n"], n[-1] / similarity + 1e-9, side="right"))
        hi = min(hi, at + len(n)) if triangle else hi
        if lo < hi:
            far = np.bitwise_count(fp[:, None] ^ y["fp"][None, lo:hi])
            near = far <= radius
            if triangle:
                near &= np.arange(lo, hi)[None, :] < np.arange(at, at + len(n))[:, None]
            i, j = np.nonzero(near)
            if len(i):
                d = far[i, j]
                i, j = i + at, j + lo
                small, large = np.minimum(x["n"][i], y["n"][j]), np.maximum(x["n"][i], y["n"][j])
                ok = (x["label"][i] != y["label"][j]) & (small >= similarity * large - 1e-9)
                if ok.any():
                    yield i[ok], j[ok], d[ok]
        at += len(n)


_RUN = ["part", "sig", "salt", "role", "block", "n", "fp", "rep", "label"]


def _pairs(radius: int, similarity: float, dense: int | None):
    """Of runs in order: candidate pairs (a, b). With dense, a dense run gives each entry's nearest one and (a, null) for
    all that have a near one; without, every pair that the counts, a column more, allow."""
    names = _RUN if dense is not None else [*_RUN, "counts"]

    def close(t: dict[str, np.ndarray]) -> tuple[list, list, list]:
        entry = t["role"] == 0
        e, look = {c: v[entry] for c, v in t.items()}, {c: v[~entry] for c, v in t.items()}
        block = e["block"]
        if len(block) and block.min() != block.max():
            one = block == block.min()
            sides = [({c: v[~one] for c, v in e.items()}, {c: v[one] for c, v in e.items()}, False, True)]
        else:
            sides = [(e, e, True, True), (look, e, False, False)]
        most = None if dense is None else dense * len(block) + FLOOR
        a, b, marks, found = [], [], [], 0
        for x, y, triangle, entries in sides:
            for i, j, d in _compare(x, y, radius, similarity, triangle):
                found += len(i)
                if most is None:
                    ok = possible(x["counts"][i], y["counts"][j], x["n"][i], y["n"][j], similarity)
                    i, j = i[ok], j[ok]
                elif found > most or marks:
                    marks += [np.unique(x["rep"][i]), np.unique(y["rep"][j])]
                    order = np.lexsort((d, i))
                    first = order[np.concatenate(([True], i[order][1:] != i[order][:-1]))]
                    i, j = (i[first], j[first]) if entries else (i[:0], j[:0])
                a.append(x["rep"][i])
                b.append(y["rep"][j])
        if marks:  # what was given before the run was known to be dense may be a part of its pairs
            marks += a + b
        return a, b, marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        out: tuple[list, list, list] = ([], [], [])

        def flush() -> pa.RecordBatch:
            a, b, m = (np.concatenate([*x, np.empty(0, dtype=np.int64)]) for x in out)
            pair, m = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1), axis=0), np.unique(m)
            for x in out:
                x.clear()
            return pa.record_batch([pa.array(np.concatenate((pair[:, 0], m))), pa.concat_arrays([pa.array(np.ascontiguousarray(pair[:, 1])), pa.nulls(len(m), pa.int64())])], names=["a", "b"])

        def take(t: dict[str, np.ndarray]) -> None:
            for x, more in zip(out, close(t), strict=True):
                x.extend(more)

        for batch in batches:
            if not batch.num_rows:
                continue
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _RUN}
            t["fp"] = t["fp"].view(np.uint64)  # bitwise_count takes the absolute value of signed numbers
            if dense is None:
                t["counts"] = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype=np.uint8).reshape(-1, PARTS)
            t = {c: np.concatenate((held[c], t[c])) for c in names} if held else t
            change = np.flatnonzero((t["part"][1:] != t["part"][:-1]) | (t["sig"][1:] != t["sig"][:-1]) | (t["salt"][1:] != t["salt"][:-1])) + 1
            edges = [0, *change.tolist()]
            entries = np.concatenate(([0], np.cumsum(t["role"] == 0)))
            for s, e in zip(edges, edges[1:], strict=False):
                if e - s > 1 and entries[e] > entries[s]:  # lookups that meet no entry have nothing to be compared with
                    take({c: v[s:e] for c, v in t.items()})
            held = {c: v[edges[-1] :] for c, v in t.items()}
            if len(held["role"]) > 8 * simhash.BLOCK and (held["role"] == 1).any():
                # lookups come after the entries of their value: those already compared need not be kept
                take(held)
                own = held["role"] == 0
                held = {c: v[own] for c, v in held.items()}
            yield flush()
        if held:
            take(held)
            yield flush()

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["sid", "hashes"])


def cluster(docs: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS, dense: int = DENSE) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id reachable over pairs of texts of the similarity whose fingerprints are within the radius.

    Texts of the same shingles are searched once, so groups of copies add no pairs. Texts of fewer words than a shingle
    have one of all their words; null and wordless texts are alike. Repeated rows repeat. component_id is null if no row
    of the component has a doc_id. An empty table gives no rows; other columns are ignored. A long text is one row and
    one fingerprint, and is never cut.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = common.stored(keyed.mapInArrow(_described, "doc_id long, h long, sid long, n int, fp long, counts binary"), "described")
    sets = common.stored(rows.groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts")).select("sid", "r.*", "n", "fp", "counts"), "sets")

    def candidates(fps: DataFrame, limit: int | None) -> DataFrame:
        carry = ("n", "label") if limit is not None else ("n", "label", "counts")
        runs = simhash.dealt(fps, simhash.plan(*simhash.bit_stats(fps), radius), carry=carry)
        ordered = runs.repartition("part", "sig", "salt").sortWithinPartitions("part", "sig", "salt", "role", "n")
        return common.stored(ordered.mapInArrow(_pairs(radius, similarity, limit), "a long, b long"), "candidates")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = common.stored(pairs, "pairs")
        # hashes are computed again for the texts in these pairs rather than kept for all
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        some = common.stored(sets.join(wanted, "sid", "left_semi").select("sid", F.col("doc_id").alias("id"), F.col("h").alias("want")), "wanted")
        texts = keyed.join(common.bounded(some), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("want"))).select("sid", "text")
        hashes = common.stored(texts.mapInArrow(_sets, "sid long, hashes array<long>").dropDuplicates(["sid"]), "hashes")
        left, right = hashes.select(F.col("sid").alias("a"), F.col("hashes").alias("x")), hashes.select(F.col("sid").alias("b"), F.col("hashes").alias("y"))
        both = pairs.join(left, "a").join(right, "b").withColumn("k", F.size(F.array_intersect("x", "y")))
        return common.stored(both.where(F.col("k") >= F.lit(similarity) * (F.size("x") + F.size("y") - F.col("k")) - 1e-9).select("a", "b"), "near")

    found = candidates(sets.select("fp", F.col("sid").alias("rep"), "n", F.col("sid").alias("label")), dense)
    near = verified(found.where("b is not null").distinct())
    comp = common.components(near)
    left = found.where("b is null").select(F.col("a").alias("sid")).distinct()
    if left.limit(1).count():
        again = sets.join(left, "sid", "left_semi").join(comp, F.col("sid") == F.col("node"), "left")
        again = common.stored(again.select("fp", F.col("sid").alias("rep"), "n", F.coalesce("component", "sid").alias("label"), "counts"), "dense")
        more = verified(candidates(again, None).distinct())
        near = common.stored(near.unionByName(more), "near")
        comp = common.components(near)
    rows = rows.select("doc_id", "sid").join(comp.withColumnRenamed("node", "sid"), "sid", "left").select("doc_id", F.coalesce("component", "sid").alias("c"))
    rows = common.stored(rows, "members")
    return rows.join(rows.groupBy("c").agg(F.min("doc_id").alias("component_id")), "c").select("doc_id", "component_id")


def dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows and columns as in simhash.dedup."""
    return simhash.one_of_each(docs, cluster(docs, similarity))
