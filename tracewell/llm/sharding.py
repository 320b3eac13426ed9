"""Sharding over fixed virtual slots.

Records hash into a few thousand slots whose number never changes. A small table maps slots to shards; it has
versions, and rebalancing edits the map, never the hash. Bytes per slot, summed over all records, tell which slots
to move.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

SLOTS = 4096
MAP_SCHEMA = T.StructType([T.StructField("version", T.IntegerType(), False), T.StructField("vslot", T.IntegerType(), False), T.StructField("shard", T.IntegerType(), False)])


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: shard_of[slot] is the slot's shard."""

    version: int
    n_shards: int
    shard_of: tuple[int, ...]

    @classmethod
    def first(cls, n_shards: int, n_slots: int = SLOTS) -> SlotMap:
        return cls(0, n_shards, tuple(i % n_shards for i in range(n_slots)))

    def rebalanced(self, weight: dict[int, int]) -> SlotMap:
        """The next version: slots move from the fullest shard to the emptiest while that narrows the gap between them."""
        shard_of, load = list(self.shard_of), [0] * self.n_shards
        held: list[list[tuple[int, int]]] = [[] for _ in range(self.n_shards)]
        for slot, shard in enumerate(shard_of):
            load[shard] += weight.get(slot, 0)
            if weight.get(slot, 0):
                held[shard].append((weight[slot], slot))
        for _ in range(4 * len(shard_of)):
            full = max(range(self.n_shards), key=lambda s: (load[s], -s))
            empty = min(range(self.n_shards), key=lambda s: (load[s], s))
            gap = load[full] - load[empty]
            moves = [(abs(gap - 2 * w), slot, w) for w, slot in held[full] if 0 < w < gap]
            if not moves:
                break
            _, slot, w = min(moves)
            held[full].remove((w, slot))
            held[empty].append((w, slot))
            load[full] -= w
            load[empty] += w
            shard_of[slot] = empty
        return SlotMap(self.version + 1, self.n_shards, tuple(shard_of))

    def grown(self, n_shards: int) -> SlotMap:
        """The next version with more shards: each new shard takes an equal part of the slots, and no slot moves elsewhere."""
        shard_of = list(self.shard_of)
        for new in range(self.n_shards, n_shards):
            want = len(shard_of) // (new + 1)
            for _ in range(want):
                count = [0] * (new + 1)
                for s in shard_of:
                    count[s] += 1
                full = max(range(new), key=lambda s: (count[s], -s))
                shard_of[max(i for i, s in enumerate(shard_of) if s == full)] = new
        return SlotMap(self.version + 1, n_shards, tuple(shard_of))


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions stored at a path, none if nothing is there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return []
    return sorted(r.version for r in spark.read.schema(MAP_SCHEMA).parquet(path).select("version").distinct().collect())


def save(spark: SparkSession, maps: list[SlotMap], path: str) -> None:
    """Adds versions to the stored table; earlier versions stay readable, and none is stored twice."""
    if twice := {m.version for m in maps} & set(versions(spark, path)):
        raise ValueError(f"versions {sorted(twice)} are stored already")
    rows = [(m.version, i, s) for m in maps for i, s in enumerate(m.shard_of)]
    spark.createDataFrame(rows, MAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, version: int | None = None) -> SlotMap:
    """A stored version, the newest by default. The table has versions x slots rows, so it may be collected."""
    table = spark.read.schema(MAP_SCHEMA).parquet(path)
    version = max(versions(spark, path)) if version is None else version
    rows = table.where(F.col("version") == version).orderBy("vslot").collect()
    if [r.vslot for r in rows] != list(range(len(rows))) or not rows:
        raise ValueError(f"version {version} of the map isn't whole")
    return SlotMap(version, 1 + max(r.shard for r in rows), tuple(r.shard for r in rows))


def rebalance(spark: SparkSession, path: str, weight: dict[int, int], n_shards: int, n_slots: int = SLOTS) -> SlotMap:
    """The newest stored map (a first one if there is none), edited to balance these bytes per slot, and stored as its
    next version; a map that is balanced already stays as it is. More shards than before take slots of the others."""
    if not versions(spark, path):
        save(spark, [SlotMap.first(n_shards, n_slots)], path)
    old = load(spark, path)
    if len(old.shard_of) != n_slots or old.n_shards > n_shards:
        raise ValueError(f"the stored map has {len(old.shard_of)} slots and {old.n_shards} shards")
    base = old.grown(n_shards) if old.n_shards < n_shards else old
    new = base.rebalanced(weight)
    if new.shard_of == old.shard_of:
        return old
    new = SlotMap(old.version + 1, n_shards, new.shard_of)
    save(spark, [new], path)
    return new


def with_slots(docs: DataFrame, n_slots: int = SLOTS) -> DataFrame:
    """docs with size (UTF-8 bytes plus 1), text_crc32 (of the UTF-8 bytes) and vslot, computed in the scan; a null text counts as empty."""
    return (
        docs.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1)
        .withColumn("text_crc32", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
        .withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"), F.lit(n_slots)).cast("int"))
    )


#: The columns of the result besides doc_id.
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard", "vslot", "map_version")


def shard_documents(docs: DataFrame, n_shards: int = 16, n_slots: int = SLOTS, map_path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's shard under a map balanced by bytes, and its place in the shard (slot, gapless from 0).

    Returns doc_id, `keep`, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null: it only exists for key
    maps), vslot and map_version. The map at map_path is loaded, edited and stored as a new version; without a path, or
    with nothing there, a first one is made. Rows of a shard stand by virtual slot, then doc_id; equal rows are
    interchangeable. A row of the input gives one row of the result: null and repeated keys hash like others, null texts
    count as empty, an empty table gives no rows, a text of any length is one row. Bytes and counts per virtual slot are
    the only things that reach the driver: n_slots rows at any input size. Columns other than doc_id and text are ignored
    unless kept; of kept columns named like one of the result, the result's is returned.
    """
    spark = docs.sparkSession
    keep = tuple(c for c in keep if c != "doc_id" and c not in RESULT)
    rows = with_slots(docs.select("doc_id", "text", *[c for c in keep if c != "text"]), n_slots)
    per_slot = {r.vslot: (r.b, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()}
    current = rebalance(spark, map_path or common.new_path(spark, "slot-map"), {k: b for k, (b, _) in per_slot.items()}, n_shards, n_slots)
    before, used = [], [0] * n_shards
    for i, s in enumerate(current.shard_of):
        before.append((i, s, used[s]))
        used[s] += per_slot.get(i, (0, 0))[1]
    table = spark.createDataFrame(before, "vslot int, shard int, __before long")
    place = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    return (
        rows.select("doc_id", *keep, "size", "text_crc32", "vslot")
        .withColumn("__place", place.cast("long"))
        .join(F.broadcast(table), "vslot")  # n_slots rows
        .select("doc_id", *keep, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("__before") + F.col("__place")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(current.version).alias("map_version"))
    )


def op2_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(common.read(spark, sf_dir, "documents"))
