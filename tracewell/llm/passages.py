"""Removal of repeated passages by hashing units.

Two kinds of unit are digested: whole lines, and pieces of lines. Lines are cut into sentences, short sentences join the
one before, and long units are cut at words their own content picks: after the word with the least hash of every WINDOW
words in a row, so that cuts are never more than WINDOW words apart. Where a cut falls depends on what is near it alone, so
that a passage falls into the same units whatever stands around it. Digests are grouped over all documents, the earliest
occurrence (by doc_id, then offset) is kept, and others are removed: whole lines of any length, pieces in runs of RUN_WORDS
words. Whole lines alone would miss passages that stand inside a line.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Sentences of fewer words than SHORT join the one before in their line; units of more words than LONG are cut after the
#: word with the least CRC-32 (the last of equals) of every WINDOW words in a row.
SHORT, LONG, WINDOW = 5, 14, 8
#: A run of repeated pieces is removed from this many words on. A passage of 50 words holds one: at its beginning at most
#: max(LONG, 2 WINDOW - 1) = 15 words fall into pieces that its surroundings bear on, at its end SHORT - 1 more.
RUN_WORDS = 16

_BREAK = re.compile(r"(?<=[.!?])[ \t\r\f\v]+|[ \t\r\f\v]*\n\s*")
_WORD = re.compile(r"\S+")


def lines(text: str, found: list[tuple[int, int, list[str]]]) -> Iterator[tuple[int, int]]:
    """(first unit, number of units) of each line that has words, found being the text's units."""
    first = 0
    for k in range(1, len(found) + 1):
        if k == len(found) or "\n" in text[found[k - 1][1] : found[k][0]]:
            yield first, k - first
            first = k


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, lower-case words) of each unit of the text, in order; offsets count characters."""
    whole: list[tuple[int, int, list[str]]] = []
    at, line_start = 0, True
    for m in [*_BREAK.finditer(text), None]:
        end, after = m.span() if m else (len(text), len(text))
        words = text[at:end].lower().split()
        if words and len(words) < SHORT and not line_start:
            whole[-1] = (whole[-1][0], end, whole[-1][2] + words)
        elif words:
            whole.append((at, end, words))
            line_start = False
        if m and "\n" in m[0]:
            line_start = True
        at = after
    out = []
    for start, end, words in whole:
        if len(words) <= LONG:
            out.append((start, end, words))
            continue
        found = [(m.start(), m.end(), m[0].lower()) for m in _WORD.finditer(text, start, end)]
        crc = [zlib.crc32(w.encode("utf-8", "surrogatepass")) for _, _, w in found]
        ranks = [(c, -k) for k, c in enumerate(crc)]
        cuts = sorted({-min(ranks[k : k + WINDOW])[1] + 1 for k in range(len(ranks) - WINDOW + 1)} | {len(found)})
        begin = 0
        for cut in cuts:
            out.append((found[begin][0], found[cut - 1][1], [w for _, _, w in found[begin:cut]]))
            begin = cut
    return out


_NAMES = ["doc_id", "pos", "span", "words", "covers", "hash", "check"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()]
#: So many texts are Python's at once, and so many digests (and those of one text) before they go to Spark.
_TEXTS, _ROWS = 256, 16_384


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all pieces, and of lines of several pieces from their first on; covers is how many pieces a whole line has, 0 for a piece of one."""
    cols: list[list] = [[] for _ in _NAMES]
    for part in (b.slice(at, _TEXTS) for b in batches for at in range(0, b.num_rows, _TEXTS)):
        for doc_id, row, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
            found = units(text or "")
            rows = [(k, start, end, words, 0, " ".join(words)) for k, (start, end, words) in enumerate(found)]
            for k, n in lines(text or "", found):
                words = [w for _, _, ws in found[k : k + n] for w in ws]
                if n == 1:
                    rows[k] = (*rows[k][:4], 1, rows[k][5])
                else:
                    rows.append((k, found[k][0], found[k + n - 1][1], words, n, "\n" + " ".join(words)))
            for k, start, end, words, covers, key in rows:
                d = xxhash.xxh3_128_intdigest(key.encode("utf-8", "surrogatepass"))
                h = d >> 64
                for c, v in zip(cols, (doc_id, row << 32 | k, start << 32 | end, len(words), covers, h - (h >> 63 << 64), d & 0x7FFFFFFF), strict=True):
                    c.append(v)
            if len(cols[0]) >= _ROWS:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)
                cols = [[] for _ in _NAMES]
    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=_NAMES)


def _late(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in the order of digest, doc_id and pos: all but each digest's first occurrence, with its doc_id as kept."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        doc, pos, span, words, covers, h, check = (batch.column(c) for c in _NAMES)
        null, ids = doc.is_null().to_numpy(zero_copy_only=False), doc.fill_null(0).to_numpy()
        pos, h, check = pos.to_numpy(), h.to_numpy(), check.to_numpy()
        new = np.concatenate(([last is None or last[:2] != (h[0], check[0])], (h[1:] != h[:-1]) | (check[1:] != check[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
        before = at < 0  # these belong to the digest that the batch before ended in
        first = [np.where(before, last[k] if last else 0, x[at]) for k, x in ((2, null), (3, ids), (4, pos))]
        late = (first[0] != null) | (first[1] != ids) | (first[2] != pos)
        last = (h[-1], check[-1], first[0][-1], first[1][-1], first[2][-1])
        keep = pa.array(late)
        kept = pa.array(first[1][late], pa.int64(), mask=first[0][late].astype(bool))
        yield pa.record_batch([*(batch.column(c).filter(keep) for c in _NAMES[:5]), kept], names=[*_NAMES[:5], "kept"])


def text_key() -> F.Column:
    """31 bits that tell texts of one doc_id apart."""
    return F.xxhash64("text").bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """Removed runs: (doc_id, row, start, end, words, kept_in), kept_in being the documents that keep the text.

    row is a hash of the text, which tells rows of one doc_id apart; rows that agree in both count as one document, so
    they are never removed in favour of each other. A null or empty text has no units. Null ids rank first. Repeats inside
    one document are removed too. Other columns are ignored.

    Digests have 95 bits. All are dealt out once, and only later occurrences come back, dealt out by text once more; the
    rest is done there, and nothing is stored on the way. pos packs row and unit, span packs start and end, to keep the
    shuffle narrow.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_key().alias("row"), "text")
    found = rows.mapInArrow(_digest, "doc_id long, pos long, span long, words int, covers int, hash long, check int")
    dealt = found.repartition("hash", "check").sortWithinPartitions("hash", "check", F.asc_nulls_first("doc_id"), "pos")
    late = dealt.mapInArrow(_late, "doc_id long, pos long, span long, words int, covers int, kept long")
    unit = F.col("pos").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")
    late = late.select("doc_id", F.shiftright("pos", 32).alias("row"), unit.alias("unit"), "span", "words", "covers", "kept").repartition("doc_id", "row")
    # a whole line stands for each of its pieces, its words being counted at the first
    late = late.withColumn("k", F.explode(F.sequence(F.lit(0), F.greatest("covers", F.lit(1)) - 1)))
    start, end = F.shiftright("span", 32).cast("int"), F.col("span").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).cast("int")
    late = late.select("doc_id", "row", (F.col("unit") + F.col("k")).alias("unit"), F.struct("covers", start.alias("start"), end.alias("end"), F.when(F.col("k") == 0, F.col("words")).otherwise(0).alias("words"), "kept").alias("x"))
    late = late.groupBy("doc_id", "row", "unit").agg(F.max("x").alias("x")).select("doc_id", "row", "unit", "x.*")
    order = Window.partitionBy("doc_id", "row").orderBy("unit")
    runs = late.withColumn("island", F.col("unit") - F.row_number().over(order))
    runs = runs.withColumn("run", F.sum("words").over(Window.partitionBy("doc_id", "row", "island"))).where((F.col("covers") > 0) | (F.col("run") >= run_words))
    runs = runs.withColumn("island", F.col("unit") - F.row_number().over(order))
    runs = runs.groupBy("doc_id", "row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("words"), F.sort_array(F.collect_set("kept")).alias("kept_in"))
    return runs.drop("island")


def spans(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """One row for each document that loses text: (doc_id, row, spans, n_spans, removed_words, removed_chars, kept_in)."""
    runs = repeats(docs, run_words)
    by = runs.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"), F.count("*").alias("n_spans"), F.sum("words").alias("removed_words"), F.sum(F.col("end") - F.col("start")).alias("removed_chars"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("kept_in")))).alias("kept_in"))
    return by


def remove(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs without the repeated runs, with removed_spans (offsets in the original text; an empty array if there are none)."""
    cut = spans(docs, run_words).select(F.col("doc_id").alias("__id"), F.col("row").alias("__row"), F.col("spans").alias("removed_spans"))
    keyed = docs.drop("removed_spans").withColumn("__r", text_key())
    out = keyed.join(common.bounded(common.stored(cut, "spans")), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__r") == F.col("__row")), "left").drop("__id", "__row", "__r")
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = out.withColumn("removed_spans", F.coalesce("removed_spans", none))
    edges = F.concat(F.array(F.lit(0)), F.flatten(F.transform("removed_spans", lambda s: F.array(s["start"], s["end"]))), F.array(F.length("text")))
    keep = F.transform(F.sequence(F.lit(0), F.size("removed_spans")), lambda i: F.substring(F.col("text"), F.element_at(edges, 2 * i + 1) + 1, F.element_at(edges, 2 * i + 2) - F.element_at(edges, 2 * i + 1)))
    return out.withColumn("text", F.when(F.size("removed_spans") > 0, F.array_join(keep, "")).otherwise(F.col("text"))).select(*docs.drop("removed_spans").columns, "removed_spans")


def op8_unit_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spans(common.read(spark, sf_dir, "documents"))
    text = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return out.select("doc_id", text.alias("spans"), "n_spans", "removed_words", "removed_chars", "kept_in")
