"""The corpus pipeline: quality filter, near-dedup, decontamination, mixing and sharding, one after another.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents, whatever these are; an empty
table gives an empty one, and a text of any length is judged whole. Columns named like an operator's own don't disturb it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm import common, decontamination, mixing, neardup, quality, sharding


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated quality is 0.3 or more.

    A null text is scored as an empty one. Rows that repeat are each judged by their text, equal ones alike; a
    doc_id that stands several times is an example with each row.
    """
    return quality.keep(docs, common.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies (SimHash candidates, five-word shingles 0.8 alike) stays, the
    one with the smallest doc_id. Null and wordless texts are one group; of rows that repeat a doc_id any one stays; rows
    without a doc_id all stay.
    """
    return neardup.dedup(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts hold none; rows that repeat a doc_id go together, and so do rows without one."""
    return decontamination.clean(docs, common.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice. A null source is one of its own, a null text has
    no words; rows that repeat count each; of documents of one length the seed decides.
    """
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus with each row's shard and its place there. Null ids and texts hash like others, equal rows are
    interchangeable; of columns named like the result's (size, shard, slot, ...) the result's are returned.
    """
    return sharding.shard_documents(docs, keep=tuple(docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Trained models, SimHash and seeded choices aren't expressible in SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is stored in the folder that executors share."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
