"""The corpus operators' queries and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, licenses, mixing, passages, quality, sharding, simhash, tokens, toxicity, webp


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_sentences": licenses.op1_license_sentences,
        "op2_virtual_slots": sharding.op2_virtual_slots,
        "op3_simhash": simhash.op3_simhash,
        "op4_token_shards": tokens.op4_token_shards,
        "op5_cnn": toxicity.op5_cnn,
        "op6_simhash_windows": decontamination.op6_simhash_windows,
        "op7_random_indexing": quality.op7_random_indexing,
        "op8_unit_hashing": passages.op8_unit_hashing,
        "op9_budget_fitting": mixing.op9_budget_fitting,
        "op10_webp": webp.op10_webp,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_sentences": licenses.SQL}
