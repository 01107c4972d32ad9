"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import arrow_output, bpe, exact_dedup, media, mixing, pii, quality, sharding, simhash, suffix

    return {
        "op1_media": media.op1_media,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_simhash": simhash.op3_simhash,
        "op4_bpe": bpe.op4_bpe,
        "op5_quality": quality.op5_quality,
        "op6_suffix": suffix.op6_suffix,
        "op7_arrow_output": arrow_output.op7_arrow_output,
        "op8_sharding": sharding.op8_sharding,
        "op9_mixing": mixing.op9_mixing,
        "op10_pii": pii.op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    from . import exact_dedup, mixing, sharding

    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op8_sharding": sharding.OP8_SQL,
        "op9_mixing": mixing.OP9_SQL,
    }
