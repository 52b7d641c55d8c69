"""The queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, exact_dedup, line_dedup, ngram_join, quality, sentencepiece, sharding, toxicity, url_filter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality": quality.op3_quality,
        "op4_sharding": sharding.op4_sharding,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_ngram_join": ngram_join.op6_ngram_join,
        "op7_sentencepiece": sentencepiece.op7_sentencepiece,
        "op8_warc": warc.op8_warc,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op5_url_filter": url_filter.OP5_SQL,
        "op8_warc": warc.OP8_SQL,
        "op9_exact_dedup": exact_dedup.OP9_SQL,
    }
