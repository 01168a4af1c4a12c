"""Queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from noctua.llm import alignment, bpe_job, exact_dedup, langid, lm, mixing, negatives, positive_unlabelled, quality, sharding, simhash, token_files, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_langid": langid.op1_langid,
        "op10_lm_scores": lm.op10_lm_scores,
        "op11_quality_classifier": positive_unlabelled.op11_quality_classifier,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_alignment": alignment.op13_alignment,
        "op2_simhash": simhash.op2_simhash,
        "op3_token_files": token_files.op3_token_files,
        "op4_byte_bpe": bpe_job.op4_byte_bpe,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_warc": warc.op8_warc,
        "op9_quality": quality.op9_quality,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": mixing.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_warc": warc.SQL, "op12_hard_negatives": negatives.SQL}
