"""The corpus queries with their SQL counterparts, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from litgrid.llm import collocations, decontamination, neighbours, pieces, pitman_yor, quality, sharding, simhash, substring_dedup, suffix_dedup, token_counts, warc, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.op1_suffix_array_dedup,
        "op2_sentencepiece": pieces.op2_sentencepiece,
        "op3_hilbert_sharding": sharding.op3_hilbert_sharding,
        "op4_simhash_near_dedup": simhash.op4_simhash_near_dedup,
        "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_quality_classifier": quality.op7_quality_classifier,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_cross_polytope_neighbours": neighbours.op9_cross_polytope_neighbours,
        "op10_pitman_yor_lm": pitman_yor.op10_pitman_yor_lm,
        "op11_warc": warc.op11_warc,
        "op12_phrase_collocations": collocations.op12_phrase_collocations,
        "op13_embedding_whitening": whitening.op13_embedding_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_array_dedup": suffix_dedup.ORACLE,
        "op5_benchmark_decontamination": decontamination.ORACLE,
        "op8_substring_dedup": substring_dedup.ORACLE,
        "op11_warc": warc.ORACLE,
        "op12_phrase_collocations": collocations.ORACLE,
    }
