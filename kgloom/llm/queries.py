"""The queries of this package and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_quality, op2_lines, op3_decontam, op4_suffixes, op5_jaccard, op6_sharding, op7_language, op8_bpe, op9_debruijn, op10_tokens, op11_token_files, op12_centroids, op13_prefixes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality.op1_quality_rules,
        "op2_line_dedup": op2_lines.op2_line_dedup,
        "op3_decontamination": op3_decontam.op3_decontamination,
        "op4_suffix_dedup": op4_suffixes.op4_suffix_dedup,
        "op5_jaccard_join": op5_jaccard.op5_jaccard_join,
        "op6_sharding": op6_sharding.op6_sharding,
        "op7_language_id": op7_language.op7_language_id,
        "op8_bpe": op8_bpe.op8_bpe,
        "op9_substring_dedup": op9_debruijn.op9_substring_dedup,
        "op10_token_counts": op10_tokens.op10_token_counts,
        "op11_token_files": op11_token_files.op11_token_files,
        "op12_centroids": op12_centroids.op12_centroids,
        "op13_prefixes": op13_prefixes.op13_prefixes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": op2_lines.SQL, "op12_centroids": op12_centroids.SQL, "op13_prefixes": op13_prefixes.SQL}
