"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from polyquilt.llm import bpe, classifier, decontaminate, html, lines, merkle, neardup, packing, quality, spelling, substring, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_token_counts": bpe.op2_token_counts,
        "op3_substring_dedup": substring.op3_substring_dedup,
        "op4_quality_rules": quality.op4_quality_rules,
        "op5_url_filter": urls.op5_url_filter,
        "op6_minhash_neardup": neardup.op6_minhash_neardup,
        "op7_line_dedup": lines.op7_line_dedup,
        "op8_token_packing": packing.op8_token_packing,
        "op9_html_extract": html.op9_html_extract,
        "op10_bpe": bpe.op10_bpe,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_quality_classifier": classifier.op12_quality_classifier,
        "op13_spelling_variants": spelling.op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_substring_dedup": substring.oracle_sql(),
        "op4_quality_rules": quality.oracle_sql(),
        "op5_url_filter": urls.oracle_sql(),
        "op6_minhash_neardup": neardup.oracle_sql(),
        "op11_merkle_manifest": merkle.oracle_sql(),
        "op13_spelling_variants": spelling.oracle_sql(),
    }
