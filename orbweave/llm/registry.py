"""Queries of the training-text operators and their SQL."""

from __future__ import annotations

from . import bpe, language_id, media, near_dup, packing, pii, quality, substring, token_count, url_filter


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "pipeline": _pipeline,
        "op1_language_id": language_id.op1_language_id,
        "op2_pii": pii.op2_pii,
        "op3_quality_rules": quality.op3_quality_rules,
        "op4_near_dup": near_dup.op4_near_dup,
        "op5_media_columns": media.op5_media_columns,
        "op6_token_counts": token_count.op6_token_counts,
        "op7_packing": packing.op7_packing,
        "op8_substring": substring.op8_substring,
        "op9_bpe": bpe.op9_bpe,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality.oracle(), "op4_near_dup": near_dup.oracle(), "op8_substring": substring.oracle()}
