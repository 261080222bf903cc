"""The queries of this subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bytebpe, html_text, jaccard, language_model, licenses, media, packing, quality_model, quality_rules, tokenfile


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_token_files": tokenfile.query,
        "op3_jaccard_join": jaccard.query,
        "op4_language_model": language_model.query,
        "op5_best_fit_packing": packing.query,
        "op6_byte_bpe": bytebpe.query,
        "op7_html_text": html_text.query,
        "op8_license_scan": licenses.query,
        "op9_mpeg_audio": media.query,
        "op10_quality_model": quality_model.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.ORACLE_SQL,
        "op3_jaccard_join": jaccard.ORACLE_SQL,
    }
