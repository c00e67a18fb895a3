"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_repair, decontamination, html_content, line_templates, near_duplicates, personal_data, phrases, piece_codec, quality_rules, secret_scan, token_files, toxicity, url_lists


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_near_duplicates": near_duplicates.op2_near_duplicates,
        "op3_secrets": secret_scan.op3_secrets,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_line_templates": line_templates.op5_line_templates,
        "op6_url_lists": url_lists.op6_url_lists,
        "op7_piece_codec": piece_codec.op7_piece_codec,
        "op8_html_content": html_content.op8_html_content,
        "op9_token_files": token_files.op9_token_files,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_personal_data": personal_data.op11_personal_data,
        "op12_phrases": phrases.op12_phrases,
        "op13_conversation_repair": conversation_repair.op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.OP1_SQL,
        "op5_line_templates": line_templates.OP5_SQL,
        "op6_url_lists": url_lists.OP6_SQL,
        "op12_phrases": phrases.OP12_SQL,
    }
