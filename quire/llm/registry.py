"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from quire.llm import byte_bpe, chat_format, decontaminate, html_extract, license_scan, media, mixing, periodic_runs, quality, sharding, simhash_dedup, token_alignment, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_media_columns": media.op2_media_columns,
    "op3_decontamination": decontaminate.op3_decontamination,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_html_extraction": html_extract.op7_html_extraction,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_byte_bpe": byte_bpe.op11_byte_bpe,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_token_alignment": token_alignment.op13_token_alignment,
}

ORACLE_SQL = {
    "op1_url_filter": url_filter.OP1_SQL,
    "op3_decontamination": decontaminate.OP3_SQL,
    "op9_chat_format": chat_format.OP9_SQL,
    "op10_license_scan": license_scan.OP10_SQL,
}
