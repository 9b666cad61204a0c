"""The queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from tidewire.llm import decontaminate, html_text, ibf, language_id, licenses, pieces, quality, simhash, url_filter, warc


def queries() -> dict[str, Callable]:
    return {
        "op1_simhash": simhash.op1_simhash,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_language_id": language_id.op3_language_id,
        "op4_fingerprints": ibf.op4_fingerprints,
        "op5_warc": warc.op5_warc,
        "op6_html_text": html_text.op6_html_text,
        "op7_decontaminate": decontaminate.op7_decontaminate,
        "op8_quality": quality.op8_quality,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_sentencepiece": pieces.op10_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": url_filter.ORACLE,
        "op9_license_scan": licenses.ORACLE,
    }
