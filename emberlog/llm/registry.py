"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emberlog.llm import decontaminate, exact_dedup, fill_middle, html_text, language_id, mixing, phrases, preferences, secrets, simhash, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": secrets.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_warc": warc.query,
        "op4_mixing": mixing.query,
        "op5_decontaminate": decontaminate.query,
        "op6_preferences": preferences.query,
        "op7_simhash": simhash.query,
        "op8_token_counts": token_counts.query,
        "op9_toxicity": toxicity.query,
        "op10_html_text": html_text.query,
        "op11_language_id": language_id.query,
        "op12_fill_middle": fill_middle.query,
        "op13_phrases": phrases.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_dedup": exact_dedup.ORACLE,
        "op3_warc": warc.ORACLE,
        "op4_mixing": mixing.ORACLE,
        "op5_decontaminate": decontaminate.ORACLE,
        "op6_preferences": preferences.ORACLE,
        "op12_fill_middle": fill_middle.ORACLE,
        "op13_phrases": phrases.ORACLE,
    }
