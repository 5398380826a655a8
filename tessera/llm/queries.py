"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from tessera.llm import decontamination, exact_dedup, html_text, license_scan, mixing, sharding, simhash, substring_dedup, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_html_text": html_text.op3_html_text,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_sharding": sharding.op5_sharding,
        "op6_mixing": mixing.op6_mixing,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_simhash": simhash.op9_simhash,
        "op10_toxicity": toxicity.op10_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    """What SQL can say; the others are tested against brute force and held-out labels in tests/llm."""
    return {
        "op1_exact_dedup": exact_dedup.ORACLE,
        "op2_decontamination": decontamination.ORACLE,
        "op6_mixing": mixing.ORACLE,
        "op7_substring_dedup": substring_dedup.ORACLE,
        "op8_license_scan": license_scan.ORACLE,
    }
