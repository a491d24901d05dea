"""The text operators' queries and their SQL, by name."""

from __future__ import annotations

from . import decontaminate, mixing, oracles, packed_ids, pii, quality, secrets, simhash, substring, token_counts, urls

QUERIES = {
    "op1_substring": substring.query,
    "op4_token_counts": token_counts.query,
    "op10_simhash": simhash.query,
    "op5_quality": quality.query,
    "op2_decontaminate": decontaminate.query,
    "op3_urls": urls.query,
    "op6_mixing": mixing.query,
    "op7_secrets": secrets.query,
    "op8_pii": pii.query,
    "op9_packed_ids": packed_ids.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_substring": oracles.SUBSTRING,
    "op2_decontaminate": oracles.DECONTAMINATE,
    "op3_urls": oracles.URLS,
    "op5_quality": oracles.QUALITY,
    "op6_mixing": mixing.ORACLE,
}
