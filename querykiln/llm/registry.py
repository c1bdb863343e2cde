"""The queries of this folder with their SQL twins, where SQL can express them."""

from __future__ import annotations

from querykiln.llm import (
    chat_format,
    decontamination,
    embedding_dedup,
    language,
    license_scan,
    merkle_manifest,
    minhash_dedup,
    mixing,
    quality,
    secret_scan,
    source_audit,
    substring_dedup,
    url_rules,
)

QUERIES = {
    "op1_minhash_dedup": (minhash_dedup.op1_minhash_dedup, None),
    "op2_language": (language.op2_language, None),
    "op3_chat_format": (chat_format.op3_chat_format, chat_format.ORACLE_SQL),
    "op4_quality": (quality.op4_quality, None),
    "op5_embedding_dedup": (embedding_dedup.op5_embedding_dedup, embedding_dedup.ORACLE_SQL),
    "op6_decontamination": (decontamination.op6_decontamination, decontamination.ORACLE_SQL),
    "op7_substring_dedup": (substring_dedup.op7_substring_dedup, substring_dedup.ORACLE_SQL),
    "op8_mixing": (mixing.op8_mixing, None),
    "op9_secret_scan": (secret_scan.op9_secret_scan, None),
    "op10_url_rules": (url_rules.op10_url_rules, url_rules.ORACLE_SQL),
    "op11_source_audit": (source_audit.op11_source_audit, source_audit.ORACLE_SQL),
    "op12_merkle_manifest": (merkle_manifest.op12_merkle_manifest, merkle_manifest.ORACLE_SQL),
    "op13_license_scan": (license_scan.op13_license_scan, license_scan.ORACLE_SQL),
}
