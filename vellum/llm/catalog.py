"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from vellum.llm import (bpe, divergence, langid, licenses, main_text, merkle, packing, quality, secret_scan,
                        simhash, suffix_dedup, variants, warc)

QUERIES = {
    "op1_main_text": main_text.op1_main_text,
    "op2_language_id": langid.op2_language_id,
    "op3_packing": packing.op3_packing,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_simhash": simhash.op5_simhash,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_fingerprints": merkle.op8_fingerprints,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_warc": warc.op10_warc,
    "op11_spelling_variants": variants.op11_spelling_variants,
    "op12_divergence": divergence.op12_divergence,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op6_license_scan": licenses.ORACLE_SQL,
    "op7_quality_rules": quality.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
}
