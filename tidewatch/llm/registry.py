"""Queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import bpe_codec, conversation_repair, decontaminate, html_extract, jaccard_join, language_id, license_scan, packing, quality_rules, secret_scan, token_counts, vector_codes, warc_archive

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc": warc_archive.op3_warc,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_secret_scan": secret_scan.op7_secret_scan,
    "op8_bpe_codec": bpe_codec.op8_bpe_codec,
    "op9_language_id": language_id.op9_language_id,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_conversation_repair": conversation_repair.op12_conversation_repair,
    "op13_packing": packing.op13_packing,
}

#: Operators 2, 8, 9, 10 and 13 can't be put in SQL; tests hold them against brute force, a library or known results.
ORACLES = {
    "op1_license_scan": license_scan.ORACLE_SQL,
    "op3_warc": warc_archive.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op5_decontaminate": decontaminate.ORACLE_SQL,
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op7_secret_scan": secret_scan.ORACLE_SQL,
    "op11_vector_codes": vector_codes.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
