"""Registry of the training-data queries and their SQL."""

from __future__ import annotations

from . import chat, decontam, licenses, neighbours, packing, quality, secret_scan, sharding, simhash, spelling, substring_dedup, urls, whitening

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_secret_scan": secret_scan.op2_secret_scan,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_decontamination": decontam.op7_decontamination,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_url_filter": urls.op9_url_filter,
    "op10_simhash": simhash.op10_simhash,
    "op11_spelling": spelling.op11_spelling,
    "op12_whitening": whitening.op12_whitening,
    "op13_nearest": neighbours.op13_nearest,
}

ORACLE_SQL = {
    "op4_chat_formatting": chat.OP4_SQL,
    "op6_quality_rules": quality.OP6_SQL,
    "op8_license_scan": licenses.OP8_SQL,
}
