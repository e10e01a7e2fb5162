"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from graphloom.llm import chat_format, decontamination, exact_dedup, fill_middle, jaccard_join, license_scan, line_dedup, mixing, quality_rules, secret_scan, sentencepiece_wfst, suffix_dedup, whitening

QUERIES = {
    "op1_sentencepiece": sentencepiece_wfst.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_mixing": mixing.query,
    "op5_jaccard_join": jaccard_join.query,
    "op6_quality_rules": quality_rules.query,
    "op7_chat_format": chat_format.query,
    "op8_secret_scan": secret_scan.query,
    "op9_license_scan": license_scan.query,
    "op10_line_dedup": line_dedup.query,
    "op11_fill_middle": fill_middle.query,
    "op12_decontamination": decontamination.query,
    "op13_whitening": whitening.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op5_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op7_chat_format": chat_format.ORACLE_SQL,
    "op10_line_dedup": line_dedup.ORACLE_SQL,
    "op11_fill_middle": fill_middle.ORACLE_SQL,
    "op12_decontamination": decontamination.ORACLE_SQL,
}
