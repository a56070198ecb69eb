"""The queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from kindred.llm import decontamination, licenses, mixing, quality_rules, sharding, simhash, suffix_dedup, suffix_tree, toxicity, warc

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_sharding": sharding.op5_sharding,
    "op6_mixing": mixing.op6_mixing,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_licenses": licenses.op8_licenses,
    "op9_warc": warc.op9_warc,
    "op10_suffix_tree": suffix_tree.op10_suffix_tree,
}

ORACLE_SQL = {
    "op2_decontamination": decontamination.OP2_SQL,
    "op4_quality_rules": quality_rules.OP4_SQL,
    "op5_sharding": sharding.OP5_SQL,
    "op6_mixing": mixing.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
}
