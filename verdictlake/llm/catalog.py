"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from verdictlake.llm import (
    exact_dedup, fill_in_middle, filter_audit, language_id, lm_scoring, mixing, nearest, ngram_join, packing, simhash, substring_dedup, toxicity, warc)

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_packing": packing.op2_packing,
    "op3_lm_scoring": lm_scoring.op3_lm_scoring,
    "op4_mixing": mixing.op4_mixing,
    "op5_nearest": nearest.op5_nearest,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_warc": warc.op8_warc,
    "op9_simhash": simhash.op9_simhash,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op4_mixing": mixing.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
    "op10_exact_dedup": exact_dedup.ORACLE_SQL,
    "op11_ngram_join": ngram_join.ORACLE_SQL,
    "op12_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
