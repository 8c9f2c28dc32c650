"""The corpus queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import hamming_search, language, line_dedup, mixing, packing, quality_model, quality_rules, simhash, substring_dedup, wavelet

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_language": language.op3_language,
    "op4_quality_model": quality_model.op4_quality_model,
    "op5_packing": packing.op5_packing,
    "op6_wavelet": wavelet.op6_wavelet,
    "op7_hamming_search": hamming_search.op7_hamming_search,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_mixing": mixing.op10_mixing,
}
SQL = {"op7_hamming_search": hamming_search.OP7_SQL, "op8_line_dedup": line_dedup.OP8_SQL, "op10_mixing": mixing.OP10_SQL}
