"""The registered queries of this package and their SQL."""

from __future__ import annotations

from depotline.llm import (ann, decontamination, hard_negatives, langid, lexical_search, line_dedup, mixing, ngram_join, packing,
                           pii, spotsigs, token_files, toxicity)

QUERIES = {
    "op1_spotsigs": spotsigs.op1_spotsigs,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_ppm_language": langid.op3_ppm_language,
    "op4_srs_neighbours": ann.op4_srs_neighbours,
    "op5_pfair_mix": mixing.op5_pfair_mix,
    "op6_sum_of_squares_packing": packing.op6_sum_of_squares_packing,
    "op7_grouped_prefix_join": ngram_join.op7_grouped_prefix_join,
    "op8_boosted_pii": pii.op8_boosted_pii,
    "op9_nb_toxicity": toxicity.op9_nb_toxicity,
    "op10_zstd_token_files": token_files.op10_zstd_token_files,
    "op11_block_max_search": lexical_search.op11_block_max_search,
    "op12_leak_windows": decontamination.op12_leak_windows,
    "op13_kronecker_negatives": hard_negatives.op13_kronecker_negatives,
}

# Where SQL can express the query; the others are held against brute force in tests/llm.
ORACLE = {
    "op1_spotsigs": spotsigs.ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op5_pfair_mix": mixing.ORACLE,
    "op11_block_max_search": lexical_search.ORACLE,
    "op12_leak_windows": decontamination.ORACLE,
    "op13_kronecker_negatives": hard_negatives.ORACLE,
}
