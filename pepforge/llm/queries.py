"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from . import chat_format, decontamination, hamming_search, html_extract, lexical_search, license_scan, line_dedup, mixing, near_dedup, periodic_runs, quality, token_counts, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_exact_topk": hamming_search.op3_exact_topk,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_html_extract": html_extract.op6_html_extract,
    "op7_benchmark_decontamination": decontamination.op7_benchmark_decontamination,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_license_scan": license_scan.op10_license_scan,
    "op11_token_counts": token_counts.op11_token_counts,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE_OP1,
    "op3_exact_topk": hamming_search.ORACLE_OP3,
    "op4_chat_format": chat_format.ORACLE_OP4,
    "op5_minhash_near_dedup": near_dedup.ORACLE_OP5,
    "op7_benchmark_decontamination": decontamination.ORACLE_OP7,
    "op8_mixing": mixing.ORACLE_OP8,
    "op12_lexical_search": lexical_search.ORACLE_OP12,
}
