"""Queries of this subpackage and their oracle SQL."""

from . import bpe, class_lm, decontaminate, exact_dedup, html_text, jaccard_join, language_id, substring_dedup, token_tables, url_filter

QUERIES = {
    "op1_jaccard_join": jaccard_join.op1_jaccard_join,
    "op2_language_id": language_id.op2_language_id,
    "op3_class_lm": class_lm.op3_class_lm,
    "op4_html_text": html_text.op4_html_text,
    "op5_bpe": bpe.op5_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_token_tables": token_tables.op8_token_tables,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}
ORACLE_SQL = {"op1_jaccard_join": jaccard_join.OP1_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op10_substring_dedup": substring_dedup.OP10_SQL}
