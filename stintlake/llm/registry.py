"""Queries of this folder and, where SQL can express them, the SQL they must equal."""

from stintlake.llm import (
    alignment,
    chat,
    fingerprints,
    html,
    licenses,
    mixing,
    packing,
    pivots,
    quality,
    repair,
    repeats,
    secrets,
    simhash,
)

QUERIES = {
    "op1_suffix_array_dedup": repeats.op1_suffix_array_dedup,
    "op2_html_extraction": html.op2_html_extraction,
    "op10_chat_formatting": chat.op10_chat_formatting,
    "op4_license_scans": licenses.op4_license_scans,
    "op5_document_fingerprints": fingerprints.op5_document_fingerprints,
    "op3_quality_rules": quality.op3_quality_rules,
    "op6_secret_scans": secrets.op6_secret_scans,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op11_embedding_near_dedup": pivots.op11_embedding_near_dedup,
    "op12_cross_tokenizer_alignment": alignment.op12_cross_tokenizer_alignment,
    "op13_conversation_structure_repair": repair.op13_conversation_structure_repair,
}

ORACLE = {"op9_mixing": mixing.OP9_SQL, "op10_chat_formatting": chat.OP10_SQL}
