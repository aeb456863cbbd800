"""The registered queries of this subpackage and their SQL."""

from tessera.llm import alignment, exact_dedup, html_text, language_model, licenses, media, mixing, negatives, packing, quality, simhash, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_quality": quality.op3_quality,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_substrings": substrings.op6_substrings,
    "op7_media": media.op7_media,
    "op8_html_text": html_text.op8_html_text,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_alignment": alignment.op11_alignment,
    "op12_hard_negatives": negatives.op12_hard_negatives,
    "op13_lm_scoring": language_model.op13_lm_scoring,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op10_mixing": mixing.OP10_SQL,
    "op12_hard_negatives": negatives.OP12_SQL,
}
