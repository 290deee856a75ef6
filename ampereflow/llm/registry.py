"""The registered queries of the corpus operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import align, codes, decontaminate, embed_dedup, exact_dedup, language, licenses, pack, pii, quality, simhash, toxicity, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_language": language.op2_language,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pack": pack.op5_pack,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_pii": pii.op8_pii,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_licenses": licenses.op10_licenses,
    "op11_align": align.op11_align,
    "op12_embedding_dedup": embed_dedup.op12_embedding_dedup,
    "op13_vector_codes": codes.op13_vector_codes,
}
ORACLES = {
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op6_url_filter": url_filter.OP6_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "op12_embedding_dedup": embed_dedup.OP12_SQL,
    "op13_vector_codes": codes.OP13_SQL,
}
