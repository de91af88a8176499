"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import language, licenses, mixing, ngram_join, packing, quality, rules, tokencount, urls, winnow

QUERIES = {
    "op1_token_counts": tokencount.op1,
    "op2_quality_classifier": quality.op2,
    "op3_quality_rules": rules.op3,
    "op4_license_scans": licenses.op4,
    "op5_document_fingerprints": winnow.op5,
    "op6_language_id": language.op6,
    "op7_mixing": mixing.op7,
    "op8_url_filters": urls.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_ngram_jaccard_join": ngram_join.op10,
}
ORACLES = {
    "op3_quality_rules": rules.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_url_filters": urls.ORACLE,
}
