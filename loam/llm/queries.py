"""The queries of this subpackage by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from loam.llm import chat, fingerprints, jaccard, languages, licenses, merkle, mixing, periods, quality, repeats, search, tokens, urls

QUERIES = {
    "op1_top_k": search.op1_top_k,
    "op2_mixing": mixing.op2_mixing,
    "op3_jaccard_join": jaccard.op3_jaccard_join,
    "op4_sentencepiece": tokens.op4_sentencepiece,
    "op5_url_filter": urls.op5_url_filter,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_chat_formatting": chat.op7_chat_formatting,
    "op8_suffix_dedup": repeats.op8_suffix_dedup,
    "op9_language_id": languages.op9_language_id,
    "op10_quality": quality.op10_quality,
    "op11_periodic_runs": periods.op11_periodic_runs,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLES = {
    "op1_top_k": search.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_jaccard_join": jaccard.ORACLE,
    "op5_url_filter": urls.ORACLE,
    "op7_chat_formatting": chat.ORACLE,
    "op11_periodic_runs": periods.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_license_scan": licenses.ORACLE,
}
