"""The queries of this folder, by name, with their SQL where SQL can express them."""

from tessera.llm import chat, decontaminate, language_id, lexical_search, licenses, lm_scoring, media_jpeg, mixing, ngram_join, spelling, templates, token_counts, url_filter

QUERIES = {
    "op1_token_counts": token_counts.query,
    "op2_lm_scoring": lm_scoring.query,
    "op3_media_jpeg": media_jpeg.query,
    "op4_ngram_join": ngram_join.query,
    "op5_language_id": language_id.query,
    "op6_mix_sources": mixing.query,
    "op7_chat_format": chat.query,
    "op8_url_filter": url_filter.query,
    "op9_decontaminate": decontaminate.query,
    "op10_license_scan": licenses.query,
    "op11_spelling_variants": spelling.query,
    "op12_lexical_search": lexical_search.query,
    "op13_html_extraction": templates.query,
}
ORACLE_SQL = {
    "op6_mix_sources": mixing.SQL,
    "op7_chat_format": chat.SQL,
    "op8_url_filter": url_filter.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_license_scan": licenses.SQL,
    "op12_lexical_search": lexical_search.SQL,
    "op13_html_extraction": templates.SQL,
}
