"""Registered queries of the text operators, with checking SQL where SQL can express them."""

from ledgerlake.llm import (
    chat_format, exact_dedup, language_id, lexical_search, ngram_join, packing, periodic_runs, sentence_pieces, sharding,
    substring_dedup, token_counts, topk_search, warc)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_sentencepiece": sentence_pieces.op2_sentencepiece,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_language_id": language_id.op4_language_id,
    "op5_topk_search": topk_search.op5_topk_search,
    "op6_sharding": sharding.op6_sharding,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_warc": warc.op10_warc,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_chat_format": chat_format.OP3_SQL,
    "op5_topk_search": topk_search.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_substring_dedup": substring_dedup.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
