"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pairlens.llm import chat, embeddings, lexical, linededup, lmscore, mixing, negatives, packing, pii, quality, simhash, suffixdedup, warc

QUERIES = {
    "op1_warc_normaliser": warc.op1_warc_normaliser,
    "op9_contextual_pii": pii.op9_contextual_pii,
    "op10_embedding_near_dedup": embeddings.op10_embedding_near_dedup,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_chat_formatting": chat.op12_chat_formatting,
    "op13_lexical_search": lexical.op13_lexical_search,
    "op2_line_dedup": linededup.op2_line_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_recurrent_lm": lmscore.op4_recurrent_lm,
    "op5_suffix_array_dedup": suffixdedup.op5_suffix_array_dedup,
    "op6_simhash_near_dedup": simhash.op6_simhash_near_dedup,
    "op7_quality_rules": quality.op7_quality_rules,
    "op8_temperature_mixing": mixing.op8_temperature_mixing,
}

ORACLE_SQL = {
    "op1_warc_normaliser": warc.OP1_SQL,
    "op2_line_dedup": linededup.OP2_SQL,
    "op7_quality_rules": quality.OP7_SQL,
    "op8_temperature_mixing": mixing.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_chat_formatting": chat.OP12_SQL,
    "op13_lexical_search": lexical.OP13_SQL,
}
