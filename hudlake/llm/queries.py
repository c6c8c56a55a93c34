"""The registered queries of the corpus operators, and the SQL of those that SQL can state."""

from __future__ import annotations

from hudlake.llm import chat, codes, counts, embeddings, packing, phrases, pieces, quality, records, scoring, simhash, substrings, toxicity

QUERIES = {
    "op1_substring_dedup": substrings.op1_substring_dedup,
    "op2_embedding_near_dedup": embeddings.op2_embedding_near_dedup,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_sampled_pieces": pieces.op7_sampled_pieces,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_lattice_scoring": scoring.op9_lattice_scoring,
    "op10_token_records": records.op10_token_records,
    "op11_token_counts": counts.op11_token_counts,
    "op12_vector_codes": codes.op12_vector_codes,
    "op13_phrase_collocations": phrases.op13_phrase_collocations,
}
ORACLES: dict[str, str] = {"op5_chat_formatting": chat.OP5_SQL, "op12_vector_codes": codes.OP12_SQL, "op13_phrase_collocations": phrases.OP13_SQL}
