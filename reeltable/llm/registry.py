"""Queries of the training-data operators and their SQL."""

from reeltable.llm import alignment, cdc, conversations, hostrules, katz, licenses, mixing, ogg, packing, sharding, simhash, suffixes, surrogates

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_simhash": simhash.op2_simhash,
    "op3_katz_scores": katz.op3_katz_scores,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_rake_mix": mixing.op5_rake_mix,
    "op6_ogg_media": ogg.op6_ogg_media,
    "op7_pii_surrogates": surrogates.op7_pii_surrogates,
    "op8_vector_sharding": sharding.op8_vector_sharding,
    "op9_chunk_dedup": cdc.op9_chunk_dedup,
    "op10_host_rules": hostrules.op10_host_rules,
    "op11_suffix_dedup": suffixes.op11_suffix_dedup,
    "op12_conversation_repair": conversations.op12_conversation_repair,
    "op13_token_alignment": alignment.op13_token_alignment,
}
ORACLES = {"op1_license_scan": licenses.OP1_SQL, "op5_rake_mix": mixing.OP5_SQL, "op10_host_rules": hostrules.OP10_SQL}
