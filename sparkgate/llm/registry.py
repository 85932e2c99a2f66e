"""Queries of the training-data operators, and the SQL they must agree with where SQL can express them."""

from __future__ import annotations

import corpus_pipeline

from sparkgate.llm import collocations, language, minhash, mixing, packing, pieces, pii, preferences, quality, secrets, vectors, warc, whitening

QUERIES = {
    "op1_subspace_vectors": vectors.op1_subspace_vectors,
    "op2_anchor_pii": pii.op2_anchor_pii,
    "op3_ownership_secrets": secrets.op3_ownership_secrets,
    "op4_preferences": preferences.op4_preferences,
    "op5_quality_ratio": quality.op5_quality_ratio,
    "op6_hamming_near_dedup": minhash.op6_hamming_near_dedup,
    "op7_tiered_packing": packing.op7_tiered_packing,
    "op8_warc_segments": warc.op8_warc_segments,
    "op9_pareto_mix": mixing.op9_pareto_mix,
    "op10_bloom_language": language.op10_bloom_language,
    "op11_merge_rounds": pieces.op11_merge_rounds,
    "op12_phrase_lists": collocations.op12_phrase_lists,
    "op13_svd_whitening": whitening.op13_svd_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_subspace_vectors": vectors.OP1_SQL,
    "op4_preferences": preferences.OP4_SQL,
    "op6_hamming_near_dedup": minhash.OP6_SQL,
    "op8_warc_segments": warc.OP8_SQL,
    "op9_pareto_mix": mixing.OP9_SQL,
    "op12_phrase_lists": collocations.OP12_SQL,
}
