"""Queries and SQL of the operators, by name."""

from __future__ import annotations

from . import alignment, divergence, exact_dedup, fingerprints, language_id, mixing, ngram_join, packing, secret_scan, sharding, token_counts, token_files, word_table

QUERIES = {
    "op1_shard_best_fit": sharding.op1_shard_best_fit,
    "op2_fingerprint_iblt": fingerprints.op2_fingerprint_iblt,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_token_files": token_files.op8_token_files,
    "op9_pack_best_fit": packing.op9_pack_best_fit,
    "op10_language_id": language_id.op10_language_id,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_bpe_word_table": word_table.op12_bpe_word_table,
    "op13_token_alignment": alignment.op13_token_alignment,
}

ORACLES = {
    "op4_exact_dedup": exact_dedup.SQL,
    "op5_mix_sources": mixing.SQL,
    "op11_source_divergence": divergence.SQL,
}
