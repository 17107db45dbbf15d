"""The registered queries of this package: one per operator, each over its whole table."""

from __future__ import annotations

from vellum.llm import chat, divergence, gif_media, mixing, near_dedup, orc_tokens, packing, prefix_trie, quality_qda, quality_rules, secrets, simhash, toxicity_fm


def queries() -> dict:
    return {
        "op1_chat_masks": chat.chat_digests,
        "op2_quality_qda": quality_qda.quality_scores,
        "op3_orc_token_ids": orc_tokens.token_files,
        "op4_weighted_minhash": near_dedup.near_duplicates,
        "op5_secret_ownership": secrets.secret_spans,
        "op6_adaptive_rules": quality_rules.rule_verdicts,
        "op7_gif_media": gif_media.media_digests,
        "op8_hash_threshold_mix": mixing.mixed_sizes,
        "op9_toxicity_fm": toxicity_fm.toxicity_scores,
        "op10_nnls_packing": packing.packed_pieces,
        "op11_source_divergence": divergence.source_divergence,
        "op12_prefix_trie": prefix_trie.conversation_trie,
        "op13_simhash_trie": simhash.simhash_components,
    }


def oracle_sql() -> dict[str, str]:
    """Token ids, models, sketches and media have no SQL; tests hold them against brute force, round trips or held-out labels."""
    return {"op1_chat_masks": chat.SQL, "op6_adaptive_rules": quality_rules.SQL, "op8_hash_threshold_mix": mixing.SQL, "op11_source_divergence": divergence.SQL, "op12_prefix_trie": prefix_trie.SQL}
