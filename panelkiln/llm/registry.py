"""Queries of this folder and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from panelkiln.llm import bpe_codec, centroids, chat_format, decontamination, fingerprints, hidden_markov, language_id, near_dedup, oracles, prefix_trie, substring_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_language": language_id.op3_language,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_bpe": bpe_codec.op9_bpe,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_hidden_markov": hidden_markov.op11_hidden_markov,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_centroids": centroids.op13_centroids,
}
ORACLES: dict[str, str] = {"op5_url_filter": oracles.OP5, "op7_decontamination": oracles.OP7, "op8_near_dedup": oracles.OP8, "op12_prefix_trie": oracles.OP12, "op13_centroids": oracles.OP13}
