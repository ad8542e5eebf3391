"""Queries of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import decontaminate, jaccard, language, lines, mixing, nbsvm, quality, secrets, sessions, sharding, tokens, toxicity, trie

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_language": language.op2_language,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_secrets": secrets.op4_secrets,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_shard": sharding.op7_shard,
    "op8_tokens": tokens.op8_tokens,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_ngram_join": jaccard.op10_ngram_join,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_sessions": sessions.op12_sessions,
    "op13_quality_nbsvm": nbsvm.op13_quality_nbsvm,
}
ORACLES = {
    "op1_quality_rules": quality.OP1_SQL,
    "op3_line_dedup": lines.OP3_SQL,
    "op5_decontaminate": decontaminate.OP5_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op10_ngram_join": jaccard.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_sessions": sessions.OP12_SQL,
}
