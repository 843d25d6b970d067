"""Queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from finlattice.llm import bpe, chat_format, embedding_dedup, exact_dedup, packing, secret_scan, simhash_dedup, substring_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_bpe": bpe.op4_bpe,
    "op5_packing": packing.op5_packing,
    "op6_chat": chat_format.op6_chat,
    "op7_exact_dedup": exact_dedup.op7_exact_dedup,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_embeddings": embedding_dedup.op9_embeddings,
    "op10_simhash": simhash_dedup.op10_simhash,
}
ORACLE = {"op1_suffix_dedup": suffix_dedup.OP1_SQL, "op3_substring_dedup": substring_dedup.OP3_SQL, "op6_chat": chat_format.OP6_SQL, "op7_exact_dedup": exact_dedup.OP7_SQL, "op9_embeddings": embedding_dedup.OP9_SQL}
