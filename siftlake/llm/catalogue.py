"""Queries of the training-data operators, by name, and their DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from siftlake.llm.bpe import op5_byte_bpe
from siftlake.llm.chat import OP3_SQL, op3_chat_format
from siftlake.llm.fingerprints import op7_lz_fingerprint
from siftlake.llm.mixing import OP10_SQL, op10_mixing
from siftlake.llm.near_dedup import op4_minhash_dedup
from siftlake.llm.neighbours import op2_kmeans_tree
from siftlake.llm.quality import op6_quality_rules
from siftlake.llm.suffix_dedup import op8_suffix_dedup
from siftlake.llm.token_store import op1_token_store
from siftlake.llm.toxicity import op9_toxicity


def queries() -> dict:
    return {
        "op1_token_store": op1_token_store,
        "op2_kmeans_tree": op2_kmeans_tree,
        "op3_chat_format": op3_chat_format,
        "op4_minhash_dedup": op4_minhash_dedup,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_quality_rules": op6_quality_rules,
        "op7_lz_fingerprint": op7_lz_fingerprint,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_toxicity": op9_toxicity,
        "op10_mixing": op10_mixing,
    }


def oracle_sql() -> dict:
    return {"op3_chat_format": OP3_SQL, "op10_mixing": OP10_SQL}
