"""The corpus queries and, where SQL can express them, their statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graphproof.llm import (
    conversation_repair, exact_dedup, hard_negatives, jaccard_join, line_dedup, mixing, pii, pivot_index, quality, sentencepiece_fst, token_counts,
    toxicity, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_pivot_index": pivot_index.op3_pivot_index,
        "op4_pii": pii.op4_pii,
        "op5_sentencepiece": sentencepiece_fst.op5_sentencepiece,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_quality": quality.op7_quality,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_jaccard_join": jaccard_join.op9_jaccard_join,
        "op10_token_counts": token_counts.op10_token_counts,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_conversation_repair": conversation_repair.op12_conversation_repair,
        "op13_url_filter": url_filter.op13_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op3_pivot_index": pivot_index.OP3_SQL,
        "op6_mix_sources": mixing.OP6_SQL,
        "op9_jaccard_join": jaccard_join.OP9_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op12_conversation_repair": conversation_repair.OP12_SQL,
        "op13_url_filter": url_filter.OP13_SQL,
    }
