"""The queries of the text operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from furrow.llm import embeddings, langid, mixing, packing, pages, pii, repeats, simhash, tokens, topk

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_repeat_removal": repeats.query,
        "op2_pii": pii.query,
        "op3_embedding_near_dedup": embeddings.query,
        "op4_simhash_near_dedup": simhash.query,
        "op5_language_id": langid.query,
        "op6_token_shards": tokens.query,
        "op7_page_text": pages.query,
        "op8_best_fit_packing": packing.query,
        "op9_top_k_search": topk.query,
        "op10_mix_sources": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_embedding_near_dedup": embeddings.SQL,
        "op9_top_k_search": topk.SQL,
        "op10_mix_sources": mixing.SQL,
    }
