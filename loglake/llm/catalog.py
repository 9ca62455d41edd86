"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loglake.llm import alignment, chat, collocations, decontaminate, neardup, pages, pii, secrets, tokens, toxicity, urls, vectors


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query per operator, over whole tables."""
    return {
        "op1_token_counts": tokens.op1_token_counts,
        "op2_chat_format": chat.op2_chat_format,
        "op3_embedding_links": vectors.op3_embedding_links,
        "op4_pii": pii.op4_pii,
        "op5_secrets": secrets.op5_secrets,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_packing": tokens.op7_packing,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_near_duplicates": neardup.op9_near_duplicates,
        "op10_url_filter": urls.op10_url_filter,
        "op11_alignment": alignment.op11_alignment,
        "op12_main_text": pages.op12_main_text,
        "op13_collocations": collocations.op13_collocations,
    }


def llm_oracles() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    return {
        "op2_chat_format": chat.OP2_SQL,
        "op3_embedding_links": vectors.OP3_SQL,
        "op8_decontamination": decontaminate.OP8_SQL,
        "op9_near_duplicates": neardup.OP9_SQL,
        "op12_main_text": pages.OP12_SQL,
        "op13_collocations": collocations.OP13_SQL,
    }
