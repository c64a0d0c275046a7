"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from caselens.llm import bpe, chat, embed_dedup, ngram_join, packing, quality, rules, secret_scan, toxicity, unigram

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": bpe.op1_byte_bpe,
    "op2_quality_rules": rules.op2_quality_rules,
    "op3_quality_classifier": quality.op3_quality_classifier,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_embedding_dedup": embed_dedup.op5_embedding_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_token_counts": unigram.op7_token_counts,
    "op8_ngram_jaccard_join": ngram_join.op8_ngram_jaccard_join,
    "op9_secret_scan": secret_scan.op9_secret_scan,
    "op10_chat_formatting": chat.op10_chat_formatting,
}

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": rules.OP2_SQL,
    "op9_secret_scan": secret_scan.OP9_SQL,
    "op10_chat_formatting": chat.OP10_SQL,
}
