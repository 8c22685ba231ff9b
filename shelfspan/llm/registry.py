"""Queries of this subpackage, and their oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfspan.llm import centroids, chat, decontaminate, divergence, fingerprints, language, licenses, minhash, mixing, pii, tokens, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontaminate": decontaminate.op1_decontaminate,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_bpe_round_trip": tokens.op3_bpe_round_trip,
        "op4_chat_format": chat.op4_chat_format,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_token_counts": tokens.op6_token_counts,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_near_duplicates": minhash.op8_near_duplicates,
        "op9_pii": pii.op9_pii,
        "op10_language": language.op10_language,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_source_mix": mixing.op12_source_mix,
        "op13_centroid_clusters": centroids.op13_centroid_clusters,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.op2_sql(), "op4_chat_format": chat.OP4_SQL, "op11_source_divergence": divergence.OP11_SQL.strip(), "op13_centroid_clusters": centroids.op13_sql()}
