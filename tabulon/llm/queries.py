"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tabulon.llm import chat, jaccard, media, minhash, mixing, pieces, pii, repair, secrets, sharding, topk, toxicity, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_sharding": sharding.op2_sharding,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_secrets": secrets.op4_secrets,
    "op5_topk": topk.op5_topk,
    "op6_jaccard": jaccard.op6_jaccard,
    "op7_pieces": pieces.op7_pieces,
    "op8_pii": pii.op8_pii,
    "op9_chat_formatting": chat.op9_chat_formatting,
    "op10_media": media.op10_media,
    "op11_minhash": minhash.op11_minhash,
    "op12_ranked": wavelet.op12_ranked,
    "op13_repair": repair.op13_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op5_topk": topk.ORACLE,
    "op6_jaccard": jaccard.ORACLE,
    "op9_chat_formatting": chat.ORACLE,
    "op11_minhash": minhash.ORACLE,
    "op12_ranked": wavelet.ORACLE,
    "op13_repair": repair.ORACLE,
}
