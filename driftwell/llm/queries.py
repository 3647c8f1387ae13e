"""The queries of this subpackage and, where SQL can state the same result, their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from . import additive_quantiser, bpe, centroids, embedding_dups, licenses, merkle, ngram_join, packing, pii, quality, token_counts, toxicity, transcripts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "pipeline": corpus_pipeline.run,
    "op1_chat_format": transcripts.op1_chat_format,
    "op2_neighbours": additive_quantiser.op2_neighbours,
    "op3_licenses": licenses.op3_licenses,
    "op4_bpe": bpe.op4_bpe,
    "op5_pii": pii.op5_pii,
    "op6_embedding_dups": embedding_dups.op6_embedding_dups,
    "op7_quality": quality.op7_quality,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_packing": packing.op9_packing,
    "op10_token_counts": token_counts.op10_token_counts,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_merkle": merkle.op12_merkle,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE_SQL: dict[str, str] = {
    "op3_licenses": licenses.oracle(),
    "op6_embedding_dups": embedding_dups.oracle(),
    "op8_ngram_join": ngram_join.oracle(),
    "op12_merkle": merkle.oracle(),
    "op13_centroids": centroids.oracle(),
}
