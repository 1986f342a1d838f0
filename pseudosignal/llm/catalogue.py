"""Queries of the training-data operators, and their DuckDB counterparts where SQL can say it."""

from __future__ import annotations

from pseudosignal.llm import (
    embedding_dedup,
    fingerprints,
    fixity,
    language,
    manifest,
    mixing,
    neighbours,
    ngram_join,
    packing,
    secrets,
    surrogates,
    toxicity,
    vector_codes,
)
from pseudosignal.llm.oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]

QUERIES = {
    "op1_warc_fixity": fixity.op1_warc_fixity,
    "op2_ngram_jaccard_join": ngram_join.op2_ngram_jaccard_join,
    "op3_secret_scan": secrets.op3_secret_scan,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_learned_partitions": neighbours.op6_learned_partitions,
    "op7_pii_surrogates": surrogates.op7_pii_surrogates,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_language_id": language.op9_language_id,
    "op10_power_of_two_packing": packing.op10_power_of_two_packing,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_document_fingerprints": fingerprints.op12_document_fingerprints,
    "op13_dataset_manifest": manifest.op13_dataset_manifest,
}
