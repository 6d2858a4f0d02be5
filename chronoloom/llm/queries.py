"""The queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compression, licences, lines, near, packing, pieces, quality, scoring, sharding, suffixes, urls, vectors, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licences.op1_license_scan,
    "op2_deleted_interpolation": scoring.op2_deleted_interpolation,
    "op3_probminhash_dedup": near.op3_probminhash_dedup,
    "op4_anisotropic_search": vectors.op4_anisotropic_search,
    "op5_sampled_pieces": pieces.op5_sampled_pieces,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_best_fit_packing": packing.op7_best_fit_packing,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_flow_resharding": sharding.op9_flow_resharding,
    "op10_line_dedup": lines.op10_line_dedup,
    "op11_heap_lloyd": compression.op11_heap_lloyd,
    "op12_url_filters": urls.op12_url_filters,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op1_license_scan": licences.ORACLE,
    "op11_heap_lloyd": compression.ORACLE,
}
