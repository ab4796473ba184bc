"""Queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

from . import embed_dedup, katz, kdtree, line_dedup, mixing, packing, quality, recompress, resample, sharding, simhash, toxicity, whitening
from .common import table


def queries() -> dict:
    return {
        "op1_line_dedup": lambda spark, d: line_dedup.digest(table(spark, d, "documents")),
        "op2_lm_scoring": lambda spark, d: katz.digest(table(spark, d, "documents")),
        "op3_top_k": lambda spark, d: kdtree.digest(table(spark, d, "embeddings")),
        "op4_sharding": lambda spark, d: sharding.digest(table(spark, d, "documents")),
        "op5_mixing": lambda spark, d: mixing.digest(table(spark, d, "documents")),
        "op6_substring_dedup": lambda spark, d: recompress.digest(table(spark, d, "documents")),
        "op7_toxicity": lambda spark, d: toxicity.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op8_simhash_dedup": lambda spark, d: simhash.digest(table(spark, d, "documents")),
        "op9_embedding_dedup": lambda spark, d: embed_dedup.digest(table(spark, d, "embeddings")),
        "op10_packing": lambda spark, d: packing.digest(table(spark, d, "documents")),
        "op11_whitening": lambda spark, d: whitening.digest(table(spark, d, "embeddings")),
        "op12_quality_rules": lambda spark, d: quality.digest(table(spark, d, "documents"), table(spark, d, "labels")),
        "op13_resampling": lambda spark, d: resample.digest(table(spark, d, "documents"), table(spark, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.SQL, "op3_top_k": kdtree.SQL, "op4_sharding": sharding.SQL, "op5_mixing": mixing.SQL, "op6_substring_dedup": recompress.SQL, "op9_embedding_dedup": embed_dedup.SQL, "op13_resampling": resample.SQL}
