"""All queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sumstead.llm import (
    bitplane_clusters,
    chat_format,
    decontaminate,
    kneser_ney,
    line_dedup,
    packing,
    quality_classifier,
    quality_rules,
    simhash_tree,
    spelling_variants,
    suffix_dedup,
    token_counts,
    token_files,
)

_MODULES = (
    line_dedup, packing, quality_classifier, token_files, quality_rules, decontaminate, chat_format, simhash_tree, token_counts,
    suffix_dedup, bitplane_clusters, spelling_variants, kneser_ney,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
