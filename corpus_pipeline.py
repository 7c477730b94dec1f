"""From raw documents to packed training sequences: each stage is one operator of ``sumstead.llm``.

Every stage works on all rows that its predecessor kept and returns the columns
of documents; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm import decontaminate, line_dedup, near_copies, packing, quality_rules
from sumstead.llm.common import read_table
from sumstead.session import cut_lineage

_VERDICT, _REMOVED = "_failed_rule", "_lines_removed"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    judged = quality_rules.cascade(docs, verdict=_VERDICT)
    return judged.where(F.col(_VERDICT).isNull()).drop(_VERDICT)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that an earlier document or line has; a document that loses all of them goes."""
    left = line_dedup.dedup_lines(docs, removed=_REMOVED)
    emptied = (F.col(_REMOVED) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return left.where(~emptied).withColumn("n_chars", F.length("text").cast("bigint")).drop(_REMOVED)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8, no pair missed."""
    return near_copies.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each document's tokens lie in which sequence."""
    return packing.packed(docs, public_tokenizers.path(packing.VOCABULARY))


STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Edit distances, fingerprints and packing are beyond SQL; a test holds the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
