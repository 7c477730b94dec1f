"""F4, U3, N20, N21 and X1 over a table of metric queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead.fixed_values import SCOPE_ALL
from sumstead.functions.display import scope_text
from sumstead.functions.hashing import evidence_id
from sumstead.model import MAX_LIMIT, SemanticModel


def _known(model: SemanticModel) -> Column:
    return F.array(*[F.lit(d.key) for d in model.dimensions])


def unknown_dimensions(log: DataFrame, model: SemanticModel) -> DataFrame:
    """What each query names beyond the declared dimensions."""
    requested = F.array_distinct(F.concat("group_by", F.map_keys("filters")))
    return log.withColumn("unknown_dimensions", F.array_sort(F.array_except(requested, _known(model))))


def refusals(log: DataFrame, model: SemanticModel) -> DataFrame:
    """why a query is refused before any scan; null where it may run."""
    metrics = [m.key for m in model.metrics]
    checked = unknown_dimensions(log, model)
    empty_filter = F.exists(F.map_values("filters"), lambda v: F.size(v) == 0)
    reason = (
        F.when(~F.col("metric").isin(metrics), "unknown_metric")
        .when(F.size("unknown_dimensions") > 0, "unknown_dimension")
        .when(F.size("group_by") > 2, "too_many_dimensions")
        .when(F.size(F.array_distinct("group_by")) < F.size("group_by"), "repeated_dimension")
        .when(empty_filter, "empty_filter")
        .when((F.col("limit") < 1) | (F.col("limit") > MAX_LIMIT), "limit_out_of_range")
        .when(F.col("date_from") > F.col("date_to"), "dates_out_of_order")
    )
    return checked.withColumn("refusal", reason).drop("unknown_dimensions")


def with_scope(log: DataFrame) -> DataFrame:
    """N20"""
    return log.withColumn(
        "scope",
        scope_text(F.col("date_from"), F.col("date_to"), F.col("filters"), F.col("group_by"), SCOPE_ALL),
    )


def with_evidence(log: DataFrame, workspace: str, run_id: int) -> DataFrame:
    """N21"""
    return log.withColumn(
        "evidence_id",
        evidence_id(F.lit(workspace), F.lit(run_id), F.col("metric"), F.col("group_by"), F.col("filters"),
                    F.col("date_from"), F.col("date_to"), F.col("grain"), F.col("limit")),
    )


def filter_pairs(log: DataFrame) -> DataFrame:
    """One row per query, filtered dimension and value."""
    pairs = log.select("query_id", F.explode("filters").alias("dimension", "values"))
    return pairs.select("query_id", "dimension", F.explode("values").alias("value"))
