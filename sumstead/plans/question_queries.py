"""Registered queries of question reading, linking, conversations and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.model import MetricQuery, Workspace
from sumstead.operators import answers as an
from sumstead.operators import linking as li
from sumstead.operators import metrics as m
from sumstead.operators import questions as qu
from sumstead.plans import views as v
from sumstead.session import cut_lineage

KEYS = ("conv_id", "turn")


def _read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qu.read_questions(v.question_log(spark, sf_dir))


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.read_and_link(v.question_log(spark, sf_dir), v.star_workspace(spark, sf_dir))


def _answers(spark: SparkSession, sf_dir: str, evidence: bool = True) -> DataFrame:
    """All questions answered, by each query anew."""
    return an.answer(v.question_log(spark, sf_dir), v.star_workspace(spark, sf_dir), carried=KEYS, evidence=evidence)


def _by_intent(spark: SparkSession, sf_dir: str, intent: str) -> DataFrame:
    return _answers(spark, sf_dir).where(F.col("intent") == intent).select(*KEYS, "status", "reason", "month", "answer")


def l1_plain_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select(*KEYS, "plain")


def l2_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select(*KEYS, "month")


def l3_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select(*KEYS, "intent", "follow_up", "own_month")


def l3_prose_has_no_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole conversation texts: prose is not taken for a business question."""
    return qu.read_questions(v.table(spark, sf_dir, "conversations")).select(*KEYS, "intent", "month")


def l4_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir).select(*KEYS, "phrase")


def _alias_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.shared_lengths(li.product_catalog(v.star_workspace(spark, sf_dir)))


def l5_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return li.unique_aliases(_alias_positions(spark, sf_dir))


def a11_alias_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The aliases that decide matches: none contains a shorter one."""
    return li.shortest_aliases(_alias_positions(spark, sf_dir))


def j7_question_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(*KEYS, "match_count", "matched")


def l6_linked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir).select(*KEYS, "own_product")


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = v.star_workspace(spark, sf_dir)
    return an.resolve(v.question_log(spark, sf_dir), workspace, an.calendar(workspace), carried=KEYS)


def l7_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select(*KEYS, "intent", "product", "month")


def w6_carried_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context each answer hands to the next turn."""
    context = F.col("context")
    return _answers(spark, sf_dir).select(
        *KEYS, context["intent"].alias("intent"), context["product"].alias("product"), context["date_from"].alias("date_from")
    )


def l8_month_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select(*KEYS, "date_from", "date_to")


def l9_category_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_intent(spark, sf_dir, qu.CATEGORY_LEADER)


def l10_product_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_intent(spark, sf_dir, qu.PRODUCT_REVENUE)


def l11_ranking_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_intent(spark, sf_dir, qu.PRODUCT_RANKING)


def l12_trend_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_intent(spark, sf_dir, qu.AOV_TREND)


def l13_store_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_intent(spark, sf_dir, qu.STORE_COMPARISON)


def l14_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).where("status = 'unsupported'").select(
        *KEYS, "reason", "answer", F.size("citations").alias("n_citations"), F.col("context").isNotNull().alias("keeps_context")
    )


def l15_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = _answers(spark, sf_dir).select(*KEYS, F.posexplode("citations").alias("number", "c"))
    dims = F.coalesce(F.array_join(F.map_values("c.dimensions"), ","), F.lit(""))
    return cited.select(
        *KEYS, "number", "c.evidence_id", "c.processing_run_id", "c.metric", "c.label", "c.value", "c.display_value",
        dims.alias("dimension_value"), "c.scope",
    )


def f6_coverage_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).where(F.col("reason").isin("outside", "product_outside")).select(*KEYS, "reason", "answer")


def f7_out_of_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = v.question_log(spark, sf_dir).unionByName(v.table(spark, sf_dir, "conversations").select(*KEYS, "text"))
    return texts.where(qu.is_out_of_scope(qu.plain_question(F.col("text")))).select(*KEYS, "text")


_KINDS = {
    qu.PRODUCT_REVENUE: "product", qu.CATEGORY_LEADER: "category", qu.AOV_TREND: "trend", qu.PRODUCT_RANKING: "ranking",
    qu.STORE_COMPARISON: "store",
}


def _expected(workspace: Workspace, kind: str, metric: str, dimension: str | None, best: bool = False) -> DataFrame:
    """What metric queries say for each month and, if there is a dimension, for all time: kind, name, date, expected.

    Each is stored as soon as it is made, so that no two need the disk at once.
    """
    found = []
    for dated in (True, False) if dimension else (True,):
        keys = tuple(k for k in (dimension, "date" if dated else None) if k)
        values = m.metric_table(workspace, (metric,), MetricQuery(metric, keys, grain="month"))
        name = F.col(dimension) if dimension and not best else F.lit("")
        rows = values.select(
            F.lit(kind).alias("kind"), name.alias("name"), (F.col("date") if dated else F.lit("")).alias("date"),
            F.col(metric).cast("double").alias("expected"),
        )
        rows = rows.groupBy("kind", "name", "date").agg(F.max("expected").alias("expected")) if best else rows
        found.append(cut_lineage(rows, "expected"))
    return found[0].unionByName(found[-1]) if dimension else found[0]


def j9_reconciled_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cited value against independent metric queries: products, trends, and the leaders of categories, rankings and stores.

    A store answer cites the leader's revenue, compared with the largest of its
    period, and its average order value, compared with that store's own.
    """
    workspace = v.star_workspace(spark, sf_dir)
    kind = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])[F.col("intent")]
    month = F.coalesce(F.date_format("date_from", "yyyy-MM"), F.lit(""))
    cited = (
        _answers(spark, sf_dir, evidence=False).where(F.col("intent").isin(*_KINDS) & (F.col("status") == "answered"))
        .select(kind.alias("kind"), "product", month.alias("month"), F.explode("citations").alias("c"))
        .withColumn("kind", F.when(F.col("c.metric") == "average_order_value", F.replace("kind", F.lit("store"), F.lit("store_aov"))).otherwise(F.col("kind")))
        .select(
            "kind", F.when(F.col("kind") == "product", F.col("product")).when(F.col("kind") == "store_aov", F.col("c.dimensions")["store"]).otherwise("").alias("name"),
            F.when(F.col("kind") == "trend", F.col("c.dimensions")["date"]).otherwise(F.col("month")).alias("date"), "c.value",
        )
        .groupBy("kind", "name", "date")
        .agg(F.count(F.lit(1)).alias("answers"), F.min("value").alias("low"), F.max("value").alias("high"))
    )
    expected = (
        _expected(workspace, "product", "revenue", "product")
        .unionByName(_expected(workspace, "category", "revenue", "store_category", best=True))
        .unionByName(_expected(workspace, "trend", "average_order_value", None))
        .unionByName(_expected(workspace, "ranking", "revenue", "product", best=True))
        .unionByName(_expected(workspace, "store", "revenue", "store", best=True))
        .unionByName(_expected(workspace, "store_aov", "average_order_value", "store"))
    )
    value = F.coalesce("expected", F.lit(0.0))
    wrong = ~(F.col("low").eqNullSafe(value) & F.col("high").eqNullSafe(value))
    return cut_lineage(cited, "cited").join(expected, ["kind", "name", "date"], "left").groupBy("kind").agg(
        F.sum("answers").cast("bigint").alias("answers"), F.count(F.lit(1)).alias("cells"),
        F.count_if(wrong).alias("mismatches"),
    )


QUERIES = {
    f"q_{f.__name__}": f
    for f in (
        l1_plain_questions, l2_months, l3_intents, l3_prose_has_no_intent, l4_phrases, l5_aliases, a11_alias_owners,
        j7_question_aliases, l6_linked_products, l7_contexts, w6_carried_contexts, l8_month_ranges, l9_category_answers,
        l10_product_answers, l11_ranking_answers, l12_trend_answers, l13_store_answers, l14_refusals, l15_citations,
        f6_coverage_gate, f7_out_of_scope, j9_reconciled_answers,
    )
}
