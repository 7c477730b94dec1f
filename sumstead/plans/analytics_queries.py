"""Registered queries of the metric layer, the dashboard and the findings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumstead.functions import display as d
from sumstead.model import MetricQuery
from sumstead.operators import answers as an
from sumstead.operators import dashboard as db
from sumstead.operators import insights as ins
from sumstead.operators import metrics as m
from sumstead.operators import query_log as ql
from sumstead.operators.skew import join_one
from sumstead.plans import cleaning_queries as cq
from sumstead.plans import views as v

FROM, TO = dt.date(1997, 3, 1), dt.date(1998, 2, 28)
STORES = ("Supplier#000000001", "Supplier#000000002", "Supplier#000000007")


def _points(spark: SparkSession, sf_dir: str, metric: str, *group_by: str, **parts) -> DataFrame:
    return m.metric_points(v.star_workspace(spark, sf_dir), MetricQuery(metric, group_by, **parts))


def _groups(workspace: Workspace, metric: str, *group_by: str, **parts) -> DataFrame:
    """Every group of a metric, where a limit is not the feature."""
    return m.metric_table(workspace, (metric,), MetricQuery(metric, group_by, **parts)).withColumnRenamed(metric, "value")


def _all(spark: SparkSession, sf_dir: str, metric: str, *group_by: str, **parts) -> DataFrame:
    return _groups(v.star_workspace(spark, sf_dir), metric, *group_by, **parts)


def n9_date_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = v.star_workspace(spark, sf_dir).facts.select("sale_date").distinct()
    return days.select(
        "sale_date", d.grain_text(F.col("sale_date"), "day").alias("day"),
        d.grain_text(F.col("sale_date"), "month").alias("month"),
    )


def n10_dimension_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "quantity", "store_key")


def n11_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "average_order_value", "product")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each month beside the observed month before it; one row per month."""
    monthly = ins.monthly_series(v.star_workspace(spark, sf_dir))
    return monthly.withColumn("previous_revenue", F.lag("revenue").over(Window.orderBy("month")))


def n12_percent_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = d.percent_change(F.col("previous_revenue"), F.col("revenue"))
    return _monthly(spark, sf_dir).select("month", F.round(change, 6).alias("change"))


def n13_money_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "revenue", "product", "date").select(
        "product", "date", d.money(F.col("value")).alias("display")
    )


def n14_signed_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).select(
        "month", d.signed_money(F.col("revenue") - F.col("previous_revenue")).alias("display")
    )


def n15_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _monthly(spark, sf_dir).where("previous_revenue is not null").select(
        "month", d.direction(F.col("revenue") - F.col("previous_revenue")).alias("direction")
    )


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()


def n16_month_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _days(spark, sf_dir).select(F.year("day").alias("year"), F.month("day").alias("month")).distinct()
    first = d.month_first(F.col("year"), F.col("month"))
    return months.select("year", "month", first.alias("first_day"), F.last_day(first).alias("last_day"))


def n17_previous_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.trunc("day", "month")
    return _days(spark, sf_dir).select(first.alias("month"), F.add_months(first, -1).alias("previous_month")).distinct()


def n18_weekday(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("day", F.weekday("day").alias("weekday"))


def n19_date_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _days(spark, sf_dir).select("day", d.date_text(F.col("day")).alias("display"))


def n20_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.with_scope(v.query_log(spark, sf_dir)).select("query_id", "scope")


def n21_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.with_evidence(v.query_log(spark, sf_dir), "star", 7).select("query_id", "evidence_id")


def n24_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _all(spark, sf_dir, "revenue", "product")
    return m.relative_to_leader(products, "value").select("product", F.round("share", 6).alias("share"))


def n25_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ins.daily_series(v.star_workspace(spark, sf_dir))
    return daily.select("day", d.units(F.col("revenue")).alias("revenue"))


def f1_date_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "revenue", "date", date_from=FROM, date_to=TO)


def f2_in_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"store": STORES, "product_category": ("ECONOMY", "PROMO")}
    return _points(spark, sf_dir, "order_count", "store_category", filters=filters)


def f3_date_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = {"date": ("1997-02", "1998-11", "1998-13", "nothing")}
    return _points(spark, sf_dir, "revenue", "date", filters=filters, grain="month")


def f4_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.refusals(v.query_log(spark, sf_dir), v.STAR_MODEL).select("query_id", "refusal")


def j1_store_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "revenue", "store")


def j2_product_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "revenue", "product_category", "store_category")


def j5_product_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.product_changes(v.star_workspace(spark, sf_dir))


def j6_store_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = MetricQuery("revenue", ("store",), date_from=FROM, date_to=TO)
    return m.metric_table(
        v.star_workspace(spark, sf_dir), ("revenue", "order_count", "average_order_value"), query
    )


def j8_product_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = v.star_workspace(spark, sf_dir)
    return an.revenue_by_period(workspace, "product", an.calendar(workspace).year)


def a1_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "revenue", date_from=FROM)


def a2_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "order_count", "store")


def a3_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "average_order_value", "store_category", "product_category")


def a4_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "revenue", "date", "store_category", grain="month")


def a5_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.coverage(v.star_workspace(spark, sf_dir))


def a9_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the comparable days before each day, four at most."""
    daily = ins.daily_series(v.star_workspace(spark, sf_dir))
    return ins.weekday_baselines(daily).select("day", "baseline")


def a10_top_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = v.star_workspace(spark, sf_dir)
    groups = m.aggregate(workspace, MetricQuery("revenue", ("store",)), v.STAR_MODEL.primitives("revenue"))
    return m.top_groups(groups.withColumnRenamed("revenue", "value"), "store", 1)


def a12_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.dashboard(v.star_workspace(spark, sf_dir))


def a12_filtered_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = MetricQuery("revenue", filters={"product_category": ("ECONOMY",)}, date_from=FROM, date_to=TO)
    return db.dashboard(v.star_workspace(spark, sf_dir), query)


def a13_evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three findings, so the list has six ids."""
    feed = ins.insight_feed(v.star_workspace(spark, sf_dir))
    ids = F.flatten(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "evidence_ids"))), lambda e: e["evidence_ids"]
    ))
    return feed.agg(F.array_join(ids, ",").alias("evidence_ids"))


def w3_last_two_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.last_two_months(ins.monthly_series(v.star_workspace(spark, sf_dir)))


def w4_weekday_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = ins.daily_series(v.star_workspace(spark, sf_dir))
    return ins.weekday_baselines(daily).select("day", "weekday", "revenue", "baseline")


def w5_ranked_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = v.star_workspace(spark, sf_dir)
    query = MetricQuery("revenue", ("product",), date_from=FROM, date_to=TO)
    groups = m.aggregate(workspace, query, v.STAR_MODEL.primitives("revenue"))
    return m.top_groups(groups.withColumnRenamed("revenue", "value"), "product", 10)


def t1_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first groups by key: their order decides which they are."""
    return _points(spark, sf_dir, "revenue", "product", "store", limit=250)


def t2_limited_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir, "revenue", "date")


def t3_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    products = _all(spark, sf_dir, "revenue", "product")
    return m.top_groups(products, "product", 10)


def t4_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.insight_feed(v.star_workspace(spark, sf_dir)).select("position", "kind", "priority")


def u2_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    workspace = v.star_workspace(spark, sf_dir)
    parts = [f(workspace) for f in (ins.daily_signal, ins.performance_pulse, ins.growth_driver)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("kind", "tone", "title")


def u3_unknown_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.unknown_dimensions(v.query_log(spark, sf_dir), v.STAR_MODEL).select(
        "query_id", F.array_join("unknown_dimensions", ",").alias("unknown_dimensions")
    )


def x1_filter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ql.filter_pairs(v.query_log(spark, sf_dir))


def m1_metric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = MetricQuery(
        "average_order_value", ("date", "store"), {"store_category": ("ASIA", "EUROPE"), "product_category": ("PROMO",)},
        FROM, TO, "month", 300,
    )
    result = m.metric_result(v.star_workspace(spark, sf_dir), query)
    return result.points.select(
        "*", F.lit(result.evidence.row_count).cast("bigint").alias("row_count"), F.lit(result.evidence.scope).alias("scope"), F.lit(result.evidence.evidence_id).alias("evidence_id")
    )


def m2_monthly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.monthly_series(v.star_workspace(spark, sf_dir))


def m3_category_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.category_contribution(v.star_workspace(spark, sf_dir)).withColumn("share", F.round("share", 6))


def m4_store_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.store_comparison(v.star_workspace(spark, sf_dir)).withColumn("share", F.round("share", 6))


def m5_kpi_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return db.kpi_row(v.star_workspace(spark, sf_dir), cq.run(spark, sf_dir).summary)


def i1_performance_pulse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(ins.performance_pulse(v.star_workspace(spark, sf_dir)))


def i2_growth_driver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(ins.growth_driver(v.star_workspace(spark, sf_dir)))


def i3_daily_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(ins.daily_signal(v.star_workspace(spark, sf_dir)))


def i4_insight_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ins.insight_feed(v.star_workspace(spark, sf_dir)).select("position", "workspace", "period", "kind", "title")


def _texts(findings: DataFrame) -> DataFrame:
    return findings.drop("sequence").withColumn("evidence_ids", F.array_join("evidence_ids", ","))


def e2_workspace_of_clean_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Another domain behind the same model: the tables a cleaning run wrote."""
    workspace = cq.run_store(spark, sf_dir).workspace()
    return _groups(workspace, "average_order_value", "store_category", "product")


def e3_nested_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir, "value_to_unit_revenue", "store")


def join_without_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joins a query does not need change nothing: complete keys keep all facts."""
    workspace = v.star_workspace(spark, sf_dir)
    rows = join_one(workspace.facts, workspace.tables["store"], "store_id")
    rows = join_one(rows, workspace.tables["product"], "product_id")
    return rows.agg(F.sum("amount_cents").cast("bigint").alias("joined")).select(
        "joined", workspace.facts.agg(F.sum("amount_cents")).scalar().cast("bigint").alias("unjoined")
    )


QUERIES = {
    f"q_{f.__name__}": f
    for f in (
        n9_date_grain, n10_dimension_text, n11_ratio, n12_percent_change, n13_money_text, n14_signed_money,
        n15_direction, n16_month_bounds, n17_previous_month, n18_weekday, n19_date_text, n20_scope, n21_evidence,
        n24_share, n25_units, f1_date_range, f2_in_filter, f3_date_values, f4_refusals, j1_store_join,
        j2_product_join, j5_product_changes, j6_store_metrics, j8_product_periods, a1_sum, a2_count_distinct,
        a3_ratio, a4_grouped, a5_coverage, a9_median, a10_top_store, a12_dashboard, a12_filtered_dashboard,
        a13_evidence_list, w3_last_two_months, w4_weekday_baseline, w5_ranked_products, t1_ordered,
        t2_limited_days, t3_top_products, t4_priorities, u2_findings, u3_unknown_dimensions, x1_filter_pairs,
        m1_metric_query, m2_monthly_metrics, m3_category_contribution, m4_store_comparison, m5_kpi_row,
        i1_performance_pulse, i2_growth_driver, i3_daily_signal, i4_insight_feed, e2_workspace_of_clean_tables,
        e3_nested_ratio, join_without_dimension,
    )
}
