"""Findings from the last months and days of the accepted facts.

The series behind them have one row per month or per day of the calendar.
Findings that lack data (fewer than two months, fewer than eight days, no
comparable day) are simply absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumstead import fixed_values as fixed
from sumstead.functions.display import (
    direction,
    grain_text,
    money,
    percent_change,
    percent_text,
    signed_money,
)
from sumstead.functions.hashing import evidence_id
from sumstead.functions.text import fill
from sumstead.model import MetricQuery, Workspace
from sumstead.operators.metrics import coverage, metric_table
from sumstead.operators.skew import join_one

COLUMNS = (
    "sequence", "kind", "tone", "priority", "title", "narrative", "action", "impact_display",
    "target", "highlight", "evidence_ids",
)


def _static_evidence(workspace: Workspace, *queries: MetricQuery) -> Column:
    ids = [q.evidence_id(workspace.model.slug, workspace.run_id) for q in queries]
    return F.array(*[F.lit(i) for i in ids])


def monthly_series(workspace: Workspace) -> DataFrame:
    """M2: revenue, orders and average order value of every observed month."""
    query = MetricQuery("revenue", ("date",), grain="month")
    return metric_table(workspace, ("revenue", "order_count", "average_order_value"), query).withColumnRenamed(
        "date", "month"
    )


def last_two_months(monthly: DataFrame) -> DataFrame:
    """The last observed month beside the observed month before it."""
    order = Window.orderBy("month")
    two = monthly.orderBy(F.col("month").desc()).limit(2)
    measures = [c for c in monthly.columns if c != "month"]
    return (
        two.select("*", *[F.lag(c).over(order).alias(f"previous_{c}") for c in (*measures, "month")])
        .where(F.col("previous_month").isNotNull())
    )


def performance_pulse(workspace: Workspace) -> DataFrame:
    """I1"""
    changes = last_two_months(monthly_series(workspace)).select(
        "*",
        percent_change(F.col("previous_revenue"), F.col("revenue")).alias("_revenue"),
        percent_change(F.col("previous_order_count"), F.col("order_count")).alias("_orders"),
        percent_change(F.col("previous_average_order_value"), F.col("average_order_value")).alias("_aov"),
    )
    revenue, orders, aov = F.col("_revenue"), F.col("_orders"), F.col("_aov")
    by_orders = F.abs(orders) >= F.abs(aov)
    return changes.select(
        F.lit(1).alias("sequence"),
        F.lit("performance_pulse").alias("kind"),
        F.when(revenue >= 0, "positive").otherwise("watch").alias("tone"),
        F.when(F.abs(revenue) >= fixed.PULSE_HIGH_CHANGE, "high").otherwise("medium").alias("priority"),
        fill(
            fixed.PULSE_TITLE, period=F.col("month"), change=percent_text(F.abs(revenue)),
            direction=direction(revenue, down=fixed.WORD_FALL_BACK),
        ).alias("title"),
        fill(
            fixed.PULSE_NARRATIVE,
            orders_direction=direction(orders), orders_change=percent_text(F.abs(orders)),
            aov_direction=direction(aov), aov_change=percent_text(F.abs(aov)),
            driver=F.when(by_orders, fixed.DRIVER_ORDERS).otherwise(fixed.DRIVER_AOV),
        ).alias("narrative"),
        F.when(by_orders & (revenue >= 0), fixed.PULSE_ACTION_ORDERS_UP)
        .otherwise(fixed.PULSE_ACTION_OTHER).alias("action"),
        signed_money(F.col("revenue") - F.col("previous_revenue")).alias("impact_display"),
        F.lit("revenue_trend").alias("target"),
        F.lit(None).cast("string").alias("highlight"),
        _static_evidence(
            workspace,
            *[MetricQuery(m, ("date",), grain="month") for m in ("revenue", "order_count", "average_order_value")],
        ).alias("evidence_ids"),
    )


def product_changes(workspace: Workspace, bound: int | None = None) -> DataFrame:
    """Products of the last month against the calendar month before it.

    The two-month range is a filter on the date column, so older data is
    skipped; facts are added up by product key before names are joined.
    """
    model = workspace.model
    relation = model.relation("product")
    last_day = coverage(workspace).select("last_day").scalar()
    latest = F.trunc(last_day, "month")
    day = F.col(model.date_column)
    is_latest = day >= latest
    by_key = (
        workspace.facts.where(day >= F.add_months(latest, -1))
        .groupBy(F.col(relation.fact_key).alias("_key"))
        .agg(
            F.sum(F.when(is_latest, F.col("amount_cents"))).alias("_latest"),
            F.sum(F.when(~is_latest, F.col("amount_cents"))).alias("_previous"),
        )
    )
    names = workspace.tables["product"].select(
        F.col(relation.table_key).alias("_key"), F.col(model.dimension("product").column).alias("product")
    )
    return (
        join_one(by_key, names, "_key", bound=bound)
        .groupBy("product")
        .agg(F.sum("_latest").alias("latest"), F.coalesce(F.sum("_previous"), F.lit(0)).alias("previous"))
        .where(F.col("latest").isNotNull())
        .withColumn("change", F.col("latest") - F.col("previous"))
    )


def growth_driver(workspace: Workspace) -> DataFrame:
    """The largest gain; the smallest name among equals."""
    top = product_changes(workspace).orderBy(F.col("change").desc(), F.col("product").asc()).limit(1)
    last_day = coverage(workspace).select("last_day").scalar()
    latest = F.trunc(last_day, "month")
    previous = F.add_months(latest, -1)

    def evidence(first: Column) -> Column:
        return evidence_id(
            F.lit(workspace.model.slug), F.lit(workspace.run_id), F.lit("revenue"), F.array(F.lit("product")),
            F.create_map().cast("map<string,array<string>>"), first, F.last_day(first), F.lit("day"), F.lit(100),
        )

    change, name = F.col("change"), F.col("product")
    return top.select(
        F.lit(2).alias("sequence"),
        F.lit("growth_driver").alias("kind"),
        F.when(change >= 0, "positive").otherwise("watch").alias("tone"),
        F.lit("medium").alias("priority"),
        fill(fixed.DRIVER_TITLE, name=name).alias("title"),
        fill(fixed.DRIVER_NARRATIVE, name=name, change=signed_money(change)).alias("narrative"),
        fill(fixed.DRIVER_ACTION, name=name).alias("action"),
        signed_money(change).alias("impact_display"),
        F.lit("product_ranking").alias("target"),
        name.alias("highlight"),
        F.array(evidence(previous), evidence(latest)).alias("evidence_ids"),
    )


def daily_series(workspace: Workspace) -> DataFrame:
    """Revenue of every observed day, all days (no page limit)."""
    day = workspace.model.date_column
    return workspace.facts.groupBy(F.col(day).alias("day")).agg(F.sum("amount_cents").alias("revenue"))


def weekday_baselines(daily: DataFrame) -> DataFrame:
    """Each day with the median of the four same weekdays before it."""
    earlier = Window.partitionBy("weekday").orderBy("day").rowsBetween(-fixed.DAILY_COMPARABLE_DAYS, -1)
    sorted_values = F.array_sort(F.collect_list("revenue").over(earlier))
    n = F.size("comparable")
    low = F.element_at("comparable", F.floor((n + 1) / 2).cast("int"))
    high = F.element_at("comparable", F.floor(n / 2 + 1).cast("int"))
    return (
        daily.withColumn("weekday", F.weekday("day"))
        .withColumn("comparable", sorted_values)
        .withColumn("baseline", F.when(n > 0, (low.cast("double") + high.cast("double")) / 2))
    )


def daily_signal(workspace: Workspace) -> DataFrame:
    """The last day against its baseline."""
    daily = daily_series(workspace)
    days = daily.agg(F.count(F.lit(1))).scalar()
    last = (
        weekday_baselines(daily).orderBy(F.col("day").desc()).limit(1)
        .where(F.col("baseline").isNotNull() & (days >= fixed.DAILY_MIN_DAYS))
        .withColumn("_delta", F.col("revenue").cast("double") - F.col("baseline"))
        .withColumn("_percent", percent_change(F.col("baseline"), F.col("revenue")))
    )
    percent, delta = F.col("_percent"), F.col("_delta")
    watch, growth = percent <= -fixed.DAILY_CHANGE, percent >= fixed.DAILY_CHANGE

    def by_tone(when_watch: Column, when_growth: Column, otherwise: Column) -> Column:
        return F.when(watch, when_watch).when(growth, when_growth).otherwise(otherwise)

    def titled(template: str) -> Column:
        return fill(template, month=F.month("day"), day=F.dayofmonth("day"))

    return last.select(
        F.lit(0).alias("sequence"),
        F.lit("daily_signal").alias("kind"),
        by_tone(F.lit("watch"), F.lit("positive"), F.lit("neutral")).alias("tone"),
        F.when(F.abs(percent) >= fixed.DAILY_HIGH_CHANGE, "high")
        .when(F.abs(percent) >= fixed.DAILY_CHANGE, "medium").otherwise("low").alias("priority"),
        by_tone(titled(fixed.DAILY_TITLE_WATCH), titled(fixed.DAILY_TITLE_POSITIVE),
                titled(fixed.DAILY_TITLE_NEUTRAL)).alias("title"),
        fill(
            fixed.DAILY_NARRATIVE, value=money(F.col("revenue")), change=percent_text(F.abs(percent)),
            direction=F.when(delta >= 0, fixed.WORD_HIGH).otherwise(fixed.WORD_LOW),
        ).alias("narrative"),
        by_tone(F.lit(fixed.DAILY_ACTION_WATCH), F.lit(fixed.DAILY_ACTION_POSITIVE),
                F.lit(fixed.DAILY_ACTION_NEUTRAL)).alias("action"),
        signed_money(delta).alias("impact_display"),
        F.lit("revenue_trend").alias("target"),
        F.lit(None).cast("string").alias("highlight"),
        _static_evidence(workspace, MetricQuery("revenue", ("date",), grain="day", limit=500)).alias("evidence_ids"),
    )


def insight_feed(workspace: Workspace) -> DataFrame:
    """Three findings by priority, then in their fixed sequence."""
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    period = grain_text(coverage(workspace).select("last_day").scalar(), "month")
    findings = (
        daily_signal(workspace).unionByName(performance_pulse(workspace)).unionByName(growth_driver(workspace))
    )
    # Three rows at most.
    return findings.select(
        F.row_number().over(Window.orderBy(rank, "sequence")).alias("position"),
        F.lit(workspace.model.slug).alias("workspace"), period.alias("period"), *COLUMNS[1:],
    )
