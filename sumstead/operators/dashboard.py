"""Everything a dashboard shows, in two passes over the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead.functions.display import acceptance_rate, grain_text, guarded_ratio
from sumstead.model import MetricQuery, Workspace
from sumstead.operators.metrics import _filtered_facts, aggregate, metric_table, relative_to_leader
from sumstead.operators.skew import join_one

def dashboard(workspace: Workspace, query: MetricQuery | None = None, bound: int | None = None) -> DataFrame:
    """One row per group of each part: revenue everywhere, orders where shown.

    Revenue is added up by day, by store key and by product key in one pass,
    which leaves one row per day, store and product; names, months and the
    total follow from those.  Order ids are counted by name, month and overall.
    """
    query = query or MetricQuery("revenue")
    query.check(workspace.model)
    model = workspace.model
    facts = _scoped(workspace, query, bound)
    day = F.col(model.date_column)
    store, product = model.relation("store"), model.relation("product")
    stores = workspace.tables["store"].select(
        F.col(store.table_key).alias("_store"), F.col("store_name").alias("store"),
        F.col("category").alias("store_category"),
    )
    products = workspace.tables["product"].select(
        F.col(product.table_key).alias("_product"), F.col("product_name").alias("product")
    )
    keyed = facts.select(
        day.alias("_day"), F.col(store.fact_key).alias("_store"), F.col(product.fact_key).alias("_product"),
        "amount_cents",
    )
    sums = keyed.groupingSets([["_day"], ["_store"], ["_product"]], "_day", "_store", "_product").agg(
        F.sum("amount_cents").alias("_cents")
    )
    named = join_one(join_one(sums, stores, "_store", "left", bound=bound), products, "_product", "left", bound=bound)
    labels = F.when(
        F.col("_day").isNotNull(),
        F.array(
            _labelled("overall", F.lit("")), _labelled("day", grain_text(F.col("_day"), "day")),
            _labelled("month", grain_text(F.col("_day"), "month")),
        ),
    ).when(
        F.col("_store").isNotNull(),
        F.array(_labelled("store", F.col("store")), _labelled("store_category", F.col("store_category"))),
    ).otherwise(F.array(_labelled("product", F.col("product"))))
    revenue = named.select(F.inline(labels), "_cents").groupBy("part", "label").agg(
        F.sum("_cents").cast("bigint").alias("revenue")
    )
    orders = facts.select(
        F.trunc(day, "month").alias("_month"), F.col(store.fact_key).alias("_store"), "order_id"
    ).distinct()
    sold = join_one(orders, stores.drop("store_category"), "_store", bound=bound)

    def counted(part: str, label: Column) -> DataFrame:
        # One part at a time: all in one aggregate would hold each order three times in a task.
        return sold.groupBy(F.lit(part).alias("part"), label.alias("label")).agg(F.count_distinct("order_id").alias("order_count"))

    counts = (
        counted("overall", F.lit("")).unionByName(counted("month", grain_text(F.col("_month"), "month")))
        .unionByName(counted("store", F.col("store")))
    )
    return revenue.join(counts, ["part", "label"], "left").select(
        "part", "label", "revenue", "order_count",
        F.when(F.col("order_count").isNotNull(), guarded_ratio(F.col("revenue"), F.col("order_count")))
        .alias("average_order_value"),
    )


def _labelled(part: str, label: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), label.alias("label"))


def _scoped(workspace: Workspace, query: MetricQuery, bound: int | None) -> DataFrame:
    """The facts inside the query's dates and filters, as fact rows."""
    facts = _filtered_facts(workspace, query)
    model = workspace.model
    for name in dict.fromkeys(model.dimension(k).table for k in query.filters):
        if name is None:
            continue
        frame = workspace.tables[name]
        for key, values in query.filters.items():
            if model.dimension(key).table == name:
                frame = frame.where(F.col(model.dimension(key).column).isin(*values))
        kept = frame.select(F.col(model.relation(name).table_key).alias(model.relation(name).fact_key))
        # Keys of a dimension are unique, so this keeps facts as a semi join does, with hot keys spread.
        facts = join_one(facts, kept, model.relation(name).fact_key, "inner", bound=bound)
    return facts


def category_contribution(workspace: Workspace, query: MetricQuery | None = None) -> DataFrame:
    """M3: revenue by store category and its share of the leader's."""
    scope = query or MetricQuery("revenue")
    scope = MetricQuery("revenue", ("store_category",), scope.filters, scope.date_from, scope.date_to)
    scope.check(workspace.model)
    groups = aggregate(workspace, scope, workspace.model.primitives("revenue"))
    return relative_to_leader(groups, "revenue")


def store_comparison(workspace: Workspace, query: MetricQuery | None = None) -> DataFrame:
    """Revenue, orders, average order value and share by store."""
    scope = query or MetricQuery("revenue")
    scope = MetricQuery("revenue", ("store",), scope.filters, scope.date_from, scope.date_to)
    scope.check(workspace.model)
    groups = metric_table(workspace, ("revenue", "order_count", "average_order_value"), scope)
    return relative_to_leader(groups, "revenue")


def kpi_row(workspace: Workspace, summary: DataFrame) -> DataFrame:
    """M5: three overall metrics beside the acceptance rate, one row."""
    totals = metric_table(workspace, ("revenue", "order_count", "average_order_value"), MetricQuery("revenue"))
    rate = acceptance_rate(F.col("accepted_sales_records"), F.col("raw_sales_records")).alias("acceptance_rate")
    # One value for both, so the run is read once.
    both = summary.select(F.struct(rate, "accepted_sales_records")).scalar()
    return totals.withColumn("_run", both).selectExpr("* EXCEPT (_run)", "_run.*")
