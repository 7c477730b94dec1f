"""The spread paths against plain Python, with one key holding a third of all rows."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sumstead.model import MetricQuery, Workspace
from sumstead.operators import cleaning as c
from sumstead.operators.answers import store_periods
from sumstead.operators.metrics import metric_points
from sumstead.operators.skew import fits_broadcast, join_one
from sumstead.plans import views as v

SF = "/root/testdata/sf0.001"


def _raw():
    rows = []
    for n in range(2, 602):
        kind = n % 3
        if kind == 0:  # one order id with many contents, among them many copies
            order, qty = "ORD1", str(1 + n % 4)
        elif n % 7 == 0:  # one content with many copies
            order, qty = "ORD2", "2"
        else:
            order, qty = f"ORD{n // 5}x", "1" if n % 11 else "0"
        store = "S9" if n % 13 == 0 else "s1 "
        rows.append((n, order, "2026/05/07" if n % 2 else "2026-05-07", store, "P1", qty, f"{int(qty) * 3}.00", "card"))
    return rows


def _expected(rows):
    kept, dropped, repairs = {}, [], 0
    for n, order, date, store, product, qty, amount, pay in rows:
        repairs += ("/" in date) + (store != store.strip().upper())
        key = (order, store.strip().upper(), product, qty, amount, pay)
        if key in kept:
            dropped.append((n, kept[key]))
        else:
            kept[key] = n
    per_order = Counter(k[0] for k in kept)
    reasons = {}
    for key, n in kept.items():
        if per_order[key[0]] > 1:
            reasons[n] = "conflicting_order_id"
        elif key[1] == "S9":
            reasons[n] = "unknown_store"
        elif key[3] == "0":
            reasons[n] = "invalid_quantity"
        else:
            reasons[n] = None
    return dropped, reasons, repairs


def test_hot_orders_and_contents_match_plain_python(spark):
    rows = _raw()
    dropped, reasons, repairs = _expected(rows)
    raw = spark.createDataFrame(
        rows, "source_row_number long, order_id string, date string, store_id string, product_id string, qty string, amount string, payment string"
    )
    stores = spark.createDataFrame([("S1",)], "store_id string")
    products = spark.createDataFrame([("P1", 300)], "product_id string, unit_price_cents long")
    candidates = c.normalize_sales(raw)
    for bound in (None, 0):
        judged = c.judge(candidates, stores, products, hot_rows=20, bound=bound)
        assert {r[0]: r[1] for r in judged.select("source_row_number", "reason_code").collect()} == reasons
        duplicates = c.duplicate_events(candidates, hot_rows=20, bound=bound)
        found = duplicates.select(
            "source_row_number", F.get_json_object("details", "$.kept_source_row_number").cast("long")
        ).collect()
        assert sorted(map(tuple, found)) == sorted(dropped)
    summary = c.run_summary(judged).first().asDict()
    assert summary["raw_sales_records"] == len(rows)
    assert summary["repair_events"] == repairs
    total = summary["accepted_sales_records"] + summary["deduplicated_records"] + summary["quarantined_records"]
    assert total == len(rows)


def test_spread_join_equals_plain_join(spark):
    rows = spark.range(3000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 40).alias("k")
    )
    one = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 10).alias("value"))
    for how in ("inner", "left"):
        plain = sorted(rows.join(one, "k", how).select("id", "k", "value").collect(), key=repr)
        spread = join_one(rows, one, "k", how, ["id"], bound=0, hot_rows=50).select("id", "k", "value")
        assert sorted(spread.collect(), key=repr) == plain


def test_large_tables_give_the_same_metrics(spark):
    workspace = v.star_workspace(spark, SF)
    for metric in ("revenue", "order_count", "average_order_value"):
        query = MetricQuery(metric, ("product", "store_category"), {"product_category": ("ECONOMY", "PROMO")}, limit=500)
        assert metric_points(workspace, query, bound=0).collect() == metric_points(workspace, query).collect()


def test_dimension_contract(spark):
    frame = spark.createDataFrame([(2, "A", "x"), (3, "A", "y"), (4, None, "z"), (5, "B", None)],
                                  "source_row_number long, key string, name string")
    assert c.dimension_violations(frame, "key").first().asDict() == {"incomplete_rows": 2, "repeated_keys": 1}


def test_ledger_has_one_row_per_decision(spark):
    run = c.clean(v.raw_sales(spark, SF), v.raw_stores(spark, SF), v.raw_products(spark, SF))
    actions = defaultdict(int)
    for action, n in run.events.groupBy("action").count().collect():
        actions[action] = n
    summary = run.summary.first()
    assert actions["repaired"] == summary["repair_events"]
    assert actions["deduplicated"] == summary["deduplicated_records"]
    assert actions["quarantined"] == summary["quarantined_records"]
    assert actions["classified"] == summary["refund_records"]
    assert run.accepted.count() == run.accepted.select("order_id").distinct().count()


def test_a_small_side_is_broadcast_and_a_large_one_is_spread(spark):
    workspace = v.star_workspace(spark, SF)
    plain, spread = (
        join_one(workspace.facts, workspace.tables["store"], "store_id", spread_by=["order_id"], bound=bound)
        for bound in (None, 0)
    )
    plans = [f._jdf.queryExecution().executedPlan().toString() for f in (plain, spread)]
    assert "BroadcastHashJoin" in plans[0] and "approx_top_k" not in plans[0] and "SortMergeJoin" not in plans[0]
    assert "_slot" in plans[1]
    columns = sorted(plain.columns)
    assert sorted(map(tuple, plain.select(columns).collect())) == sorted(map(tuple, spread.select(columns).collect()))


def test_a_plan_that_cannot_be_seen_is_not_broadcast(spark):
    class Remote:
        """A frame without a plan in this process."""

    assert not fits_broadcast(Remote())
    assert fits_broadcast(spark.range(3)) and not fits_broadcast(spark.range(3), 0)


def test_store_orders_equal_distinct_counts(spark):
    facts = spark.createDataFrame(
        [(1, "2026-01-05", "a", 5), (1, "2026-01-06", "a", 7), (1, "2026-02-01", "a", 1), (1, "2025-02-01", "a", 2), (1, "2026-02-02", None, 9),
         (2, "2026-03-01", None, 3), (2, "2025-03-01", "b", None), (3, "2026-12-31", "c", -4)],
        "store_id long, d string, order_id string, amount_cents long").withColumn("sale_date", F.to_date("d"))
    stores = spark.createDataFrame([(1, "x"), (2, "x"), (3, "y")], "store_id long, store_name string")
    workspace = Workspace(v.STAR_MODEL, facts, {"store": stores})
    names, cells = {1: "x", 2: "x", 3: "y"}, defaultdict(lambda: [None, set()])
    for r in facts.collect():
        for period in [0] + [r["sale_date"].month] * (r["sale_date"].year == 2026):
            cell = cells[names[r["store_id"]], period]
            if r["amount_cents"] is not None:
                cell[0] = (cell[0] or 0) + r["amount_cents"]
            cell[1] |= {r["order_id"]} - {None}
    found = store_periods(workspace, 2026).select("name", "period", "value", "orders").collect()
    assert sorted(map(tuple, found)) == sorted((n, p, total, len(orders)) for (n, p), (total, orders) in cells.items())


def test_rows_without_copies_go_before_the_shuffle(spark):
    rows = _raw()
    raw = spark.createDataFrame(
        rows, "source_row_number long, order_id string, date string, store_id string, product_id string, qty string, amount string, payment string"
    )
    found = c.duplicate_events(c.normalize_sales(raw), bound=40_000)
    assert "_mark" in found._jdf.queryExecution().optimizedPlan().toString()
    pairs = found.select("source_row_number", F.get_json_object("details", "$.kept_source_row_number").cast("long")).collect()
    assert sorted(map(tuple, pairs)) == sorted(_expected(rows)[0])


def test_parsers_run_as_methods_that_are_compiled(spark):
    c.normalize_sales(v.raw_sales(spark, SF))
    assert spark.conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"


def test_the_dashboard_counts_orders_one_part_at_a_time(spark):
    from sumstead.operators.dashboard import dashboard

    plan = dashboard(v.star_workspace(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
