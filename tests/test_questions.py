import random
import time

import pytest
from pyspark.sql import functions as F

from sumstead.model import MetricQuery, Workspace
from sumstead.operators import answers as an
from sumstead.operators import conversations as co
from sumstead.operators import questions as q
from sumstead.operators.insights import insight_feed
from sumstead.operators.metrics import metric_points
from sumstead.plans.question_queries import j9_reconciled_answers
from sumstead.plans.views import STAR_MODEL
from sumstead.session import RELEASE, cut_lineage

READINGS = [
    ("凉茶的销售额", "product_revenue", "凉茶", None),
    ("请问 Green Tea 卖了多少!", "product_revenue", "greentea", None),
    ("豆浆营业额是", "product_revenue", "豆浆", None),
    ("查一下2031年八月份，豆浆 Soup 多少钱", "product_revenue", "豆浆soup", 8),
    ("12月豆浆的营业额", "product_revenue", "豆浆", 12),
    ("产品销售额排行", "product_ranking", None, None),
    ("营业额最高的产品榜单", "product_ranking", None, None),
    ("哪个商品卖的最多", "product_ranking", None, None),
    ("油条的销售情况", "product_revenue", "油条", None),
    ("看一下油条卖得怎么样", "product_revenue", "油条", None),
    ("销售情况", None, None, None),
    ("九月营业额第一的品类", "category_leader", None, 9),
    ("说说客单价的趋势", "aov_trend", None, None),
    ("请把各门店比较一遍", "store_comparison", None, None),
    ("明年的成本是多少", None, None, None),
    ("未来天气", None, None, None),
]


def test_questions_are_read(spark):
    frame = spark.createDataFrame([(i, t[0]) for i, t in enumerate(READINGS)], "i int, text string")
    rows = q.read_questions(frame).orderBy("i").collect()
    assert [(r.text, r.intent, r.phrase, r.own_month) for r in rows] == READINGS


def _fold(turns):
    """The contexts of one conversation, turn by turn."""
    before, seen = None, []
    for t in turns:
        seen.append(before)
        if before is not None and t["follow_up"] and t["month"] is not None:
            intent = before[0]
            if intent == "product_revenue":
                product = t["matched"] if t["match_count"] == 1 else before[1] if t["match_count"] == 0 else None
                before = None if product is None else (intent, product, t["month"])
            else:
                before = None if intent == "store_comparison" and t["month"] == 3 else (intent, None, t["month"])
        else:
            before = t["own"]
    return seen


@pytest.mark.parametrize("longest", [None, 99])
def test_chunked_contexts_equal_the_turn_by_turn_fold(spark, longest):
    rng = random.Random(5)
    rows, expected = [], {}
    for conv, n in ((1, 90), (2, 3), (3, 1), (4, 17), (5, 40)):
        turns = []
        for turn in range(n):
            own = rng.choice([None, ("product_revenue", "p1", None), ("aov_trend", None, None), ("store_comparison", None, 2)])
            count = rng.choice([0, 0, 0, 1, 2])
            turns.append({
                "own": own if rng.random() < 0.3 else None, "follow_up": rng.random() < 0.95,
                "month": rng.choice([1, 2, 3, 4]) if rng.random() < 0.95 else None,
                "match_count": count, "matched": f"m{turn}" if count == 1 else None,
            })
        for turn, before in enumerate(_fold(turns)):
            expected[conv, turn] = before
        rows += [(conv, turn, t["follow_up"], t["month"], t["match_count"], t["matched"], t["own"]) for turn, t in enumerate(turns)]
    frame = spark.createDataFrame(
        rows, f"conv_id long, turn long, follow_up boolean, month int, match_count long, matched string, own_state {co.STATE}"
    )
    kept = {i: F.lit(True) for i in co.PLAIN_INTENTS}
    kept["store_comparison"] = F.col("month") != 3
    chunk = 4 if longest is None else 512
    found = co.contexts(frame, kept, longest=longest, chunk=chunk).select("conv_id", "turn", "before").collect()
    assert {(r.conv_id, r.turn): r.before and tuple(r.before) for r in found} == expected


@pytest.fixture(scope="module")
def shop(spark):
    stores = spark.createDataFrame([(1, "North", "A"), (2, "South", "B")], "store_id long, store_name string, category string")
    products = spark.createDataFrame(
        [(1, "牛肉poke", "x"), (2, "鸡肉poke", "x"), (3, "三文鱼poke", "x"), (4, "绿茶", "y")],
        "product_id long, product_name string, product_category string",
    )
    sales, n = [], 0
    for month in (5, 6, 7):
        for day in range(1, 29):
            for product in (1, 2, 3):
                n += 1
                sales.append((f"o{n}", f"2026-{month:02d}-{day:02d}", 1 + n % 2, product, 1, 100 * product + month * day))
    facts = spark.createDataFrame(
        sales, "order_id string, d string, store_id long, product_id long, quantity long, amount_cents long"
    ).withColumn("sale_date", F.to_date("d"))
    return Workspace(STAR_MODEL, facts, {"store": stores, "product": products})


def test_answers_refuse_link_and_follow_up(spark, shop):
    asked = [
        (1, 1, "请问牛肉 poke 六月多少钱", "answered", "牛肉poke"),
        (1, 2, "五月呢", "answered", "牛肉poke"),
        (1, 3, "七月的三文鱼呢", "answered", "三文鱼poke"),
        (1, 4, "改成三月", "unsupported", "三文鱼poke"),
        (2, 1, "六月牛肉poke和鸡肉的销售额是多少", "unsupported", None),
        (2, 2, "五月呢", "unsupported", None),
        (3, 1, "比萨饼在6月卖了多少钱", "unsupported", None),
        (4, 1, "红茶卖了多少", "unsupported", None),
        (5, 1, "六月各门店对比", "answered", None),
        (5, 2, "改成五月", "answered", None),
        (6, 1, "三月收入最多的门店品类", "unsupported", None),
        (7, 1, "产品销售额排行榜单", "answered", None),
    ]
    frame = spark.createDataFrame([a[:3] for a in asked], "conv_id long, turn long, text string")
    rows = {(r.conv_id, r.turn): r for r in an.answer(frame, shop).collect()}
    for conv, turn, text, status, product in asked:
        assert (rows[conv, turn].status, rows[conv, turn].product) == (status, product), text
        assert bool(rows[conv, turn].citations) == (status == "answered")
    cited = rows[1, 2].citations[0]
    query = MetricQuery("revenue", filters={"product": ("牛肉poke",), "date": ("2026-05",)}, grain="month")
    assert metric_points(shop, query).first().value == cited.value
    assert cited.display_value in rows[1, 2].answer
    assert rows[5, 2].intent == "store_comparison" and rows[5, 2].answer.startswith("5月共有2家门店")
    assert "2026年5月1日至2026年7月28日" in rows[6, 1].answer
    assert rows[7, 1].answer.startswith("全部可信记录的营业额前10商品依次是：三文鱼poke、鸡肉poke、牛肉poke")


def test_findings_come_in_priority_order(spark, shop):
    feed = insight_feed(shop).orderBy("position").collect()
    assert {r.kind for r in feed} == {"daily_signal", "performance_pulse", "growth_driver"}
    ranks = [("high", "medium", "low").index(r.priority) for r in feed]
    assert ranks == sorted(ranks) and feed[0].period == "2026-07"


def test_turns_travel_without_maps_and_unread_texts(spark, shop):
    asked = spark.createDataFrame([(1, 1, "请问牛肉 poke 六月多少钱"), (1, 2, "五月呢")], "conv_id long, turn long, text string")
    found = an.answer(asked, shop, carried=("conv_id", "turn"), evidence=False)
    assert "text" not in found.columns
    assert {(r.turn, r.product, r.citations[0].evidence_id) for r in found.collect()} == {(1, "牛肉poke", None), (2, "牛肉poke", None)}
    grouped = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "collect_list" in line]
    assert grouped and not any("own_state" not in line or "plain" in line for line in grouped if "kept" in line)


def test_reconciled_answers_store_each_part(spark, tmp_path):
    """What is left to run reads stored parts only, so no two of them are shuffled at once."""
    days = F.date_add(F.lit("2026-05-01").cast("date"), (F.col("id") % 80).cast("int"))
    tables = {
        "region": spark.createDataFrame([(0, "A"), (1, "B")], "r_regionkey int, r_name string"),
        "nation": spark.createDataFrame([(0, "x", 0), (1, "y", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": spark.range(4).selectExpr("id AS s_suppkey", "concat('S', id) AS s_name", "cast(id % 2 AS int) AS s_nationkey"),
        "part": spark.createDataFrame([(0, "red bolt", "t"), (1, "blue ring", "t"), (2, "old plate", "u")], "p_partkey long, p_name string, p_type string"),
        "orders": spark.range(64).selectExpr("id AS o_orderkey"),
        "lineitem": spark.range(200).select(
            (F.col("id") % 64).alias("l_orderkey"), (F.col("id") % 3).alias("l_partkey"), (F.col("id") % 4).alias("l_suppkey"),
            F.lit(1.0).alias("l_quantity"), (F.col("id") + 0.5).alias("l_extendedprice"), days.alias("l_shipdate"), F.lit("N").alias("l_returnflag")),
    }
    for name, frame in tables.items():
        frame.write.parquet(f"{tmp_path}/{name}.parquet")

    released = spark.conf.get(RELEASE)
    found = j9_reconciled_answers(spark, str(tmp_path))
    assert found.inputFiles() and not any(str(tmp_path) in path for path in found.inputFiles())
    assert spark.conf.get(RELEASE) == released
    rows = {r["kind"]: r for r in found.collect()}
    assert set(rows) >= {"product", "store", "store_aov"} and not any(r["mismatches"] for r in rows.values())


def test_a_stored_frame_leaves_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = shuffled()
    frame = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    stored = cut_lineage(frame)
    until = time.time() + 60
    while shuffled() - before and time.time() < until:
        time.sleep(0.5)
    assert not shuffled() - before
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, frame.collect()))


@pytest.mark.parametrize("bound", [None, 0])
def test_store_periods_take_nulls_and_repeated_keys(spark, bound):
    stores = [(1, "North"), (1, "North"), (2, None), (3, None), (4, "South")]
    sales = [("a", "2026-05-01", 1, 5), ("a", "2026-06-01", 1, None), (None, "2026-06-01", 1, 7), (None, None, 4, 3), ("b", "2025-06-01", 2, 2),
             ("b", "2026-07-01", 3, 4), ("c", "2026-07-01", 3, 4), ("c", "2026-07-01", None, 9), ("d", "2026-08-01", 4, None)]
    facts = spark.createDataFrame(sales, "order_id string, d string, store_id long, amount_cents long").withColumn("sale_date", F.to_date("d"))
    workspace = Workspace(STAR_MODEL, facts, {"store": spark.createDataFrame(stores, "store_id long, store_name string")})
    wanted = {}
    for order, day, key, cents in sales:
        for own, name in stores:
            if own == key:
                for period in {0} | ({int(day[5:7])} if day and day[:4] == "2026" else set()):
                    cell = wanted.setdefault((name, period), [None, set()])
                    cell[0] = cell[0] if cents is None else (cell[0] or 0) + cents
                    cell[1] |= {order} - {None}
    found = an.store_periods(workspace, 2026, bound).collect()
    assert len(found) == len(wanted)
    assert {(r["name"], r["period"]): (r["value"], r["orders"]) for r in found} == {k: (v, len(o)) for k, (v, o) in wanted.items()}
