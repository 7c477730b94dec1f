"""Views over the test tables: clean sales, raw sales, a question log, a query log."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.fixed_values import MONTH_WORDS
from sumstead.model import Dimension, Metric, Relation, SemanticModel, Workspace
from sumstead.operators.skew import join_one


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


METRICS = (
    Metric("revenue", "营业额", "sum", "currency", "accepted sales net of refunds", field="amount_cents"),
    Metric("order_count", "订单数", "count_distinct", "integer", "distinct order ids", field="order_id"),
    Metric("average_order_value", "客单价", "ratio", "currency", "revenue per distinct order",
           numerator="revenue", denominator="order_count"),
    Metric("quantity", "数量", "sum", "integer", "units sold", field="quantity"),
    Metric("unit_revenue", "单价", "ratio", "currency", "revenue per unit",
           numerator="revenue", denominator="quantity"),
    Metric("value_to_unit_revenue", "比值", "ratio", "decimal", "a ratio of two ratios",
           numerator="average_order_value", denominator="unit_revenue"),
)

STAR_MODEL = SemanticModel(
    slug="star",
    name="line items as sales",
    currency="CNY",
    date_column="sale_date",
    relations=(
        Relation("store_id", "store", "store_id"),
        Relation("product_id", "product", "product_id"),
    ),
    dimensions=(
        Dimension("date", "日期", "date", "sale_date"),
        Dimension("store", "门店", "entity", "store_name", "store"),
        Dimension("store_key", "门店编号", "entity", "store_id"),
        Dimension("store_category", "门店品类", "category", "category", "store"),
        Dimension("product", "商品", "entity", "product_name", "product"),
        Dimension("product_category", "商品品类", "category", "product_category", "product"),
    ),
    metrics=METRICS,
)


def star_workspace(spark: SparkSession, sf_dir: str) -> Workspace:
    """line items as clean sales; suppliers are stores, parts are products."""
    line = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    facts = line.select(
        F.col("l_orderkey").cast("string").alias("order_id"),
        F.to_date("l_shipdate").alias("sale_date"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        F.when(F.col("l_returnflag") == "R", -cents).otherwise(cents).alias("amount_cents"),
    )
    places = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", F.col("r_name").alias("category"))
    )
    stores = (
        table(spark, sf_dir, "supplier")
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), "category")
    )
    products = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.col("p_type").alias("product_category"),
    )
    return Workspace(STAR_MODEL, facts, {"store": stores, "product": products})


# The same view for DuckDB.  A timestamp filter on l_shipdate is not needed
# there: the whole table is read.
STAR_SQL = """
sale AS (
  SELECT cast(l_orderkey AS VARCHAR) AS order_id, cast(l_shipdate AS DATE) AS sale_date,
         l_suppkey AS store_id, l_partkey AS product_id, cast(l_quantity AS BIGINT) AS quantity,
         CASE WHEN l_returnflag = 'R' THEN -cast(round(l_extendedprice * 100) AS BIGINT)
              ELSE cast(round(l_extendedprice * 100) AS BIGINT) END AS amount_cents
  FROM lineitem),
star AS (
  SELECT sale.*, s_name AS store, r_name AS store_category, p_name AS product, p_type AS product_category
  FROM sale
  JOIN supplier ON s_suppkey = store_id
  JOIN nation ON n_nationkey = s_nationkey
  JOIN region ON r_regionkey = n_regionkey
  JOIN part ON p_partkey = product_id)"""


RAW_SALES_COLUMNS = ("order_id", "date", "store_id", "product_id", "qty", "amount", "payment")
KEY_DIGITS = 9


def parts(spark: SparkSession, sf_dir: str) -> Column:
    """Number of parts: keys run from 0, so a remainder by it meets every part."""
    return table(spark, sf_dir, "part").agg(F.count(F.lit(1))).scalar()


def _padded(n: Column, width: int) -> Column:
    return F.lpad(n.cast("string"), width, "0")


def _units_text(cents: Column) -> Column:
    whole = F.floor(cents / 100).cast("bigint")
    return F.concat(whole.cast("string"), F.lit("."), _padded(cents - whole * 100, 2))


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as dirty text rows, with copies and conflicts."""
    k = F.col("o_orderkey")
    copies = F.array_compact(
        F.array(F.lit(0), F.when(k % 150 == 1, 1), F.when(k % 750 == 2, 2))
    )
    n = parts(spark, sf_dir)
    prices = (
        table(spark, sf_dir, "part")
        .select(F.col("p_partkey").alias("pk"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("price"))
    )
    rows = (
        table(spark, sf_dir, "orders")
        .select(k.alias("k"), (F.col("o_custkey") % 25).alias("sk"), F.to_date("o_orderdate").alias("day"),
                (k % n).alias("pk"), F.explode(copies).alias("copy"))
    )
    rows = (
        join_one(rows, prices, "pk", "inner", ["k", "copy"])
        .withColumn("q", 1 + F.col("k") % 4 + F.when(F.col("copy") == 2, 1).otherwise(0))
        .withColumn("total", F.col("q") * F.col("price"))
    )
    k, pk, sk, q, total = (F.col(c) for c in ("k", "pk", "sk", "q", "total"))
    store = F.concat(F.lit("S"), _padded(sk, 2))
    return rows.select(
        (3 * k + F.col("copy") + 2).alias("source_row_number"),
        F.when(k % 550 == 37, "").otherwise(F.concat(F.lit("ORD"), _padded(k, 9))).alias("order_id"),
        F.when(k % 500 == 9, "2026-02-30")
        .when((F.col("copy") == 1) | (k % 50 == 7), F.date_format("day", "yyyy/MM/dd"))
        .when(k % 50 == 8, F.date_format("day", "dd-MM-yyyy"))
        .otherwise(F.date_format("day", "yyyy-MM-dd"))
        .alias("date"),
        F.when(k % 700 == 5, "S99")
        .when(k % 90 == 3, F.concat(F.lit(" "), F.lower(store), F.lit(" ")))
        .otherwise(store).alias("store_id"),
        F.when(k % 400 == 11, "P999").otherwise(F.concat(F.lit("P"), _padded(pk, KEY_DIGITS))).alias("product_id"),
        F.when(k % 300 == 13, "0").when(k % 300 == 14, "2.0").otherwise(q.cast("string")).alias("qty"),
        F.when(k % 100 == 19, "")
        .when(k % 600 == 29, "10.001")
        .when(k % 350 == 23, _units_text(total + 50))
        .when(k % 80 == 17, F.concat(F.lit("¥ "), F.format_number(total / 100, 2)))
        .when(k % 250 == 21, F.concat(F.lit("-"), _units_text(total)))
        .otherwise(_units_text(total)).alias("amount"),
        F.when(k % 450 == 31, " ").when(k % 2 == 0, "card").otherwise("cash").alias("payment"),
    )


RAW_SALES_SQL = """
copies AS (
  SELECT o_orderkey AS k, o_custkey % 25 AS sk, cast(o_orderdate AS DATE) AS day, o_orderkey % (SELECT count(*) FROM part) AS pk, 0 AS copy FROM orders
  UNION ALL
  SELECT o_orderkey, o_custkey % 25, cast(o_orderdate AS DATE), o_orderkey % (SELECT count(*) FROM part), 1 FROM orders WHERE o_orderkey % 150 = 1
  UNION ALL
  SELECT o_orderkey, o_custkey % 25, cast(o_orderdate AS DATE), o_orderkey % (SELECT count(*) FROM part), 2 FROM orders WHERE o_orderkey % 750 = 2),
priced AS (
  SELECT copies.*, 1 + k % 4 + CASE WHEN copy = 2 THEN 1 ELSE 0 END AS q,
         (1 + k % 4 + CASE WHEN copy = 2 THEN 1 ELSE 0 END) * cast(round(p_retailprice * 100) AS BIGINT) AS total
  FROM copies JOIN part ON p_partkey = pk),
raw_sales AS (
  SELECT cast(3 * k + copy + 2 AS BIGINT) AS source_row_number,
    CASE WHEN k % 550 = 37 THEN '' ELSE 'ORD' || lpad(cast(k AS VARCHAR), 9, '0') END AS order_id,
    CASE WHEN k % 500 = 9 THEN '2026-02-30'
         WHEN copy = 1 OR k % 50 = 7 THEN strftime(day, '%Y/%m/%d')
         WHEN k % 50 = 8 THEN strftime(day, '%d-%m-%Y')
         ELSE strftime(day, '%Y-%m-%d') END AS date,
    CASE WHEN k % 700 = 5 THEN 'S99'
         WHEN k % 90 = 3 THEN ' s' || lpad(cast(sk AS VARCHAR), 2, '0') || ' '
         ELSE 'S' || lpad(cast(sk AS VARCHAR), 2, '0') END AS store_id,
    CASE WHEN k % 400 = 11 THEN 'P999' ELSE 'P' || lpad(cast(pk AS VARCHAR), 9, '0') END AS product_id,
    CASE WHEN k % 300 = 13 THEN '0' WHEN k % 300 = 14 THEN '2.0' ELSE cast(q AS VARCHAR) END AS qty,
    CASE WHEN k % 100 = 19 THEN ''
         WHEN k % 600 = 29 THEN '10.001'
         WHEN k % 350 = 23 THEN cast((total + 50) // 100 AS VARCHAR) || '.' || lpad(cast((total + 50) % 100 AS VARCHAR), 2, '0')
         WHEN k % 80 = 17 THEN '¥ ' || format('{:,.2f}', total / 100.0)
         WHEN k % 250 = 21 THEN '-' || cast(total // 100 AS VARCHAR) || '.' || lpad(cast(total % 100 AS VARCHAR), 2, '0')
         ELSE cast(total // 100 AS VARCHAR) || '.' || lpad(cast(total % 100 AS VARCHAR), 2, '0') END AS amount,
    CASE WHEN k % 450 = 31 THEN ' ' WHEN k % 2 = 0 THEN 'card' ELSE 'cash' END AS payment
  FROM priced),
raw_stores AS (
  SELECT cast(n_nationkey + 2 AS BIGINT) AS source_row_number, 'S' || lpad(cast(n_nationkey AS VARCHAR), 2, '0') AS store_id,
         n_name AS store_name, r_name AS category, r_name || '·' || n_name AS district
  FROM nation JOIN region ON r_regionkey = n_regionkey),
raw_products AS (
  SELECT cast(p_partkey + 2 AS BIGINT) AS source_row_number, 'P' || lpad(cast(p_partkey AS VARCHAR), 9, '0') AS product_id,
         p_name AS product_name, p_type AS product_category, cast(p_retailprice AS VARCHAR) AS unit_price
  FROM part)"""


def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            (F.col("n_nationkey") + 2).cast("bigint").alias("source_row_number"),
            F.concat(F.lit("S"), _padded(F.col("n_nationkey"), 2)).alias("store_id"),
            F.col("n_name").alias("store_name"),
            F.col("r_name").alias("category"),
            F.concat(F.col("r_name"), F.lit("·"), F.col("n_name")).alias("district"),
        )
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "part")
        .select(
            (F.col("p_partkey") + 2).alias("source_row_number"),
            F.concat(F.lit("P"), _padded(F.col("p_partkey"), KEY_DIGITS)).alias("product_id"),
            F.col("p_name").alias("product_name"),
            F.col("p_type").alias("product_category"),
            F.col("p_retailprice").cast("string").alias("unit_price"),
        )
    )


# one conversation of three turns per order.
_MONTHS = tuple(MONTH_WORDS)
FIRST_TURN = (
    "请问{name}的销售额是多少",
    "查一下{month}{name}卖了多少",
    "看一下本年{month}{name}的营业额",
    "{name}的销售情况",
    "门店里面销售额第一的是什么品类？",
    "{month}收入最多的门店品类",
    "说说客单价的趋势",
    "请把各门店比较一遍",
    "{month}哪家门店更好",
    "产品销售额排行榜单",
    "{month}卖得最好的产品有哪些",
    "明年的成本对营业额有何影响",
    "{word}的销售额是",
    "{month}{name}还有{other}多少钱",
    "比萨饼在{month}卖了多少钱",
    "您好，今天想跟您随便聊聊别的事情",
)
SECOND_TURN = (
    "{month}呢",
    "换个月，改成{month}吧",
    "那么{other}在{month}呢",
    "{month}卖得最好的产品有哪些",
    "{name}还有{other}{month}呢",
)
THIRD_TURN = ("{month}又怎样呢", "{name}的销售情况", "再改成{month}")


def question_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, text), three turns per order."""
    names = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    k = F.col("o_orderkey")
    months = F.array(*[F.lit(m) for m in _MONTHS])

    def pick(items: Column | tuple[str, ...], index: Column) -> Column:
        listed = items if isinstance(items, Column) else F.array(*[F.lit(i) for i in items])
        return F.element_at(listed, (index + 1).cast("int"))

    n = parts(spark, sf_dir)
    base = table(spark, sf_dir, "orders").select(k.alias("k"), (k % n).alias("a"), ((k * 7 + 3) % n).alias("b"))
    for key, name in (("a", "name"), ("b", "other")):
        base = join_one(base, names.select(F.col("p_partkey").alias(key), F.col("p_name").alias(name)), key, "inner", ["k"])
    k = F.col("k")
    turns = F.array(
        F.struct(F.lit(1).cast("bigint").alias("turn"), pick(FIRST_TURN, k % 16).alias("t"),
                 pick(months, F.floor(k / 16) % 24).alias("m")),
        F.struct(F.lit(2).cast("bigint").alias("turn"), pick(SECOND_TURN, F.floor(k / 3) % 5).alias("t"),
                 pick(months, F.floor(k / 5) % 24).alias("m")),
        F.struct(F.lit(3).cast("bigint").alias("turn"), pick(THIRD_TURN, F.floor(k / 7) % 3).alias("t"),
                 pick(months, F.floor(k / 11) % 24).alias("m")),
    )
    text = F.col("t")
    for mark, value in (
        ("{name}", F.col("name")),
        ("{month}", F.col("m")),
        ("{other}", F.col("other")),
        ("{word}", F.split_part("name", F.lit(" "), F.lit(1))),
    ):
        text = F.replace(text, F.lit(mark), value)
    return base.select(k.alias("conv_id"), "name", "other", F.inline(turns)).select(
        "conv_id", "turn", text.alias("text")
    )


def _sql_list(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + i + "'" for i in items) + "]"


QUESTION_SQL = f"""
named AS (
  SELECT o_orderkey AS k, a.p_name AS name, b.p_name AS other
  FROM orders JOIN part a ON a.p_partkey = o_orderkey % (SELECT count(*) FROM part)
  JOIN part b ON b.p_partkey = (o_orderkey * 7 + 3) % (SELECT count(*) FROM part)),
turns AS (
  SELECT k, name, other, 1 AS turn, {_sql_list(FIRST_TURN)}[k % 16 + 1] AS t, {_sql_list(_MONTHS)}[(k // 16) % 24 + 1] AS m FROM named
  UNION ALL
  SELECT k, name, other, 2, {_sql_list(SECOND_TURN)}[(k // 3) % 5 + 1], {_sql_list(_MONTHS)}[(k // 5) % 24 + 1] FROM named
  UNION ALL
  SELECT k, name, other, 3, {_sql_list(THIRD_TURN)}[(k // 7) % 3 + 1], {_sql_list(_MONTHS)}[(k // 11) % 24 + 1] FROM named),
questions AS (
  SELECT k AS conv_id, cast(turn AS BIGINT) AS turn,
    replace(replace(replace(replace(t, '{{name}}', name), '{{month}}', m), '{{other}}', other),
            '{{word}}', split_part(name, ' ', 1)) AS text
  FROM turns)"""


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One logged metric query per order; some leave the declared contract."""
    k = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    names = F.array(*[F.lit(c) for c in ("date", "store", "store_category", "product", "weather")])
    group_by = (
        F.when(k % 4 == 0, F.array().cast("array<string>"))
        .when(k % 4 == 1, F.array(F.element_at(names, (k % 5 + 1).cast("int"))))
        .otherwise(F.array(F.lit("date"), F.element_at(names, (F.floor(k / 4) % 5 + 1).cast("int"))))
    )
    filters = (
        F.when(k % 3 == 0, F.create_map(F.lit("store"), F.array(F.col("o_orderpriority"), F.lit("一号店"))))
        .when(k % 3 == 1, F.create_map(F.lit("store"), F.array(F.col("o_orderstatus")),
                                       F.lit("product"), F.array(F.lit('a"b'), F.lit("牛肉"))))
        .otherwise(F.create_map().cast("map<string,array<string>>"))
    )
    return table(spark, sf_dir, "orders").select(
        k.alias("query_id"),
        F.element_at(F.array(*[F.lit(m) for m in ("revenue", "order_count", "average_order_value", "profit")]),
                     (k % 4 + 1).cast("int")).alias("metric"),
        group_by.alias("group_by"),
        filters.alias("filters"),
        F.when(k % 5 < 2, day).alias("date_from"),
        F.when(k % 5 == 1, F.date_add(day, 30)).when(k % 5 == 2, day).alias("date_to"),
        F.when(k % 2 == 0, "day").otherwise("month").alias("grain"),
        (k % 600 + 1).alias("limit"),
    )


QUERY_LOG_SQL = """
qlog AS (
  SELECT o_orderkey AS query_id, ['revenue','order_count','average_order_value','profit'][o_orderkey % 4 + 1] AS metric,
    CASE WHEN o_orderkey % 4 = 0 THEN CAST([] AS VARCHAR[])
         WHEN o_orderkey % 4 = 1 THEN [['date','store','store_category','product','weather'][o_orderkey % 5 + 1]]
         ELSE ['date', ['date','store','store_category','product','weather'][(o_orderkey // 4) % 5 + 1]] END AS group_by,
    CASE WHEN o_orderkey % 3 = 0 THEN [o_orderpriority, '一号店'] WHEN o_orderkey % 3 = 1 THEN [o_orderstatus]
         ELSE CAST([] AS VARCHAR[]) END AS store_filter,
    CASE WHEN o_orderkey % 3 = 1 THEN ['a"b', '牛肉'] ELSE CAST([] AS VARCHAR[]) END AS product_filter,
    CASE WHEN o_orderkey % 5 < 2 THEN cast(o_orderdate AS DATE) END AS date_from,
    CASE WHEN o_orderkey % 5 = 1 THEN cast(o_orderdate AS DATE) + 30
         WHEN o_orderkey % 5 = 2 THEN cast(o_orderdate AS DATE) END AS date_to,
    CASE WHEN o_orderkey % 2 = 0 THEN 'day' ELSE 'month' END AS grain,
    o_orderkey % 600 + 1 AS lim
  FROM orders)"""



def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run table: one run per order, one workspace per priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("workspace_slug"),
        F.when(F.col("o_orderstatus") == "O", "running").otherwise("completed").alias("status"),
    )


RUN_LOG_SQL = """
runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS workspace_slug,
    CASE WHEN o_orderstatus = 'O' THEN 'running' ELSE 'completed' END AS status
  FROM orders)"""
