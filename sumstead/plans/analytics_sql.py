"""The analytics queries once more, as SQL."""

from sumstead.plans.cleaning_sql import RENUMBERED, CLEANED
from sumstead.plans.views import QUERY_LOG_SQL, STAR_SQL

STAR = f"WITH {STAR_SQL}"
MONTH = "strftime(sale_date, '%Y-%m')"
DAY = "strftime(sale_date, '%Y-%m-%d')"
SUM = "cast(coalesce(sum(amount_cents), 0) AS BIGINT)"
ORDERS = "count(DISTINCT order_id)"


def two(x: str) -> str:
    """Two decimals through text, as the engine rounds."""
    return f"format('{{:.2f}}', {x})::DOUBLE"


def money(x: str) -> str:
    return f"'¥' || format('{{:,.2f}}', ({x}) / 100.0::DOUBLE)"


def signed(x: str) -> str:
    return f"(CASE WHEN ({x}) >= 0 THEN '+' ELSE '-' END || '¥' || format('{{:,.2f}}', abs({x}) / 100.0::DOUBLE))"


def percent(previous: str, current: str) -> str:
    return f"(CASE WHEN {previous} = 0 THEN 0.0 ELSE (({current})::DOUBLE - {previous}) / {previous} * 100 END)"


def evidence(metric: str, group_by: str = "[]", filters: str = "{}", date_from: str = "'null'", date_to: str = "'null'",
             grain: str = "day", limit: int = 100, run_id: int = 1, workspace: str = "star") -> str:
    """Hash of a metric query; the two dates are SQL texts, quoted or null."""
    return (
        f"substr(sha256('{{\"processing_run_id\": {run_id}, \"query\": {{\"date_from\": ' || {date_from} || "
        f"', \"date_grain\": \"{grain}\", \"date_to\": ' || {date_to} || "
        f"', \"filters\": {filters}, \"group_by\": {group_by}, \"limit\": {limit}, \"metric\": \"{metric}\"}}, "
        f"\"workspace\": \"{workspace}\"}}'), 1, 16)"
    )


AOV = two(f"sum(amount_cents) / {ORDERS}")
MONTHLY = f"""{STAR},
monthly AS (SELECT {MONTH} AS month, {SUM} AS revenue, {ORDERS} AS order_count, {AOV} AS average_order_value FROM star GROUP BY 1),
steps AS (
  SELECT *, lag(revenue) OVER (ORDER BY month) AS previous_revenue, lag(order_count) OVER (ORDER BY month) AS previous_order_count,
    lag(average_order_value) OVER (ORDER BY month) AS previous_average_order_value, lag(month) OVER (ORDER BY month) AS previous_month
  FROM monthly),
last_step AS (SELECT * FROM steps ORDER BY month DESC LIMIT 1),
daily AS (SELECT sale_date AS day, cast(sum(amount_cents) AS BIGINT) AS revenue FROM star GROUP BY 1),
based AS (
  SELECT day, cast(isodow(day) - 1 AS INTEGER) AS weekday, revenue,
    (SELECT median(revenue) FROM (SELECT revenue FROM daily e WHERE e.day < daily.day AND isodow(e.day) = isodow(daily.day)
                                  ORDER BY e.day DESC LIMIT 4)) AS baseline
  FROM daily),
latest AS (SELECT date_trunc('month', max(sale_date))::DATE AS first_day FROM star),
changes AS (
  SELECT product, cast(sum(amount_cents) FILTER (sale_date >= first_day) AS BIGINT) AS latest,
    cast(coalesce(sum(amount_cents) FILTER (sale_date < first_day), 0) AS BIGINT) AS previous
  FROM star, latest WHERE sale_date >= first_day - INTERVAL 1 MONTH GROUP BY 1
  HAVING count(*) FILTER (sale_date >= first_day) > 0)"""

_EV_MONTHLY = [evidence(x, '["date"]', grain="month") for x in ("revenue", "order_count", "average_order_value")]
PULSE = f"""
pulse AS (
  SELECT *, {percent('previous_revenue', 'revenue')} AS r, {percent('previous_order_count', 'order_count')} AS o,
    {percent('previous_average_order_value', 'average_order_value')} AS a FROM last_step WHERE previous_month IS NOT NULL),
f_pulse AS (
  SELECT 1 AS sequence, 'performance_pulse' AS kind, CASE WHEN r >= 0 THEN 'positive' ELSE 'watch' END AS tone,
    CASE WHEN abs(r) >= 10 THEN 'high' ELSE 'medium' END AS priority,
    month || ' 营业额' || CASE WHEN r >= 0 THEN '增长' ELSE '回落' END || ' ' || format('{{:.2f}}', abs(r)) || '%' AS title,
    '环比订单数' || CASE WHEN o >= 0 THEN '增长' ELSE '下降' END || format('{{:.2f}}', abs(o)) || '%，客单价'
      || CASE WHEN a >= 0 THEN '增长' ELSE '下降' END || format('{{:.2f}}', abs(a)) || '%；本期变化主要由'
      || CASE WHEN abs(o) >= abs(a) THEN '订单量' ELSE '客单价' END || '驱动。' AS narrative,
    CASE WHEN abs(o) >= abs(a) AND r >= 0 THEN '核对排班与备货是否能承接订单增长。' ELSE '检查高价值商品组合与价格策略。' END AS action,
    {signed('revenue - previous_revenue')} AS impact_display, 'revenue_trend' AS target, NULL::VARCHAR AS highlight,
    {" || ',' || ".join(_EV_MONTHLY)} AS evidence_ids FROM pulse),
f_driver AS (
  SELECT 2 AS sequence, 'growth_driver' AS kind, CASE WHEN latest >= previous THEN 'positive' ELSE 'watch' END AS tone, 'medium' AS priority,
    product || ' 是最大商品增量' AS title, '相比上月，' || product || '净营业额增加' || {signed('latest - previous')} || '。' AS narrative,
    '检查' || product || '的库存、备货和门店供应能力。' AS action, {signed('latest - previous')} AS impact_display,
    'product_ranking' AS target, product AS highlight,
    {evidence("revenue", '["product"]', date_from="'\"' || (first_day - INTERVAL 1 MONTH)::DATE || '\"'", date_to="'\"' || (first_day - 1)::DATE || '\"'")}
    || ',' || {evidence("revenue", '["product"]', date_from="'\"' || first_day || '\"'", date_to="'\"' || last_day(first_day) || '\"'")} AS evidence_ids
  FROM changes, latest ORDER BY latest - previous DESC, product LIMIT 1),
signal AS (
  SELECT *, revenue - baseline AS delta, {percent('baseline', 'revenue')} AS p, month(day) || '月' || day(day) || '日' AS shown
  FROM based WHERE baseline IS NOT NULL AND (SELECT count(*) FROM daily) >= 8 AND day = (SELECT max(day) FROM daily)),
f_daily AS (
  SELECT 0 AS sequence, 'daily_signal' AS kind, CASE WHEN p <= -15 THEN 'watch' WHEN p >= 15 THEN 'positive' ELSE 'neutral' END AS tone,
    CASE WHEN abs(p) >= 25 THEN 'high' WHEN abs(p) >= 15 THEN 'medium' ELSE 'low' END AS priority,
    shown || CASE WHEN p <= -15 THEN '营业额低于同星期基线' WHEN p >= 15 THEN '营业额高于同星期基线' ELSE '经营处于正常区间' END AS title,
    '当日净营业额' || {money('revenue')} || '，相比最近4个同星期日中位数' || CASE WHEN delta >= 0 THEN '高' ELSE '低' END
      || format('{{:.2f}}', abs(p)) || '%。' AS narrative,
    CASE WHEN p <= -15 THEN '优先检查当日门店营业状态、缺货和异常退款。' WHEN p >= 15 THEN '确认增长来源，并为下一同星期日准备排班与库存。'
         ELSE '维持当前排班与备货，继续观察下一营业日。' END AS action,
    {signed('delta')} AS impact_display, 'revenue_trend' AS target, NULL::VARCHAR AS highlight,
    {evidence("revenue", '["date"]', limit=500)} AS evidence_ids FROM signal),
findings AS (SELECT * FROM f_daily UNION ALL SELECT * FROM f_pulse UNION ALL SELECT * FROM f_driver),
feed AS (
  SELECT cast(row_number() OVER (ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, sequence) AS INTEGER) AS position,
    'star' AS workspace, (SELECT strftime(first_day, '%Y-%m') FROM latest) AS period, * FROM findings)"""
FINDINGS = f"{MONTHLY},{PULSE}"

RANGE = "sale_date BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'"
_DASH = """
parts AS (
  SELECT 'overall' AS part, '' AS label, amount_cents, order_id FROM scoped
  UNION ALL SELECT 'day', strftime(sale_date, '%Y-%m-%d'), amount_cents, NULL FROM scoped
  UNION ALL SELECT 'month', strftime(sale_date, '%Y-%m'), amount_cents, order_id FROM scoped
  UNION ALL SELECT 'product', product, amount_cents, NULL FROM scoped
  UNION ALL SELECT 'store_category', store_category, amount_cents, NULL FROM scoped
  UNION ALL SELECT 'store', store, amount_cents, order_id FROM scoped)
SELECT part, label, cast(sum(amount_cents) AS BIGINT) AS revenue, nullif(count(DISTINCT order_id), 0) AS order_count,
  CASE WHEN count(DISTINCT order_id) > 0 THEN format('{:.2f}', sum(amount_cents) / count(DISTINCT order_id))::DOUBLE END AS average_order_value
FROM parts GROUP BY 1, 2"""
_TOP = "row_number() OVER (ORDER BY value DESC, {key})"


def _group(value: str, *groups: str, where: str = "TRUE", limit: int | None = None) -> str:
    """A metric query: groups are 'expression AS name'."""
    keys = ", ".join(str(i + 1) for i in range(len(groups)))
    head = ", ".join(groups) + ", " if groups else ""
    tail = f"GROUP BY {keys}" if groups else ""
    if limit is not None:
        tail += f" ORDER BY {keys} LIMIT {limit}"
    return f"{STAR} SELECT {head}{value} AS value FROM star WHERE {where} {tail}"


def _top(value: str, key: str, n: int, where: str = "TRUE") -> str:
    return f"""{STAR}, g AS (SELECT {key}, {value} AS value FROM star WHERE {where} GROUP BY 1)
      SELECT {key}, value, cast(row_number() OVER (ORDER BY value DESC, {key}) AS INTEGER) AS position FROM g ORDER BY value DESC, {key} LIMIT {n}"""


_QSCOPE = """CASE WHEN date_from IS NOT NULL OR date_to IS NOT NULL THEN
    'date=' || coalesce(cast(date_from AS VARCHAR), '*') || '..' || coalesce(cast(date_to AS VARCHAR), '*') END"""
_QFILTERS = """CASE WHEN query_id % 3 = 0 THEN '"store": ["' || store_filter[1] || '", "\\u4e00\\u53f7\\u5e97"]'
    WHEN query_id % 3 = 1 THEN '"product": ["a\\"b", "\\u725b\\u8089"], "store": ["' || store_filter[1] || '"]' ELSE '' END"""
_UNKNOWN = (
    "list_sort([x FOR x IN list_distinct(group_by) "
    "IF x NOT IN ('date', 'store', 'store_key', 'store_category', 'product', 'product_category')])"
)
_DAYS = "(SELECT DISTINCT cast(o_orderdate AS DATE) AS day FROM orders)"

ORACLES = {
    "q_n9_date_grain": f"{STAR} SELECT DISTINCT sale_date, {DAY} AS day, {MONTH} AS month FROM star",
    "q_n10_dimension_text": _group("cast(sum(quantity) AS BIGINT)", "cast(store_id AS VARCHAR) AS store_key"),
    "q_n11_ratio": _group(AOV, "product"),
    "q_n12_percent_change": f"{MONTHLY} SELECT month, round({percent('previous_revenue', 'revenue')}, 6) AS change FROM steps",
    "q_n13_money_text": f"""{STAR} SELECT product, {DAY} AS date, {money('sum(amount_cents)')} AS display FROM star
        GROUP BY 1, 2""",
    "q_n14_signed_money": f"{MONTHLY} SELECT month, {signed('revenue - previous_revenue')} AS display FROM steps",
    "q_n15_direction": f"""{MONTHLY} SELECT month, CASE WHEN revenue >= previous_revenue THEN '增长' ELSE '下降' END AS direction
        FROM steps WHERE previous_revenue IS NOT NULL""",
    "q_n16_month_bounds": f"""SELECT DISTINCT cast(year(day) AS INTEGER) AS year, cast(month(day) AS INTEGER) AS month,
        date_trunc('month', day)::DATE AS first_day, last_day(day) AS last_day FROM {_DAYS}""",
    "q_n17_previous_month": f"""SELECT DISTINCT date_trunc('month', day)::DATE AS month,
        (date_trunc('month', day) - INTERVAL 1 MONTH)::DATE AS previous_month FROM {_DAYS}""",
    "q_n18_weekday": f"SELECT day, cast(isodow(day) - 1 AS INTEGER) AS weekday FROM {_DAYS}",
    "q_n19_date_text": f"SELECT day, year(day) || '年' || month(day) || '月' || day(day) || '日' AS display FROM {_DAYS}",
    "q_n20_scope": f"""WITH {QUERY_LOG_SQL}
        SELECT query_id, coalesce(nullif(concat_ws('; ', {_QSCOPE},
          CASE WHEN len(product_filter) > 0 THEN 'product=' || array_to_string(product_filter, ',') END,
          CASE WHEN len(store_filter) > 0 THEN 'store=' || array_to_string(store_filter, ',') END,
          CASE WHEN len(group_by) > 0 THEN 'group_by=' || array_to_string(group_by, ',') END), ''), 'all accepted records') AS scope
        FROM qlog""",
    "q_n21_evidence": f"""WITH {QUERY_LOG_SQL}
        SELECT query_id, substr(sha256('{{"processing_run_id": 7, "query": {{"date_from": ' || coalesce('"' || date_from || '"', 'null')
          || ', "date_grain": "' || grain || '", "date_to": ' || coalesce('"' || date_to || '"', 'null')
          || ', "filters": {{' || {_QFILTERS} || '}}, "group_by": ['
          || CASE WHEN len(group_by) > 0 THEN '"' || array_to_string(group_by, '", "') || '"' ELSE '' END
          || '], "limit": ' || lim || ', "metric": "' || metric || '"}}, "workspace": "star"}}'), 1, 16) AS evidence_id FROM qlog""",
    "q_n24_share": f"""{STAR}, g AS (SELECT product, sum(amount_cents) AS value FROM star GROUP BY 1)
        SELECT product, round(value::DOUBLE / (SELECT max(value) FROM g)::DOUBLE * 100, 6) AS share FROM g""",
    "q_n25_units": f"{STAR} SELECT sale_date AS day, sum(amount_cents)::BIGINT / 100.0::DOUBLE AS revenue FROM star GROUP BY 1",
    "q_f1_date_range": _group(SUM, f"{DAY} AS date", where=RANGE),
    "q_f2_in_filter": _group(
        ORDERS, "store_category", limit=100,
        where="store IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000007') AND product_category IN ('ECONOMY', 'PROMO')",
    ),
    "q_f3_date_values": _group(SUM, f"{MONTH} AS date", where=f"{MONTH} IN ('1997-02', '1998-11', '1998-13', 'nothing')", limit=100),
    "q_f4_refusals": f"""WITH {QUERY_LOG_SQL}
        SELECT query_id, CASE WHEN metric = 'profit' THEN 'unknown_metric' WHEN len({_UNKNOWN}) > 0 THEN 'unknown_dimension'
          WHEN len(group_by) > 2 THEN 'too_many_dimensions' WHEN len(list_distinct(group_by)) < len(group_by) THEN 'repeated_dimension'
          WHEN lim > 500 THEN 'limit_out_of_range' WHEN date_from > date_to THEN 'dates_out_of_order' END AS refusal FROM qlog""",
    "q_j1_store_join": _group(SUM, "store"),
    "q_j2_product_join": _group(SUM, "product_category", "store_category"),
    "q_j5_product_changes": f"{MONTHLY} SELECT product, latest, previous, latest - previous AS change FROM changes",
    "q_j6_store_metrics": f"""{STAR} SELECT store, {SUM} AS revenue, {ORDERS} AS order_count, {AOV} AS average_order_value
        FROM star WHERE {RANGE} GROUP BY 1""",
    "q_j8_product_periods": f"""{STAR} SELECT product AS name, 0 AS period, {SUM} AS value FROM star GROUP BY 1
        UNION ALL SELECT product, cast(month(sale_date) AS INTEGER), {SUM} FROM star
        WHERE year(sale_date) = (SELECT year(max(sale_date)) FROM star) GROUP BY 1, 2""",
    "q_a1_sum": _group(SUM, where="sale_date >= DATE '1997-03-01'"),
    "q_a2_count_distinct": _group(ORDERS, "store"),
    "q_a3_ratio": _group(AOV, "store_category", "product_category"),
    "q_a4_grouped": _group(SUM, f"{MONTH} AS date", "store_category"),
    "q_a5_coverage": f"{STAR} SELECT min(sale_date) AS first_day, max(sale_date) AS last_day FROM star",
    "q_a9_median": f"{MONTHLY} SELECT day, baseline FROM based",
    "q_a10_top_store": _top(SUM, "store", 1),
    "q_a12_dashboard": f"{STAR}, scoped AS (SELECT * FROM star),{_DASH}",
    "q_a12_filtered_dashboard": f"{STAR}, scoped AS (SELECT * FROM star WHERE product_category = 'ECONOMY' AND {RANGE}),{_DASH}",
    "q_a13_evidence_list": f"{FINDINGS} SELECT string_agg(evidence_ids, ',' ORDER BY position) AS evidence_ids FROM feed",
    "q_w3_last_two_months": f"{MONTHLY} SELECT * FROM last_step WHERE previous_month IS NOT NULL",
    "q_w4_weekday_baseline": f"{MONTHLY} SELECT * FROM based",
    "q_w5_ranked_products": _top(SUM, "product", 10, RANGE),
    "q_t1_ordered": _group(SUM, "product", "store", limit=250),
    "q_t2_limited_days": _group(SUM, f"{DAY} AS date", limit=100),
    "q_t3_top_products": _top(SUM, "product", 10),
    "q_t4_priorities": f"{FINDINGS} SELECT position, kind, priority FROM feed",
    "q_u2_findings": f"{FINDINGS} SELECT kind, tone, title FROM findings",
    "q_u3_unknown_dimensions": f"WITH {QUERY_LOG_SQL} SELECT query_id, array_to_string({_UNKNOWN}, ',') AS unknown_dimensions FROM qlog",
    "q_x1_filter_pairs": f"""WITH {QUERY_LOG_SQL} SELECT query_id, 'store' AS dimension, unnest(store_filter) AS value FROM qlog
        UNION ALL SELECT query_id, 'product', unnest(product_filter) FROM qlog""",
    "q_m1_metric_query": f"""{STAR}, g AS (SELECT {MONTH} AS date, store, {AOV} AS value FROM star
          WHERE store_category IN ('ASIA', 'EUROPE') AND product_category = 'PROMO' AND {RANGE} GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 300)
        SELECT *, (SELECT count(*) FROM g) AS row_count, 'date=1997-03-01..1998-02-28; product_category=PROMO; store_category=ASIA,EUROPE; group_by=date,store' AS scope,
          {evidence("average_order_value", '["date", "store"]', '{"product_category": ["PROMO"], "store_category": ["ASIA", "EUROPE"]}',
                    "'\"1997-03-01\"'", "'\"1998-02-28\"'", "month", 300)} AS evidence_id FROM g""",
    "q_m2_monthly_metrics": f"{MONTHLY} SELECT * FROM monthly",
    "q_m3_category_contribution": f"""{STAR}, g AS (SELECT store_category, {SUM} AS revenue FROM star GROUP BY 1)
        SELECT *, round(revenue::DOUBLE / (SELECT max(revenue) FROM g)::DOUBLE * 100, 6) AS share FROM g""",
    "q_m4_store_comparison": f"""{STAR}, g AS (SELECT store, {SUM} AS revenue, {ORDERS} AS order_count, {AOV} AS average_order_value FROM star GROUP BY 1)
        SELECT *, round(revenue::DOUBLE / (SELECT max(revenue) FROM g)::DOUBLE * 100, 6) AS share FROM g""",
    "q_m5_kpi_row": f"""{CLEANED},{STAR_SQL}
        SELECT {SUM} AS revenue, {ORDERS} AS order_count, {AOV} AS average_order_value,
          (SELECT {two('accepted_sales_records / raw_sales_records * 100')} FROM summary) AS acceptance_rate,
          (SELECT accepted_sales_records FROM summary) AS accepted_sales_records FROM star""",
    "q_i1_performance_pulse": f"{FINDINGS} SELECT * EXCLUDE (sequence) FROM f_pulse",
    "q_i2_growth_driver": f"{FINDINGS} SELECT * EXCLUDE (sequence) FROM f_driver",
    "q_i3_daily_signal": f"{FINDINGS} SELECT * EXCLUDE (sequence) FROM f_daily",
    "q_i4_insight_feed": f"{FINDINGS} SELECT position, workspace, period, kind, title FROM feed",
    "q_e2_workspace_of_clean_tables": f"""{RENUMBERED}
        SELECT category AS store_category, product_name AS product, {AOV} AS value
        FROM accepted JOIN stores USING (store_id) JOIN products USING (product_id) GROUP BY 1, 2""",
    "q_e3_nested_ratio": _group(two(f"{AOV} / {two('sum(amount_cents) / sum(quantity)')}"), "store"),
    "q_join_without_dimension": f"""{STAR} SELECT (SELECT sum(amount_cents)::BIGINT FROM star) AS joined, sum(amount_cents)::BIGINT AS unjoined FROM sale""",
}
