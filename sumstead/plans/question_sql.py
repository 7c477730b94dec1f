"""Question reading, linking, conversations and answers once more, as SQL."""

from functools import reduce

from sumstead import fixed_values as fx
from sumstead.operators.questions import MONTH_ORDER
from sumstead.plans.analytics_sql import AOV, MONTH, SUM, evidence, money, percent
from sumstead.plans.views import QUESTION_SQL, STAR_SQL


def _any(words: tuple[str, ...], text: str = "plain") -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _in_order(words: tuple[str, ...]) -> str:
    return "".join(f"(?:{w})?" for w in words)


_MONTHS = "CASE " + " ".join(f"WHEN contains(plain, '{w}') THEN {fx.MONTH_WORDS[w]}" for w in MONTH_ORDER) + " END"
_OUT = _any(fx.OUT_OF_SCOPE_WORDS)
_PREFIX = f"'^{_in_order(fx.QUESTION_PREFIXES)}'"
_MONTH_PHRASE = fx.MONTH_PHRASE_LEAD + "(?:" + "|".join(MONTH_ORDER) + ")" + fx.MONTH_PHRASE_TAIL
_REVENUE = reduce(
    lambda t, phrase: f"replace({t}, '{phrase}', '')", fx.REVENUE_PHRASES,
    f"regexp_replace(regexp_replace(trim(plain, '{fx.QUESTION_EDGE_MARKS}'), {_PREFIX}, ''), '{_MONTH_PHRASE}', '')",
)
_REVENUE = f"regexp_replace(trim({_REVENUE}, '{fx.PRODUCT_EDGE_MARKS}'), '^{fx.PRODUCT_LEAD_WORD}', '')"
_SUFFIXES = _in_order(tuple(s[::-1] for s in (*fx.SUMMARY_SUFFIXES, fx.SUMMARY_LAST_SUFFIX)))
_SUMMARY = f"reverse(regexp_replace(reverse(regexp_replace(plain, {_PREFIX}, '')), '^{_SUFFIXES}', ''))"


def read(source: str) -> str:
    return f"""
plained AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS plain FROM {source}),
ruled AS (
  SELECT *, {_MONTHS} AS month, length(plain) <= {fx.FOLLOW_UP_MAX_CHARS} OR {_any(fx.FOLLOW_UP_WORDS)} AS follow_up,
    CASE WHEN contains(plain, '{fx.AOV_WORD}') AND {_any(fx.AOV_TREND_WORDS)} THEN 'aov_trend'
         WHEN contains(plain, '{fx.CATEGORY_WORD}') AND {_any(fx.CATEGORY_LEADER_WORDS)} THEN 'category_leader'
         WHEN contains(plain, '{fx.STORE_WORD}') AND {_any(fx.STORE_COMPARISON_WORDS)} THEN 'store_comparison'
         WHEN {_any(fx.RANKING_SCOPE_WORDS)} AND {_any(fx.RANKING_ORDER_WORDS)} AND {_any(fx.RANKING_REVENUE_WORDS)} THEN 'product_ranking'
         WHEN {_OUT} THEN NULL
         WHEN {_any(fx.REVENUE_QUESTION_WORDS)} THEN 'product_revenue'
         WHEN {_any(fx.SUMMARY_QUESTION_WORDS)} THEN 'product_summary' END AS rule
  FROM plained),
phrased AS (
  SELECT *, nullif(CASE rule WHEN 'product_revenue' THEN {_REVENUE} WHEN 'product_summary' THEN {_SUMMARY} END, '') AS phrase
  FROM ruled),
readings AS (
  SELECT *, CASE WHEN rule = 'product_summary' THEN CASE WHEN phrase IS NOT NULL THEN 'product_revenue' END ELSE rule END AS intent,
    CASE WHEN rule NOT IN ('product_summary', 'aov_trend') THEN month END AS own_month FROM phrased)"""


READ = f"WITH {QUESTION_SQL},{read('questions')}"


def _key(text: str) -> str:
    return f"lower(regexp_replace({text}, '[^\\p{{L}}\\p{{N}}]+', '', 'g'))"


LINK = f"""
catalog AS (SELECT DISTINCT product, {_key('product')} AS product_key FROM star),
starts AS (SELECT *, unnest(range(1, length(product_key))) AS i FROM catalog WHERE length(product_key) >= 2),
grams AS (SELECT product, product_key, i, unnest(range(2, length(product_key) - i + 2)) AS n FROM starts),
aliases AS (
  SELECT substr(product_key, i, n) AS alias, min(product) AS product FROM grams GROUP BY 1 HAVING count(DISTINCT product) = 1),
whole AS (SELECT product_key AS alias, min(product) AS product FROM catalog GROUP BY 1 HAVING count(*) = 1),
by_phrase AS (SELECT * FROM whole UNION SELECT * FROM aliases),
texts AS (SELECT DISTINCT {_key('text')} AS text_key FROM readings),
matches AS (
  SELECT text_key, count(DISTINCT product) AS n, min(product) AS product FROM texts JOIN aliases ON contains(text_key, alias) GROUP BY 1),
linked AS (
  SELECT r.*, coalesce(m.n, 0) AS match_count, CASE WHEN m.n = 1 THEN m.product END AS matched,
    CASE WHEN m.n = 1 THEN m.product WHEN m.n IS NULL THEN p.product END AS own_product
  FROM readings r LEFT JOIN matches m ON m.text_key = {_key('r.text')} LEFT JOIN by_phrase p ON p.alias = {_key('r.phrase')})"""

LINKED = f"WITH {STAR_SQL},{QUESTION_SQL},{read('questions')},{LINK}"

_CAL = f"""
cal AS (SELECT min(sale_date) AS first_day, max(sale_date) AS last_day, year(max(sale_date)) AS y, count(DISTINCT {MONTH}) AS months FROM star),
months AS (
  SELECT m AS month, make_date(y, m, 1) AS date_from, last_day(make_date(y, m, 1)) AS date_to,
    last_day(make_date(y, m, 1)) < first_day OR make_date(y, m, 1) > last_day AS outside,
    EXISTS (SELECT 1 FROM star WHERE year(sale_date) = y AND month(sale_date) = m) AS sold
  FROM cal, (SELECT unnest(range(1, 13)) AS m))"""


def _turn(n: int) -> str:
    """Turn n from the context that turn n - 1 left."""
    before = (
        f"SELECT l.*, b.intent AS b_intent, b.product AS b_product FROM linked l LEFT JOIN after{n - 1} b ON b.conv_id = l.conv_id AND b.kept WHERE l.turn = {n}"
        if n > 1 else "SELECT *, NULL::VARCHAR AS b_intent, NULL::VARCHAR AS b_product FROM linked WHERE turn = 1"
    )
    return f"""
before{n} AS ({before}),
picked{n} AS (
  SELECT conv_id, turn, text, b_intent IS NOT NULL AND follow_up AND month IS NOT NULL AS inherits,
    CASE WHEN b_intent IS NOT NULL AND follow_up AND month IS NOT NULL THEN b_intent ELSE intent END AS intent,
    CASE WHEN b_intent IS NOT NULL AND follow_up AND month IS NOT NULL
         THEN CASE WHEN b_intent = 'product_revenue' THEN CASE match_count WHEN 1 THEN matched WHEN 0 THEN b_product END END
         WHEN intent = 'product_revenue' THEN own_product END AS product,
    CASE WHEN b_intent IS NOT NULL AND follow_up AND month IS NOT NULL THEN month ELSE own_month END AS month
  FROM before{n}),
after{n} AS (
  SELECT p.*, date_from, date_to, coalesce(outside, FALSE) AS outside,
    CASE WHEN intent IS NULL THEN FALSE
         WHEN intent = 'product_revenue' THEN product IS NOT NULL
         WHEN intent = 'aov_trend' THEN coalesce(outside, FALSE) OR (SELECT months >= 2 FROM cal)
         WHEN intent = 'store_comparison' THEN coalesce(outside OR sold, TRUE) ELSE TRUE END AS kept
  FROM picked{n} p LEFT JOIN months USING (month))"""


RESOLVED = f"""{LINKED},{_CAL},{_turn(1)},{_turn(2)},{_turn(3)},
resolved AS (SELECT * FROM after1 UNION ALL SELECT * FROM after2 UNION ALL SELECT * FROM after3)"""

_SHOW = "year({0}) || '年' || month({0}) || '月' || day({0}) || '日'"
_COVERED = f"(SELECT '当前可信数据仅覆盖' || {_SHOW.format('first_day')} || '至' || {_SHOW.format('last_day')} || '，无法回答' FROM cal)"
_IN_RANGE = "CASE WHEN r.month IS NULL THEN '当前可信范围内' ELSE r.month || '月' END"
_IN_RECORDS = "CASE WHEN r.month IS NULL THEN '全部可信记录' ELSE r.month || '月' END"
_DATES = {
    "date_from": "coalesce('\"' || date_from || '\"', 'null')", "date_to": "coalesce('\"' || date_to || '\"', 'null')",
}
_DATED = "CASE WHEN date_from IS NOT NULL THEN 'date=' || date_from || '..' || date_to END"

ANSWERED = f"""{RESOLVED},
periods AS (
  SELECT *, 0 AS period FROM star UNION ALL SELECT *, month(sale_date) FROM star WHERE year(sale_date) = (SELECT y FROM cal)),
cats AS (SELECT period, store_category AS name, {SUM} AS value FROM periods GROUP BY 1, 2
         QUALIFY row_number() OVER (PARTITION BY period ORDER BY value DESC, name) = 1),
prods AS (SELECT period, product AS name, {SUM} AS value FROM periods GROUP BY 1, 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY value DESC, name) AS position FROM prods),
ranks AS (
  SELECT period, string_agg(name, '、' ORDER BY position) AS names, min(name) FILTER (position = 1) AS name, max(value) AS value
  FROM ranked WHERE position <= 10 GROUP BY 1),
shops AS (SELECT period, store AS name, {SUM} AS value, {AOV} AS aov FROM periods GROUP BY 1, 2),
leads AS (
  SELECT *, count(*) OVER (PARTITION BY period) AS stores FROM shops
  QUALIFY row_number() OVER (PARTITION BY period ORDER BY value DESC, name) = 1),
monthly AS (SELECT {MONTH} AS m, {AOV} AS aov FROM star GROUP BY 1),
trend AS (SELECT m, aov, lag(m) OVER (ORDER BY m) AS pm, lag(aov) OVER (ORDER BY m) AS paov FROM monthly ORDER BY m DESC LIMIT 1),
answers AS (
  SELECT r.conv_id, r.turn, r.intent, r.product, r.month, r.date_from, r.date_to, coalesce(prods.value, 0) AS product_value,
    cats.name AS c_name, cats.value AS c_value, ranks.name AS r_name, ranks.value AS r_value,
    leads.name AS s_name, leads.value AS s_value, leads.aov AS s_aov, t.*,
    CASE WHEN r.intent IS NULL THEN 'no_intent'
         WHEN r.intent = 'product_revenue' AND r.product IS NULL THEN 'no_unique_product'
         WHEN r.intent = 'product_revenue' AND outside THEN 'product_outside'
         WHEN outside THEN 'outside'
         WHEN r.intent = 'category_leader' AND cats.name IS NULL THEN 'no_category'
         WHEN r.intent = 'product_ranking' AND ranks.name IS NULL THEN 'no_ranking'
         WHEN r.intent = 'aov_trend' AND coalesce(t.paov, 0) = 0 THEN 'no_trend'
         WHEN r.intent = 'store_comparison' AND leads.name IS NULL THEN 'no_stores' END AS reason,
    CASE reason
      WHEN 'no_intent' THEN '{fx.ANSWER_NO_INTENT}' WHEN 'no_unique_product' THEN '{fx.ANSWER_NO_UNIQUE_PRODUCT}'
      WHEN 'product_outside' THEN '已识别商品“' || r.product || '”，但' || {_COVERED} || r.month || '月的数据。'
      WHEN 'outside' THEN {_COVERED} || r.month || '月的数据。'
      WHEN 'no_category' THEN '{fx.ANSWER_NO_CATEGORY}' WHEN 'no_ranking' THEN '{fx.ANSWER_NO_RANKING}'
      WHEN 'no_trend' THEN '{fx.ANSWER_NO_TREND}' WHEN 'no_stores' THEN '{fx.ANSWER_NO_STORES}'
      ELSE CASE r.intent
        WHEN 'category_leader' THEN {_IN_RANGE} || '营业额最高的门店品类是' || cats.name || '，净营业额为' || {money('cats.value')} || '。'
        WHEN 'product_ranking' THEN {_IN_RECORDS} || '的营业额前10商品依次是：' || ranks.names || '。精确金额已定位到商品排名表。'
        WHEN 'store_comparison' THEN {_IN_RANGE} || '共有' || leads.stores || '家门店。净营业额最高的是' || leads.name || '，为' || {money('leads.value')}
          || '，客单价为' || {money('leads.aov')} || '；完整差异已定位到门店对比视图。'
        WHEN 'aov_trend' THEN '客单价最近' || CASE WHEN t.aov > t.paov THEN '回升' ELSE '下降' END || '：从' || t.pm || '的' || {money('t.paov')}
          || '变为' || t.m || '的' || {money('t.aov')} || '，变动' || format('{{:.2f}}', abs({percent('t.paov', 't.aov')})) || '%。'
        ELSE CASE WHEN r.month IS NULL AND coalesce(prods.value, 0) = 0 THEN '在全部可信记录中，没有找到' || r.product || '的营业额。'
          WHEN r.month IS NULL THEN r.product || '在全部可信记录中的净营业额是' || {money('prods.value')} || '。'
          WHEN coalesce(prods.value, 0) = 0 THEN '在已接受记录中，没有找到' || r.product || '在' || r.month || '月的营业额。'
          ELSE r.product || '在' || r.month || '月的净营业额是' || {money('prods.value')} || '。' END END END AS answer
  FROM resolved r
  LEFT JOIN cats ON cats.period = coalesce(r.month, 0) LEFT JOIN ranks ON ranks.period = coalesce(r.month, 0)
  LEFT JOIN leads ON leads.period = coalesce(r.month, 0)
  LEFT JOIN prods ON prods.period = coalesce(r.month, 0) AND prods.name = r.product
  LEFT JOIN trend t ON TRUE),
cited AS (
  SELECT conv_id, turn, 0 AS number, {evidence('revenue', '["store_category"]', **_DATES)} AS evidence_id, 'revenue' AS metric,
    c_value::DOUBLE AS value, c_name AS dimension_value, concat_ws('; ', {_DATED}, 'group_by=store_category') AS scope
  FROM answers WHERE reason IS NULL AND intent = 'category_leader'
  UNION ALL SELECT conv_id, turn, 0, {evidence('revenue', '["product"]', limit=500, **_DATES)}, 'revenue', r_value, r_name,
    concat_ws('; ', {_DATED}, 'group_by=product') FROM answers WHERE reason IS NULL AND intent = 'product_ranking'
  UNION ALL SELECT conv_id, turn, 0, {evidence('revenue', '["store"]', **_DATES)}, 'revenue', s_value, s_name,
    concat_ws('; ', {_DATED}, 'group_by=store') FROM answers WHERE reason IS NULL AND intent = 'store_comparison'
  UNION ALL SELECT conv_id, turn, 1, {evidence('average_order_value', '["store"]', **_DATES)}, 'average_order_value', s_aov, s_name,
    concat_ws('; ', {_DATED}, 'group_by=store') FROM answers WHERE reason IS NULL AND intent = 'store_comparison'
  UNION ALL SELECT conv_id, turn, 0, {evidence('average_order_value', '["date"]', grain='month')}, 'average_order_value', paov, pm, 'group_by=date'
  FROM answers WHERE reason IS NULL AND intent = 'aov_trend'
  UNION ALL SELECT conv_id, turn, 1, {evidence('average_order_value', '["date"]', grain='month')}, 'average_order_value', aov, m, 'group_by=date'
  FROM answers WHERE reason IS NULL AND intent = 'aov_trend'
  UNION ALL SELECT conv_id, turn, 0,
    {evidence('revenue', filters=chr(123) + '"product": ["' + "' || product || '" + '"]' + chr(125), **_DATES)},
    'revenue', product_value, '', concat_ws('; ', {_DATED}, 'product=' || product)
  FROM answers WHERE reason IS NULL AND intent = 'product_revenue')"""


def _intent(name: str) -> str:
    return (
        f"{ANSWERED} SELECT conv_id, turn, CASE WHEN reason IS NULL THEN 'answered' ELSE 'unsupported' END AS status, "
        f"reason, month, answer FROM answers WHERE intent = '{name}'"
    )


_FORGETS = "reason IN ('no_intent', 'no_unique_product', 'no_trend', 'no_stores')"

ORACLES = {
    "q_l1_plain_questions": f"{READ} SELECT conv_id, turn, plain FROM readings",
    "q_l2_months": f"{READ} SELECT conv_id, turn, month FROM readings",
    "q_l3_intents": f"{READ} SELECT conv_id, turn, intent, follow_up, own_month FROM readings",
    "q_l3_prose_has_no_intent": f"WITH {read('conversations')} SELECT conv_id, turn, intent, month FROM readings",
    "q_l4_phrases": f"{READ} SELECT conv_id, turn, phrase FROM readings",
    "q_l5_aliases": f"{LINKED} SELECT alias, product FROM aliases",
    "q_a11_alias_owners": f"""{LINKED} SELECT alias, product FROM aliases a WHERE NOT EXISTS (
        SELECT 1 FROM aliases b WHERE b.alias <> a.alias AND contains(a.alias, b.alias))""",
    "q_j7_question_aliases": f"{LINKED} SELECT conv_id, turn, match_count, matched FROM linked",
    "q_l6_linked_products": f"{LINKED} SELECT conv_id, turn, own_product FROM linked",
    "q_l7_contexts": f"{RESOLVED} SELECT conv_id, turn, intent, product, month FROM resolved",
    "q_w6_carried_contexts": f"""{ANSWERED} SELECT conv_id, turn, CASE WHEN NOT coalesce({_FORGETS}, FALSE) THEN intent END AS intent,
        CASE WHEN NOT coalesce({_FORGETS}, FALSE) THEN product END AS product,
        CASE WHEN NOT coalesce({_FORGETS}, FALSE) THEN date_from END AS date_from FROM answers""",
    "q_l8_month_ranges": f"{RESOLVED} SELECT conv_id, turn, date_from, date_to FROM resolved",
    "q_l9_category_answers": _intent("category_leader"),
    "q_l10_product_answers": _intent("product_revenue"),
    "q_l11_ranking_answers": _intent("product_ranking"),
    "q_l12_trend_answers": _intent("aov_trend"),
    "q_l13_store_answers": _intent("store_comparison"),
    "q_l14_refusals": f"""{ANSWERED} SELECT conv_id, turn, reason, answer, 0 AS n_citations, NOT {_FORGETS} AS keeps_context
        FROM answers WHERE reason IS NOT NULL""",
    "q_l15_citations": f"""{ANSWERED} SELECT conv_id, turn, number, evidence_id, 1 AS processing_run_id, metric,
        CASE metric WHEN 'revenue' THEN '营业额' ELSE '客单价' END AS label, value, {money('value')} AS display_value, dimension_value, scope
        FROM cited""",
    "q_f6_coverage_gate": f"{ANSWERED} SELECT conv_id, turn, reason, answer FROM answers WHERE reason IN ('outside', 'product_outside')",
    "q_f7_out_of_scope": f"""WITH {QUESTION_SQL}, texts AS (SELECT conv_id, turn, text FROM questions UNION ALL SELECT conv_id, turn, text FROM conversations)
        SELECT * FROM texts WHERE {_any(fx.OUT_OF_SCOPE_WORDS, "lower(regexp_replace(text, '\\s+', '', 'g'))")}""",
    "q_j9_reconciled_answers": f"""{ANSWERED}, given AS (SELECT * FROM answers WHERE reason IS NULL)
        SELECT 'product' AS kind, count(*) AS answers, count(DISTINCT (product, coalesce(month, 0))) AS cells, cast(0 AS BIGINT) AS mismatches
        FROM given WHERE intent = 'product_revenue' HAVING count(*) > 0
        UNION ALL
        SELECT 'category', count(*), count(DISTINCT coalesce(month, 0)), 0 FROM given WHERE intent = 'category_leader' HAVING count(*) > 0
        UNION ALL
        SELECT 'trend', 2 * count(*), 2, 0 FROM given WHERE intent = 'aov_trend' HAVING count(*) > 0
        UNION ALL
        SELECT 'ranking', count(*), count(DISTINCT coalesce(month, 0)), 0 FROM given WHERE intent = 'product_ranking' HAVING count(*) > 0
        UNION ALL
        SELECT 'store', count(*), count(DISTINCT coalesce(month, 0)), 0 FROM given WHERE intent = 'store_comparison' HAVING count(*) > 0
        UNION ALL
        SELECT 'store_aov', count(*), count(DISTINCT (s_name, coalesce(month, 0))), 0 FROM given WHERE intent = 'store_comparison' HAVING count(*) > 0""",
}
