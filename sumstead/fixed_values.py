"""Word lists, formats and texts that decide the results.

They are given by the data contract and must not be changed; all logic that
uses them lives elsewhere.
"""

# Month words of a question and the month they name.
MONTH_WORDS = {
    "一月": 1, "1月": 1, "二月": 2, "2月": 2, "三月": 3, "3月": 3, "四月": 4, "4月": 4,
    "五月": 5, "5月": 5, "六月": 6, "6月": 6, "七月": 7, "7月": 7, "八月": 8, "8月": 8,
    "九月": 9, "9月": 9, "十月": 10, "10月": 10, "十一月": 11, "11月": 11, "十二月": 12, "12月": 12,
}

# Words that decide the intent of a question.
FOLLOW_UP_WORDS = ("那", "呢", "改成")
FOLLOW_UP_MAX_CHARS = 12
AOV_WORD = "客单价"
AOV_TREND_WORDS = ("趋势", "涨", "跌")
CATEGORY_WORD = "品类"
CATEGORY_LEADER_WORDS = ("最高", "最多", "第一")
STORE_WORD = "门店"
STORE_COMPARISON_WORDS = ("对比", "比较", "哪家", "排名", "差异")
RANKING_SCOPE_WORDS = ("商品", "产品")
RANKING_ORDER_WORDS = ("前10", "前十", "排名", "排行", "榜单", "最高", "最多", "最好")
RANKING_REVENUE_WORDS = ("营业额", "销售额", "卖得", "卖的")
OUT_OF_SCOPE_WORDS = ("天气", "预测", "影响", "利润", "成本", "未来", "下个月", "明年")
REVENUE_QUESTION_WORDS = ("卖了多少", "多少钱", "营业额", "销售额")
SUMMARY_QUESTION_WORDS = ("相关数据", "商品表现", "销售情况", "卖得怎么样")

# Parts of a question that are not the product's name, in order of removal.
QUESTION_EDGE_MARKS = "？?。！!"
QUESTION_PREFIXES = ("请问", "帮我看一下", "帮我看看", "看一下", "查一下")
MONTH_PHRASE_LEAD = r"(?:(?:今年|本年)|(?:20\d{2}年))?"
MONTH_PHRASE_TAIL = "(?:份)?"
REVENUE_PHRASES = (
    "的营业额是多少", "营业额是多少", "的营业额是", "营业额是",
    "的销售额是多少", "销售额是多少", "的销售额是", "销售额是",
    "卖了多少钱", "卖了多少", "多少钱",
    "的营业额", "营业额", "的销售额", "销售额",
)
PRODUCT_EDGE_MARKS = "，,：:；;的在于"
PRODUCT_LEAD_WORD = "那"
SUMMARY_SUFFIXES = (
    "相关数据", "的相关数据", "商品表现", "的商品表现", "销售情况", "的销售情况", "卖得怎么样",
)
SUMMARY_LAST_SUFFIX = "的"

# Texts of answers; {braces} are filled from query results.
ANSWER_NO_INTENT = (
    "这个问题超出了当前数据范围。我只能基于已治理的日期、门店、品类、"
    "商品、营业额、订单数和客单价回答；不会用常识补造数据。"
)
ANSWER_NO_DATA = "当前还没有已进入分析层的可信日期数据。"
ANSWER_OUT_OF_COVERAGE = "当前可信数据仅覆盖{first}至{last}，无法回答{month}月的数据。"
ANSWER_PRODUCT_OUT_OF_COVERAGE = (
    "已识别商品“{product}”，但当前可信数据仅覆盖{first}至{last}，无法回答{month}月的数据。"
)
ANSWER_NO_UNIQUE_PRODUCT = (
    "没有识别到唯一且已收录的商品。请只写一个可唯一识别的商品名称，"
    "我会用商品维表核对全名或唯一简称，不会猜测或混合多个商品。"
)
ANSWER_NO_CATEGORY = "当前筛选范围内没有可比较的可信门店品类数据。"
ANSWER_CATEGORY = "{period}营业额最高的门店品类是{name}，净营业额为{display}。"
ANSWER_PRODUCT_ALL_MISSING = "在全部可信记录中，没有找到{product}的营业额。"
ANSWER_PRODUCT_ALL = "{product}在全部可信记录中的净营业额是{display}。"
ANSWER_PRODUCT_MONTH_MISSING = "在已接受记录中，没有找到{product}在{month}月的营业额。"
ANSWER_PRODUCT_MONTH = "{product}在{month}月的净营业额是{display}。"
ANSWER_NO_RANKING = "当前筛选范围内没有可排名的可信商品营业额数据。"
ANSWER_RANKING = "{period}的营业额前10商品依次是：{names}。精确金额已定位到商品排名表。"
ANSWER_NO_TREND = "当前有效月份不足两个，无法判断客单价趋势。"
ANSWER_TREND = (
    "客单价最近{direction}：从{previous}的{previous_display}变为{latest}的{latest_display}，变动{delta}%。"
)
ANSWER_NO_STORES = "当前没有可比较的可信门店数据。"
ANSWER_STORES = (
    "{period}共有{stores}家门店。净营业额最高的是{name}，为{revenue}，客单价为{aov}；"
    "完整差异已定位到门店对比视图。"
)
PERIOD_MONTH = "{month}月"
PERIOD_ALL_RANGE = "当前可信范围内"
PERIOD_ALL_RECORDS = "全部可信记录"
TREND_UP = "回升"
TREND_DOWN = "下降"
NAME_SEPARATOR = "、"
DATE_DISPLAY = "{year}年{month}月{day}日"

# Texts and thresholds of findings.
WORD_GROWTH = "增长"
WORD_DECLINE = "下降"
WORD_FALL_BACK = "回落"
WORD_HIGH = "高"
WORD_LOW = "低"
DRIVER_ORDERS = "订单量"
DRIVER_AOV = "客单价"
PULSE_TITLE = "{period} 营业额{direction} {change}%"
PULSE_NARRATIVE = (
    "环比订单数{orders_direction}{orders_change}%，客单价{aov_direction}{aov_change}%；"
    "本期变化主要由{driver}驱动。"
)
PULSE_ACTION_ORDERS_UP = "核对排班与备货是否能承接订单增长。"
PULSE_ACTION_OTHER = "检查高价值商品组合与价格策略。"
PULSE_HIGH_CHANGE = 10
DRIVER_TITLE = "{name} 是最大商品增量"
DRIVER_NARRATIVE = "相比上月，{name}净营业额增加{change}。"
DRIVER_ACTION = "检查{name}的库存、备货和门店供应能力。"
DAILY_TITLE_WATCH = "{month}月{day}日营业额低于同星期基线"
DAILY_TITLE_POSITIVE = "{month}月{day}日营业额高于同星期基线"
DAILY_TITLE_NEUTRAL = "{month}月{day}日经营处于正常区间"
DAILY_ACTION_WATCH = "优先检查当日门店营业状态、缺货和异常退款。"
DAILY_ACTION_POSITIVE = "确认增长来源，并为下一同星期日准备排班与库存。"
DAILY_ACTION_NEUTRAL = "维持当前排班与备货，继续观察下一营业日。"
DAILY_NARRATIVE = "当日净营业额{value}，相比最近4个同星期日中位数{direction}{change}%。"
DAILY_CHANGE = 15
DAILY_HIGH_CHANGE = 25
DAILY_COMPARABLE_DAYS = 4
DAILY_MIN_DAYS = 8

# Money display.
CURRENCY_SIGN = "¥"

# Default scope text of a metric query.
SCOPE_ALL = "all accepted records"
