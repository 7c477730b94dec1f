"""Answers to a table of questions.

All numbers come from metric aggregates of the accepted facts, per period: 0
is all time, 1 to 12 the months of one year.  Each question then meets one row
of each aggregate.
"""

from __future__ import annotations

import datetime as dt
from calendar import monthrange
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sumstead import fixed_values as fixed
from sumstead.functions.display import guarded_ratio, money, month_first, percent_change, percent_text
from sumstead.functions.hashing import evidence_id
from sumstead.functions.text import fill
from sumstead.model import MetricQuery, Workspace
from sumstead.operators import questions as q
from sumstead.operators.conversations import CHUNK, contexts, state
from sumstead.operators.insights import last_two_months, monthly_series
from sumstead.operators.linking import link_texts
from sumstead.operators.skew import fits_broadcast, join_one
from sumstead.session import cut_lineage

# A question's identity; its words are in ``text``.
ROW = ("conv_id", "turn")
PERIODS = 13
RANKED = 10


@dataclass(frozen=True)
class Calendar:
    """What the facts cover: a few values on the driver, from one aggregate."""

    year: int
    first_day: dt.date | None
    last_day: dt.date | None
    months: int
    sold_months: tuple[int, ...]


def calendar_row(workspace: Workspace, year: int | None = None) -> DataFrame:
    """One row: coverage, number of observed months, months of the year with sales."""
    day = F.col(workspace.model.date_column)
    months = workspace.facts.groupBy(F.trunc(day, "month").alias("_month")).agg(
        F.min(day).alias("_first"), F.max(day).alias("_last")
    )
    # A month of the calendar per row and, where no year is given, of the last one.
    spans = months.select("*", F.struct(F.year("_month").alias("year"), F.month("_month").alias("month")).alias("_at"))
    return spans.agg(
        F.min("_first").alias("first_day"),
        F.max("_last").alias("last_day"),
        F.count(F.lit(1)).alias("months"),
        F.collect_set("_at").alias("_seen"),
    ).withColumn("year", F.lit(year) if year is not None else F.year("last_day")).select(
        "first_day", "last_day", "months", "year",
        F.array_sort(
            F.transform(F.filter("_seen", lambda at: at["year"] == F.col("year")), lambda at: at["month"])
        ).alias("sold_months"),
    )


def calendar(workspace: Workspace, year: int | None = None) -> Calendar:
    row = calendar_row(workspace, year).first()
    return Calendar(row["year"] or 1, row["first_day"], row["last_day"], row["months"], tuple(row["sold_months"] or ()))


def _month_of(workspace: Workspace, year: int) -> Column:
    """The month of ``year``, null outside it."""
    day = F.col(workspace.model.date_column)
    return F.when(F.year(day) == year, F.month(day))


def _monthly(workspace: Workspace, key: str, year: int) -> DataFrame:
    """Cents by key and month of ``year``: facts are added up once."""
    facts = workspace.facts.select(F.col(key).alias("_key"), _month_of(workspace, year).alias("_month"), "amount_cents")
    return facts.groupBy("_key", "_month").agg(F.sum("amount_cents").alias("amount_cents"))


def _by_period(sums: DataFrame) -> DataFrame:
    """Sums repeated for all time and for their month."""
    return sums.withColumn("period", F.explode(F.array_compact(F.array(F.lit(0), "_month")))).drop("_month")


def _names(workspace: Workspace, dimension: str) -> tuple[str, DataFrame]:
    """The fact key of a dimension, and its names by key."""
    model = workspace.model
    dim = model.dimension(dimension)
    relation = model.relation(dim.table)
    return relation.fact_key, workspace.tables[dim.table].select(
        F.col(relation.table_key).alias("_key"), F.col(dim.column).alias("name")
    )


def revenue_by_period(workspace: Workspace, dimension: str, year: int, bound: int | None = None) -> DataFrame:
    """The cube behind J8, L9 and L11: (name, period, value)."""
    key, names = _names(workspace, dimension)
    named = join_one(_monthly(workspace, key, year), names, "_key", bound=bound)
    months = named.groupBy("name", "_month").agg(F.sum("amount_cents").alias("amount_cents"))
    return _by_period(months).groupBy("name", "period").agg(F.sum("amount_cents").cast("bigint").alias("value"))


def leaders(cube: DataFrame, n: int) -> DataFrame:
    """A10 and T3 per period: the n largest values, smallest name among equals.

    The rank filter lets each task keep n rows per period before the shuffle.
    """
    order = Window.partitionBy("period").orderBy(F.col("value").desc(), F.col("name").asc())
    return cube.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def category_leaders(workspace: Workspace, year: int, bound: int | None = None) -> DataFrame:
    """One row per period."""
    top = leaders(revenue_by_period(workspace, "store_category", year, bound), 1)
    return top.select("period", F.col("name").alias("category"), F.col("value").alias("category_value"))


def product_rankings(products: DataFrame) -> DataFrame:
    """One row per period with the ten names in order, from the product cube."""
    top = leaders(products, RANKED)
    ordered = F.array_sort(F.collect_list(F.struct("position", "name", "value")))
    return top.groupBy("period").agg(ordered.alias("_top")).select(
        "period",
        F.array_join(F.transform("_top", lambda t: t["name"]), fixed.NAME_SEPARATOR).alias("ranking"),
        F.element_at("_top", 1)["name"].alias("top_product"),
        F.element_at("_top", 1)["value"].alias("top_value"),
    )


def store_periods(workspace: Workspace, year: int, bound: int | None = None) -> DataFrame:
    """The cube behind L13: (name, period, value, orders), without a distinct count.

    The periods of an order in a store are the bits of one number, which merge
    exactly; so each order is one row of its store, and a period's orders are
    the rows that have its bit.  Amounts are added up apart, so they do not
    travel with the orders.
    """
    key, names = _names(workspace, "store")
    bit = F.lit(1).bitwiseOR(F.call_function("shiftleft", F.lit(1), F.coalesce(_month_of(workspace, year), F.lit(0))))
    sold = workspace.facts.where(F.col("order_id").isNotNull()).select(F.col(key).alias("_key"), bit.alias("_periods"), "order_id")
    if not fits_broadcast(names, bound):
        # One row per key and order before anything is joined.
        sold = sold.groupBy("_key", "order_id").agg(F.bit_or("_periods").alias("_periods"))
    orders = join_one(sold, names, "_key", bound=bound).groupBy("name", "order_id").agg(F.bit_or("_periods").alias("_periods"))
    periods = [
        F.struct(F.lit(p).alias("period"), F.count_if(F.col("_periods").bitwiseAND(F.lit(1 << p)) != 0).alias("orders"))
        for p in range(PERIODS)
    ]
    counts = orders.groupBy("name").agg(F.array(*periods).alias("_cells")).select("name", F.inline("_cells"))
    values = revenue_by_period(workspace, "store", year, bound)
    # A cell without orders may have a value, and names may be null: both sides are added up, not joined.
    both = values.withColumn("orders", F.lit(0).cast("bigint")).unionByName(
        counts.where("orders > 0").withColumn("value", F.lit(None).cast("bigint")))
    return both.groupBy("name", "period").agg(F.max("value").alias("value"), F.max("orders").alias("orders"))


def store_leaders(workspace: Workspace, year: int, bound: int | None = None) -> DataFrame:
    """Number of stores, the revenue leader and its average order value."""
    stores = cut_lineage(store_periods(workspace, year, bound), "stores")
    counts = stores.groupBy("period").agg(F.count(F.lit(1)).alias("stores"))
    top = leaders(stores, 1).select(
        "period", F.col("name").alias("store"), F.col("value").alias("store_value"),
        guarded_ratio(F.col("value"), F.col("orders")).alias("store_aov"),
    )
    # One row per period on both sides.
    return top.join(F.broadcast(counts), "period")


def _outside(cal: Calendar, month: Column) -> Column:
    """the month does not touch the coverage; without dates nothing is outside."""
    if cal.first_day is None:
        return month.isNotNull()
    start = month_first(F.lit(cal.year), month)
    return F.when(
        month.isNotNull(), (F.last_day(start) < F.lit(cal.first_day)) | (start > F.lit(cal.last_day))
    ).otherwise(False)


def _leaves_context(cal: Calendar, month: Column) -> dict[str, Column]:
    """Whether a dated or undated answer of an intent leaves a context behind."""
    sold = F.when(month.isNull(), F.lit(cal.months > 0)).otherwise(
        month.isin(*cal.sold_months) if cal.sold_months else F.lit(False)
    )
    return {
        q.CATEGORY_LEADER: F.lit(True),
        q.PRODUCT_RANKING: F.lit(True),
        q.AOV_TREND: _outside(cal, month) | F.lit(cal.months >= 2),
        q.STORE_COMPARISON: _outside(cal, month) | sold,
    }


def read_and_link(questions: DataFrame, workspace: Workspace, bound: int | None = None) -> DataFrame:
    """L1-L6 for every question.

    Equal texts are read and linked once, however often they are asked, and
    their readings are stored because several branches use them.
    """
    texts = cut_lineage(q.read_questions(questions.select("text").distinct()).drop("plain"))
    linked = link_texts(texts, workspace, bound)
    return join_one(
        questions, linked, "text", "left", list(ROW), bound=bound, sketched=questions.select("text"),
    )


def resolve(questions: DataFrame, workspace: Workspace, cal: Calendar, bound: int | None = None,
            chunk: int = CHUNK, carried: tuple[str, ...] | None = None) -> DataFrame:
    """Intent, product and month of every turn, with inheritance.

    ``carried`` names the columns of the questions that the result keeps, all by
    default; texts that nobody reads need not travel with their turns.
    """
    given = list(carried or questions.columns)
    linked = read_and_link(questions, workspace, bound)
    kept = F.lit(False)
    for intent, ok in _leaves_context(cal, F.col("own_month")).items():
        kept = F.when(F.col("intent") == intent, ok).otherwise(kept)
    own_state = F.when(
        F.col("intent") == q.PRODUCT_REVENUE,
        F.when(F.col("own_product").isNotNull(), state(q.PRODUCT_REVENUE, F.col("own_product"), F.col("own_month"))),
    ).when(kept, state(F.col("intent"), None, F.col("own_month")))
    read = ("match_count", "matched", "own_product", "intent", "follow_up", "month", "own_month")
    turns = linked.select(*given, *read, own_state.alias("own_state"))
    # The largest turn number bounds the length of every conversation.
    longest = cut_lineage(questions.agg(F.max("turn").alias("turn")), "longest").first()[0]
    carried = contexts(turns, _leaves_context(cal, F.col("month")), longest=longest, chunk=chunk)
    inherits = F.col("before").isNotNull() & F.col("follow_up") & F.col("month").isNotNull()
    inherited_product = F.when(F.col("match_count") == 1, F.col("matched")).when(
        F.col("match_count") == 0, F.col("before.product")
    )
    resolved_intent = F.when(inherits, F.col("before.intent")).otherwise(F.col("intent"))
    return carried.select(
        *given, "match_count",
        resolved_intent.alias("intent"),
        F.when(
            resolved_intent == q.PRODUCT_REVENUE,
            F.when(inherits, inherited_product).otherwise(F.col("own_product")),
        ).alias("product"),
        F.when(inherits, F.col("month")).otherwise(F.col("own_month")).alias("month"),
    ).withColumn("date_from", month_first(F.lit(cal.year), F.col("month"))).withColumn(
        "date_to", F.last_day("date_from")
    )


CITATIONS = (
    "array<struct<evidence_id:string,processing_run_id:int,metric:string,label:string,value:double,"
    "display_value:string,dimensions:map<string,string>,scope:string>>"
)


def _citation(workspace: Workspace, metric: str, evidence: Column, scope: Column, value: Column,
              dimension: str | None = None, name: Column | None = None) -> Column:
    """L15"""
    dims = F.create_map(F.lit(dimension), name) if dimension else F.create_map().cast("map<string,string>")
    return F.struct(
        evidence.alias("evidence_id"), F.lit(workspace.run_id).alias("processing_run_id"),
        F.lit(metric).alias("metric"), F.lit(workspace.model.metric(metric).label).alias("label"),
        value.cast("double").alias("value"), money(value).alias("display_value"),
        dims.alias("dimensions"), scope.alias("scope"),
    )


def _period_queries(workspace: Workspace, cal: Calendar) -> DataFrame:
    """The metric queries behind each period's answers, PERIODS rows."""
    rows = []
    for period in range(PERIODS):
        first = last = None
        if period:
            first = dt.date(cal.year, period, 1)
            last = dt.date(cal.year, period, monthrange(cal.year, period)[1])
        queries = (
            MetricQuery("revenue", ("store_category",), date_from=first, date_to=last),
            MetricQuery("revenue", ("product",), date_from=first, date_to=last, limit=500),
            MetricQuery("revenue", ("store",), date_from=first, date_to=last),
            MetricQuery("average_order_value", ("store",), date_from=first, date_to=last),
        )
        slug, run_id = workspace.model.slug, workspace.run_id
        rows.append((period, *[part for query in queries for part in (query.evidence_id(slug, run_id), query.scope())]))
    names = [f"{name}_{part}" for name in ("category", "ranking", "store", "store_aov") for part in ("evidence", "scope")]
    return workspace.facts.sparkSession.createDataFrame(rows, f"period int, {', '.join(n + ' string' for n in names)}")


def _as_answer(intent: str, refusals: list[tuple[Column, str, Column | str]], text: Column, citations: list[Column]):
    """One intent's answer in a period: the first refusal that applies, else the text."""
    reason, worded = F.lit(None).cast("string"), text
    for applies, name, refusal in reversed(refusals):
        reason = F.when(applies, name).otherwise(reason)
        worded = F.when(applies, refusal).otherwise(worded)
    cited = F.when(reason.isNull(), F.array(*citations).cast(CITATIONS)).otherwise(F.array().cast(CITATIONS))
    return F.struct(F.lit(intent).alias("intent"), reason.alias("reason"), worded.alias("answer"), cited.alias("citations"))


def period_answers(workspace: Workspace, cal: Calendar, products: DataFrame, bound: int | None = None) -> DataFrame:
    """All answers that name no product, one row per intent and period.

    ``products`` is the product cube of the calendar's year.  Each part is
    stored as soon as it is made: it has PERIODS rows at most, while what is
    shuffled for it grows with the facts.
    """
    year = cal.year
    trend = cut_lineage(last_two_months(monthly_series(workspace)), "trend")
    frame = _period_queries(workspace, cal)
    for part in (
        category_leaders(workspace, year, bound),
        product_rankings(products),
        store_leaders(workspace, year, bound),
    ):
        # PERIODS rows at most on both sides.
        frame = frame.join(F.broadcast(cut_lineage(part, "part")), "period", "left")
    frame = frame.withColumn("_trend", trend.select(F.struct(*trend.columns)).scalar())
    month = F.when(F.col("period") > 0, F.col("period"))
    month_text = fill(fixed.PERIOD_MONTH, month=F.col("period"))
    in_range = F.when(month.isNotNull(), month_text).otherwise(fixed.PERIOD_ALL_RANGE)
    in_records = F.when(month.isNotNull(), month_text).otherwise(fixed.PERIOD_ALL_RECORDS)
    aov, previous = F.col("_trend.average_order_value"), F.col("_trend.previous_average_order_value")
    outside = (
        (_outside(cal, month), "no_data", F.lit(fixed.ANSWER_NO_DATA))
        if cal.first_day is None
        else (_outside(cal, month), "outside",
              fill(fixed.ANSWER_OUT_OF_COVERAGE, month=F.col("period"), **_coverage_texts(cal)))
    )
    monthly = MetricQuery("average_order_value", ("date",), grain="month")

    def cite(metric: str, source: str, value: str, dimension: str, name: str) -> Column:
        return _citation(workspace, metric, F.col(f"{source}_evidence"), F.col(f"{source}_scope"), F.col(value),
                         dimension, F.col(name))

    def cite_month(value: Column, name: str) -> Column:
        return _citation(
            workspace, "average_order_value", F.lit(monthly.evidence_id(workspace.model.slug, workspace.run_id)),
            F.lit(monthly.scope()), value, "date", F.col(f"_trend.{name}"),
        )

    no_trend = F.col("_trend").isNull() | (previous == 0)
    answers = (
        _as_answer(
            q.CATEGORY_LEADER,
            [outside, (F.col("category").isNull(), "no_category", F.lit(fixed.ANSWER_NO_CATEGORY))],
            fill(fixed.ANSWER_CATEGORY, period=in_range, name=F.col("category"), display=money(F.col("category_value"))),
            [cite("revenue", "category", "category_value", "store_category", "category")],
        ),
        _as_answer(
            q.PRODUCT_RANKING,
            [outside, (F.col("ranking").isNull(), "no_ranking", F.lit(fixed.ANSWER_NO_RANKING))],
            fill(fixed.ANSWER_RANKING, period=in_records, names=F.col("ranking")),
            [cite("revenue", "ranking", "top_value", "product", "top_product")],
        ),
        _as_answer(
            q.AOV_TREND,
            [outside, (no_trend, "no_trend", F.lit(fixed.ANSWER_NO_TREND))],
            fill(
                fixed.ANSWER_TREND,
                direction=F.when(aov > previous, fixed.TREND_UP).otherwise(fixed.TREND_DOWN),
                previous=F.col("_trend.previous_month"), previous_display=money(previous),
                latest=F.col("_trend.month"), latest_display=money(aov),
                delta=percent_text(F.abs(percent_change(previous, aov))),
            ),
            [cite_month(previous, "previous_month"), cite_month(aov, "month")],
        ),
        _as_answer(
            q.STORE_COMPARISON,
            [outside, (F.col("store").isNull(), "no_stores", F.lit(fixed.ANSWER_NO_STORES))],
            fill(
                fixed.ANSWER_STORES, period=in_range, stores=F.col("stores"), name=F.col("store"),
                revenue=money(F.col("store_value")), aov=money(F.col("store_aov")),
            ),
            [cite("revenue", "store", "store_value", "store", "store"),
             cite("average_order_value", "store_aov", "store_aov", "store", "store")],
        ),
    )
    return frame.select("period", F.inline(F.array(*answers)))


def _coverage_texts(cal: Calendar) -> dict[str, str]:
    return {
        name: fixed.DATE_DISPLAY.format(year=day.year, month=day.month, day=day.day)
        for name, day in (("first", cal.first_day), ("last", cal.last_day))
    }


def answer(questions: DataFrame, workspace: Workspace, year: int | None = None, bound: int | None = None,
           chunk: int = CHUNK, carried: tuple[str, ...] | None = None, evidence: bool = True) -> DataFrame:
    """One answer per question.

    A question without a product meets one of a few dozen finished answers;
    one with a product meets its cell of the product cube.  ``carried`` is as
    in ``resolve``; without ``evidence`` citations of products have no id and
    no scope, for callers that read values only.
    """
    given = list(carried or questions.columns)
    cal = calendar(workspace, year)
    resolved = resolve(questions, workspace, cal, bound, chunk, carried)
    period = F.coalesce(F.col("month"), F.lit(0)).cast("int")
    # Ranked below and joined to the questions; stored, its real size decides how.
    products = cut_lineage(revenue_by_period(workspace, "product", cal.year, bound), "products")
    # Four intents times PERIODS rows.
    plain = period_answers(workspace, cal, products, bound).select(
        "intent", "period", F.struct("reason", "answer", "citations").alias("_plain")
    )
    rows = resolved.withColumn("period", period).join(F.broadcast(plain), ["intent", "period"], "left")
    cube = products.select(
        F.struct(F.col("name").alias("product"), "period").alias("_cell"), F.col("value").alias("_value")
    )
    keyed = rows.withColumn("_cell", F.when(F.col("product").isNotNull(), F.struct("product", "period")))
    valued = join_one(keyed, cube, "_cell", "left", list(ROW), bound=bound).withColumn("_value", F.coalesce("_value", F.lit(0)).cast("bigint"))
    intent, month, product, value = F.col("intent"), F.col("month"), F.col("product"), F.col("_value")
    is_product = intent == q.PRODUCT_REVENUE
    has_dates = cal.first_day is not None
    reason = (
        F.when(intent.isNull(), "no_intent")
        .when(is_product & product.isNull(), "no_unique_product")
        .when(is_product & (_outside(cal, month) if has_dates else F.lit(False)), "product_outside")
        .otherwise(F.col("_plain.reason"))
    )
    text = (
        F.when(F.col("reason") == "no_intent", fixed.ANSWER_NO_INTENT)
        .when(F.col("reason") == "no_unique_product", fixed.ANSWER_NO_UNIQUE_PRODUCT)
        .when(
            F.col("reason") == "product_outside",
            fill(fixed.ANSWER_PRODUCT_OUT_OF_COVERAGE, product=product, month=month, **_coverage_texts(cal))
            if has_dates else F.lit(None).cast("string"),
        )
        .when(~is_product, F.col("_plain.answer"))
        .when(month.isNull() & (value == 0), fill(fixed.ANSWER_PRODUCT_ALL_MISSING, product=product))
        .when(month.isNull(), fill(fixed.ANSWER_PRODUCT_ALL, product=product, display=money(value)))
        .when(value == 0, fill(fixed.ANSWER_PRODUCT_MONTH_MISSING, product=product, month=month))
        .otherwise(fill(fixed.ANSWER_PRODUCT_MONTH, product=product, month=month, display=money(value)))
    )
    # Refusals that forget: no intent, no product, no trend, no stores.
    forgets = F.coalesce(F.col("reason").isin("no_intent", "no_unique_product", "no_trend", "no_stores"), F.lit(False))
    answered = F.col("reason").isNull()
    return valued.withColumn("reason", reason).select(
        *given,
        F.when(answered, "answered").otherwise("unsupported").alias("status"),
        "reason", "intent", "product", "month", "date_from", "date_to",
        text.alias("answer"),
        F.when(~forgets, F.struct("intent", "product", "date_from", "date_to")).alias("context"),
        F.when(answered & is_product, F.array(_product_citation(workspace, evidence)).cast(CITATIONS))
        .when(answered, F.col("_plain.citations"))
        .otherwise(F.array().cast(CITATIONS)).alias("citations"),
    )


def _product_citation(workspace: Workspace, evidence: bool) -> Column:
    first, last, product = F.col("date_from"), F.col("date_to"), F.col("product")
    if not evidence:
        nothing = F.lit(None).cast("string")
        return _citation(workspace, "revenue", nothing, nothing, F.col("_value"))
    named = evidence_id(
        F.lit(workspace.model.slug), F.lit(workspace.run_id), F.lit("revenue"), F.array().cast("array<string>"),
        F.create_map(F.lit("product"), F.array(product)), first, last, F.lit("day"), F.lit(100),
    )
    dated = F.when(first.isNotNull(), F.concat(F.lit("date="), first.cast("string"), F.lit(".."), last.cast("string")))
    scope = F.concat_ws("; ", dated, F.concat(F.lit("product="), product))
    return _citation(workspace, "revenue", named, scope, F.col("_value"))
