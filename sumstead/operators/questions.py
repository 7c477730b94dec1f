"""What one question asks for, from its text alone.

``read_questions`` adds, in staged projections,

* ``plain``      the text without whitespace, lower case
* ``month``      the month it names
* ``follow_up``  whether it can continue an earlier question
* ``intent``     one of the closed set, or null
* ``phrase``     the words left as a product's name
* ``own_month``  the month the intent uses
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead import fixed_values as fixed
from sumstead.functions.text import contains_any, without_whitespace
from sumstead.session import compiled_methods

PRODUCT_REVENUE = "product_revenue"
CATEGORY_LEADER = "category_leader"
PRODUCT_RANKING = "product_ranking"
AOV_TREND = "aov_trend"
STORE_COMPARISON = "store_comparison"
INTENTS = (CATEGORY_LEADER, PRODUCT_REVENUE, PRODUCT_RANKING, AOV_TREND, STORE_COMPARISON)

# Longer words first, so that "11月" is not read as "1月".
MONTH_ORDER = tuple(sorted(fixed.MONTH_WORDS, key=len, reverse=True))
_MONTH_PHRASE = (
    fixed.MONTH_PHRASE_LEAD + "(?:" + "|".join(map(re.escape, MONTH_ORDER)) + ")" + fixed.MONTH_PHRASE_TAIL
)


def plain_question(text: Column) -> Column:
    """L1"""
    return F.lower(without_whitespace(text))


def named_month(plain: Column) -> Column:
    """L2: the first month word in ``MONTH_ORDER``, not in the text."""
    return F.coalesce(*[F.when(plain.contains(w), F.lit(fixed.MONTH_WORDS[w])) for w in MONTH_ORDER])


def is_follow_up(plain: Column) -> Column:
    return (F.char_length(plain) <= fixed.FOLLOW_UP_MAX_CHARS) | contains_any(plain, fixed.FOLLOW_UP_WORDS)


def is_out_of_scope(plain: Column) -> Column:
    """F7"""
    return contains_any(plain, fixed.OUT_OF_SCOPE_WORDS)


def _asks_ranking(plain: Column) -> Column:
    return (
        contains_any(plain, fixed.RANKING_SCOPE_WORDS)
        & contains_any(plain, fixed.RANKING_ORDER_WORDS)
        & contains_any(plain, fixed.RANKING_REVENUE_WORDS)
    )


def question_rule(plain: Column) -> Column:
    """L3: the first rule that applies; ``product_summary`` is settled later."""
    return (
        F.when(plain.contains(fixed.AOV_WORD) & contains_any(plain, fixed.AOV_TREND_WORDS), AOV_TREND)
        .when(plain.contains(fixed.CATEGORY_WORD) & contains_any(plain, fixed.CATEGORY_LEADER_WORDS), CATEGORY_LEADER)
        .when(plain.contains(fixed.STORE_WORD) & contains_any(plain, fixed.STORE_COMPARISON_WORDS), STORE_COMPARISON)
        .when(_asks_ranking(plain), PRODUCT_RANKING)
        .when(is_out_of_scope(plain), F.lit(None).cast("string"))
        .when(contains_any(plain, fixed.REVENUE_QUESTION_WORDS), PRODUCT_REVENUE)
        .when(contains_any(plain, fixed.SUMMARY_QUESTION_WORDS), "product_summary")
    )


def _without_prefixes(text: Column) -> Column:
    # Anchored and optional one after another: each is removed once, in order.
    pattern = "^" + "".join(f"(?:{re.escape(p)})?" for p in fixed.QUESTION_PREFIXES)
    return F.regexp_replace(text, pattern, "")


def revenue_phrase(plain: Column, month: Column) -> Column:
    """L4: a revenue question without its revenue and month words."""
    text = _without_prefixes(F.btrim(plain, F.lit(fixed.QUESTION_EDGE_MARKS)))
    # Only the first month phrase goes.
    text = F.when(
        month.isNotNull(), F.regexp_replace(text, rf"^(?s)(?U)(.*?){_MONTH_PHRASE}", "$1")
    ).otherwise(text)
    text = reduce(lambda t, phrase: F.replace(t, F.lit(phrase), F.lit("")), fixed.REVENUE_PHRASES, text)
    text = F.btrim(text, F.lit(fixed.PRODUCT_EDGE_MARKS))
    return F.regexp_replace(text, "^" + fixed.PRODUCT_LEAD_WORD, "")


def summary_phrase(plain: Column) -> Column:
    """L4: a summary question without its request words."""
    suffixes = (*fixed.SUMMARY_SUFFIXES, fixed.SUMMARY_LAST_SUFFIX)
    # Each suffix once, in order: read backwards that is an anchored pattern.
    backwards = "^" + "".join(f"(?:{re.escape(s[::-1])})?" for s in suffixes)
    return F.reverse(F.regexp_replace(F.reverse(_without_prefixes(plain)), backwards, ""))


def read_questions(questions: DataFrame, text: str = "text") -> DataFrame:
    """L1-L4 for a table of questions."""
    compiled_methods(questions.sparkSession)
    given = questions.columns
    plain = questions.withColumn("plain", plain_question(F.col(text)))
    ruled = plain.select(
        "*",
        named_month(F.col("plain")).alias("month"),
        is_follow_up(F.col("plain")).alias("follow_up"),
        question_rule(F.col("plain")).alias("_rule"),
    )
    phrased = ruled.withColumn(
        "phrase",
        F.when(F.col("_rule") == PRODUCT_REVENUE, F.nullif(revenue_phrase(F.col("plain"), F.col("month")), F.lit("")))
        .when(F.col("_rule") == "product_summary", F.nullif(summary_phrase(F.col("plain")), F.lit(""))),
    )
    summary = F.col("_rule") == "product_summary"
    return phrased.select(
        *given, "plain", "month", "follow_up", "phrase",
        F.when(summary, F.when(F.col("phrase").isNotNull(), PRODUCT_REVENUE)).otherwise(F.col("_rule")).alias("intent"),
        F.when(~summary & (F.col("_rule") != AOV_TREND), F.col("month")).alias("own_month"),
    )
