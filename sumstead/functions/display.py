"""Rounding, money, date and scope texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sumstead.fixed_values import CURRENCY_SIGN, DATE_DISPLAY, WORD_DECLINE, WORD_GROWTH
from sumstead.functions.text import fill


def two_decimals(x: Column) -> Column:
    """Rounded half-even on the exact binary value, as Python rounds."""
    return F.regexp_replace(F.format_number(x, 2), ",", "").cast("double")


def guarded_ratio(numerator: Column, denominator: Column) -> Column:
    """Two decimals; a zero denominator gives 0."""
    n, d = numerator.cast("double"), denominator.cast("double")
    return F.when(d == 0, F.lit(0.0)).otherwise(two_decimals(F.try_divide(n, d)))


def percent_change(previous: Column, current: Column) -> Column:
    """(current - previous) / previous * 100; previous 0 gives 0."""
    p, c = previous.cast("double"), current.cast("double")
    return F.when(p == 0, F.lit(0.0)).otherwise(F.try_divide(c - p, p) * 100)


def percent_text(x: Column) -> Column:
    """Two decimals without a thousands mark."""
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def money(cents: Column) -> Column:
    """N13"""
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(cents.cast("double") / 100, 2))


def signed_money(cents: Column) -> Column:
    """N14"""
    amount = F.format_number(F.abs(cents.cast("double")) / 100, 2)
    return F.concat(F.when(cents >= 0, F.lit("+")).otherwise(F.lit("-")), F.lit(CURRENCY_SIGN), amount)


def direction(change: Column, down: str = WORD_DECLINE) -> Column:
    """N15"""
    return F.when(change >= 0, F.lit(WORD_GROWTH)).otherwise(F.lit(down))


def units(cents: Column) -> Column:
    """N25"""
    return cents.cast("double") / 100


def date_text(day: Column) -> Column:
    """N19"""
    return fill(DATE_DISPLAY, year=F.year(day), month=F.month(day), day=F.dayofmonth(day))


def grain_text(day: Column, grain: str) -> Column:
    """N9"""
    return F.date_format(day, "yyyy-MM" if grain == "month" else "yyyy-MM-dd")


def month_first(year: Column, month: Column) -> Column:
    """N16, first day"""
    return F.make_date(year.cast("int"), month.cast("int"), F.lit(1))


def acceptance_rate(accepted: Column, raw: Column) -> Column:
    """No raw rows gives null."""
    return two_decimals(F.try_divide(accepted.cast("double"), raw.cast("double")) * 100)


def scope_text(date_from: Column, date_to: Column, filters: Column, group_by: Column, all_text: str) -> Column:
    """N20 over a table of queries: ``filters`` is map<string,array<string>>."""
    dates = F.when(
        date_from.isNotNull() | date_to.isNotNull(),
        F.concat(
            F.lit("date="), F.coalesce(date_from.cast("string"), F.lit("*")),
            F.lit(".."), F.coalesce(date_to.cast("string"), F.lit("*")),
        ),
    )
    pairs = F.transform(
        F.array_sort(F.map_entries(filters)),
        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ",")),
    )
    grouped = F.when(F.size(group_by) > 0, F.concat(F.lit("group_by="), F.array_join(group_by, ",")))
    text = F.array_join(F.array_compact(F.concat(F.array(dates), pairs, F.array(grouped))), "; ")
    return F.when(text == "", F.lit(all_text)).otherwise(text)
