"""Cell parsers.

``parse`` works on whole columns in three projections, so that each
intermediate text is computed once per row and the generated code stays small.
For a cell ``c`` it adds ``c_value`` and, where repairs exist, ``c_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumstead.fixed_values import CURRENCY_SIGN
from sumstead.functions.text import ascii_digits, strip, strip_or_null
from sumstead.session import compiled_methods

DATE_REPAIRED = "date_format_normalized"
IDENTIFIER_REPAIRED = "identifier_normalized"
CURRENCY_REPAIRED = "currency_symbol_removed"


def parse(df: DataFrame, identifier: tuple[str, ...] = (), text: tuple[str, ...] = (),
          date: tuple[str, ...] = (), whole: tuple[str, ...] = (), money: tuple[str, ...] = ()) -> DataFrame:
    compiled_methods(df.sparkSession)
    raw = df.columns
    cells = (*identifier, *text, *date, *whole, *money)
    stripped = df.select("*", *[strip_or_null(F.col(c)).alias(f"{c}_text") for c in cells])
    prepared = stripped.select(
        *raw,
        *[F.upper(f"{c}_text").alias(f"{c}_text") for c in identifier],
        *[f"{c}_text" for c in text],
        *[part for c in date for part in (f"{c}_text", _iso_text(F.col(f"{c}_text")).alias(f"{c}_iso"))],
        *[ascii_digits(F.col(f"{c}_text")).alias(f"{c}_text") for c in whole],
        *[part for c in money for part in (f"{c}_text", _amount_text(F.col(f"{c}_text")).alias(f"{c}_amount"))],
    )
    valued = prepared.select(
        *raw,
        *[F.col(f"{c}_text").alias(f"{c}_value") for c in (*identifier, *text)],
        *[part for c in date for part in (f"{c}_text", f"{c}_iso", _date(F.col(f"{c}_iso")).alias(f"{c}_value"))],
        *[_whole(F.col(f"{c}_text")).alias(f"{c}_value") for c in whole],
        *[part for c in money for part in (f"{c}_text", _cents(F.col(f"{c}_amount")).alias(f"{c}_value"))],
    )
    return valued.select(
        *raw,
        *[f"{c}_value" for c in cells],
        # A cell that could not be read was not repaired either.
        *[F.when(F.col(f"{c}_value") != F.col(c), IDENTIFIER_REPAIRED).alias(f"{c}_reason") for c in identifier],
        *[F.when(F.col(f"{c}_value").isNotNull() & (F.substring(f"{c}_text", 1, 10) != F.col(f"{c}_iso")),
                 DATE_REPAIRED).alias(f"{c}_reason") for c in date],
        *[F.when(F.col(f"{c}_value").isNotNull() & F.col(f"{c}_text").startswith(CURRENCY_SIGN),
                 CURRENCY_REPAIRED).alias(f"{c}_reason") for c in money],
    )


def _iso_text(text: Column) -> Column:
    """The two other date shapes written year first."""
    slashed = F.regexp_replace(text, r"^(?U)(\d{4})/(\d{2})/(\d{2})$", "$1-$2-$3")
    return F.regexp_replace(slashed, r"^(?U)(\d{2})-(\d{2})-(\d{4})$", "$3-$2-$1")


def _date(iso: Column) -> Column:
    """An impossible date or any other shape is null; so is year 0."""
    return F.when(iso.rlike(r"^(?U)\d{4}-\d{2}-\d{2}$") & ~iso.startswith("0000"), ascii_digits(iso)).try_cast("date")


def _whole(text: Column) -> Column:
    """An optional minus and digits; beyond 64 bits is null."""
    return F.when(text.rlike(r"^-?\d+$"), text).try_cast("bigint")


def _amount_text(text: Column) -> Column:
    without_sign = F.when(
        text.startswith(CURRENCY_SIGN), F.substring(text, len(CURRENCY_SIGN) + 1, 1 << 30)
    ).otherwise(text)
    return strip(F.translate(without_sign, ",_", ""))


def _cents(amount: Column) -> Column:
    """Exact decimal text to cents; any fraction of a cent is null.

    Twenty decimals are compared exactly; a longer tail must be zeros, and a
    number with an exponent must not have one.
    """
    number = ascii_digits(amount)
    readable = number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    tail_lost = number.rlike(r"\.\d{20}\d*[1-9]|\.\d{20,}[eE]|[eE]-0*(1[5-9]|[2-9]\d|\d{3,})")
    exact = F.when(readable & ~tail_lost, number).try_cast("decimal(38,20)")
    to_cent = F.round(exact, 2).cast("decimal(20,2)")
    return F.when(exact == to_cent, to_cent * F.lit(100).cast("decimal(3,0)")).try_cast("bigint")
