"""Keeping or leaving out listed rows without a shuffle of the rest.

A list of keys is held by a row of bits, of at most SIEVE_WORDS words of 64
whatever the list's length, put together by Spark.  A row whose bit is not set
has no key of the list for sure and stays where it is; only the others meet the
list itself, in an exact join.  A list too long for the bits costs more rows in
that join and never changes the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIEVE_WORDS = 1 << 19
SIEVE_BITS = 16


def may_be_in(listed: DataFrame, column: str, n: int) -> Column:
    """False only for values of ``column`` that none of the ``n`` listed rows has."""
    words = 1
    while words < SIEVE_WORDS and 64 * words < SIEVE_BITS * n:
        words *= 2
    at = F.pmod(F.xxhash64(column), F.lit(64 * words))
    word, bit = F.floor(at / 64).cast("int"), (at % 64).cast("int")
    found = listed.select(word.alias("word"), bit.alias("bit")).groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = listed.sparkSession.range(words).select(F.col("id").cast("int").alias("word")).join(found, "word", "left")
    ordered = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    held = every.agg(F.transform(ordered, lambda w: w["bits"]).alias("held")).scalar()
    return F.call_function("shiftrightunsigned", F.get(held, word), bit).bitwiseAND(F.lit(1)) == 1


def only(rows: DataFrame, listed: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` (never null) is in the stored table ``listed``."""
    return rows.where(may_be_in(listed, column, listed.count())).join(listed.select(column), column, "left_semi").select(*rows.columns)


def without(rows: DataFrame, listed: DataFrame, column: str) -> list[DataFrame]:
    """Rows whose ``column`` (never null) is not in the stored table ``listed``: those that pass at once, and the joined ones if any."""
    n = listed.count()
    if not n:
        return [rows]
    doubt = may_be_in(listed, column, n)
    return [rows.where(~doubt), rows.where(doubt).join(listed.select(column), column, "left_anti").select(*rows.columns)]
