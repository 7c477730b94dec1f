"""S1 and S2 for files with line breaks inside quotes, read by as many tasks as they have splits.

Where a record ends depends on whether a line starts inside quotes, and so on
all lines before it.  What a line does to that is one of four things: nothing,
the opposite, outside or inside whatever was before.  These are folded over the
lines of each split for both beginnings at once, then over the splits (one row
each), which tells every split how it begins.  Nothing is read twice, and no
task holds more than a split, or a record.

A quote opens a cell only at its start; two quotes in quotes are one of the text.
Lines end with LF or CR LF.  Empty lines are not records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from sumstead.operators.skew import join_one
from sumstead.session import cut_lineage

SPLIT = ("source_file", "source_block")


def _ends_inside(line: Column) -> Column:
    """Whether a line that starts outside quotes ends inside: a cell is opened and not closed."""
    return F.regexp_replace(line, '(^|,)"[^"]*"[^,]*', "$1").rlike('(^|,)"')


def without_quoted(record: Column) -> Column:
    """A record without its quoted cells, also one that is never closed.  Nothing backtracks, however long a cell is."""
    bare = F.replace(record, F.lit('""'), F.lit(""))
    return F.regexp_replace(F.regexp_replace(bare, '(^|,)"[^"]*"[^,]*', "$1"), '(^|,)"[^"]*\\z', "$1")


def _effects(rows: DataFrame, line: Column) -> DataFrame:
    """``_out`` and ``_in``: whether a line ends inside quotes if it starts outside or inside."""
    bare = F.replace(line, F.lit('""'), F.lit(""))
    plain = ~F.contains(line, F.lit('"'))
    # To start inside is to have met one more quote.
    return rows.withColumn("_out", F.when(plain, False).otherwise(_ends_inside(bare))).withColumn(
        "_in", F.when(plain, True).otherwise(_ends_inside(F.concat(F.lit('"'), bare))))


def _folded(rows: DataFrame, over: WindowSpec) -> DataFrame:
    """Replaces ``_out`` and ``_in`` by the states after all rows up to each, and adds those before it.

    After the last row that fixes the state only the number of turns counts.
    """
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    turned = rows.withColumn("_turns", F.sum((F.col("_out") & ~F.col("_in")).cast("int")).over(upto))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").alias("to"), F.col("_turns").alias("turns")))
    marked = turned.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(upto))
    odd = F.when(F.col("_fixed").isNull(), F.col("_turns")).otherwise(F.col("_turns") - F.col("_fixed.turns")) % 2 == 1
    folded = marked.withColumn("_out", F.coalesce(F.col("_fixed.to"), F.lit(False)) != odd).withColumn(
        "_in", F.coalesce(F.col("_fixed.to"), F.lit(True)) != odd)
    return folded.select(
        *rows.columns, F.lag("_out", 1, False).over(over).alias("_before_out"), F.lag("_in", 1, True).over(over).alias("_before_in"))


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """All lines with, for both beginnings of their split, whether they start a record, which one they belong to and its number.

    One shuffle, by split; a line's state before and after it depends on the beginning only.
    """
    read = spark.read.text(path, lineSep="\n").select(
        F.col("value").alias("_line"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"), F.monotonically_increasing_id().alias("_at"))
    over = Window.partitionBy(*SPLIT).orderBy("_at")
    upto = over.rowsBetween(Window.unboundedPreceding, 0)
    first = (F.row_number().over(over) == 1) & (F.col("source_block") == 0)
    read = read.withColumn("_line", F.when(first, F.ltrim("_line", F.lit("﻿"))).otherwise(F.col("_line")))
    rows = _folded(_effects(read, F.col("_line")), over)
    blank = F.col("_line").isin("", "\r")
    for name in ("out", "in"):
        starts = ~F.col(f"_before_{name}") & ~blank
        rows = rows.withColumn(f"_starts_{name}", starts).withColumn(
            f"_record_{name}", F.last(F.when(starts, F.col("_at")), ignorenulls=True).over(upto)).withColumn(
            f"_number_{name}", F.sum(starts.cast("bigint")).over(upto))
    return rows


def _split_states(lines: DataFrame) -> DataFrame:
    """One row for each split: whether it begins inside quotes, the record that goes on there, and the records before it."""
    last = F.max_by(F.struct("_out", "_in", *[f"_{part}_{name}" for part in ("record", "number") for name in ("out", "in")]), "_at")
    ends = lines.groupBy(*SPLIT).agg(last.alias("_end")).select(*SPLIT, "_end.*")
    over = Window.partitionBy("source_file").orderBy("source_block")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    states = _folded(ends, over).withColumn("_inside", F.col("_before_out"))
    own = {part: F.when(F.col("_inside"), F.col(f"_{part}_in")).otherwise(F.col(f"_{part}_out")) for part in ("record", "number")}
    return states.select(
        F.struct(*SPLIT).alias("_split"), "_inside", F.last(own["record"], ignorenulls=True).over(before).alias("_goes_on"),
        F.coalesce(F.sum(own["number"]).over(before), F.lit(0)).alias("_numbered"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (its text), ``header`` (the first of its file) and the place of its first line."""
    lines = cut_lineage(_lines(spark, path), "lines")
    states = cut_lineage(_split_states(lines), "splits")
    rows = join_one(lines.withColumn("_split", F.struct(*SPLIT)), states, "_split", "inner", ["_at"])

    def own(part: str) -> Column:
        return F.when(F.col("_inside"), F.col(f"_{part}_in")).otherwise(F.col(f"_{part}_out"))

    # The state after a line, under the state of its split.
    rows = rows.select(
        *SPLIT, "_at", "_line", own("starts").alias("_starts"), F.coalesce(own("record"), F.col("_goes_on")).alias("_record"),
        own("number").alias("source_position"), own("before").alias("_within"),
        F.when(F.col("_inside"), F.col("_in")).otherwise(F.col("_out")).alias("_open"),
        (own("number") + F.col("_numbered") == 1).alias("header"))
    place = (*SPLIT, "source_position", "header")
    alone = rows.where("_starts AND NOT _open").select(F.col("_line").alias("record"), *place)
    parts = rows.where("_within OR (_starts AND _open)").groupBy("source_file", "_record").agg(
        F.array_sort(F.collect_list(F.struct("_at", "_line"))).alias("_parts"), F.min_by(F.struct(*place), "_at").alias("_place"))
    joined = parts.select(F.array_join(F.transform("_parts", lambda p: p["_line"]), "\n").alias("record"), *[f"_place.{c}" for c in place])
    return alone.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))
