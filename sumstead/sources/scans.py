"""Text scans that keep every cell, and where each row came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumstead.functions.hashing import fingerprint
from sumstead.model import Source
from sumstead.operators.skew import join_one
from sumstead.session import compiled_methods, cut_lineage
from sumstead.sources import quoted

RECORD = "_record"
PLACE = ("source_file", "source_block", "source_position")


class SourceError(ValueError):
    """A source that cannot be read as declared."""


def _header(spark: SparkSession, source: Source) -> list[str]:
    names = spark.read.csv(source.path, header=True, multiLine=source.quoted_newlines, escape='"').columns
    if not names:
        raise SourceError(f"source {source.name} has no header: {source.path}")
    return names


def scan(spark: SparkSession, source: Source) -> DataFrame:
    """All cells as text, with PLACE and ``malformed``.

    A short row leaves its missing cells null, an empty cell stays an empty
    text.  A row with more cells than the header is malformed.
    """
    if source.kind == "parquet":
        frame = spark.read.parquet(source.path)
        names = list(source.columns or frame.columns)
        cells = [F.col(f"`{n}`").cast("string").alias(n) for n in names]
        return _with_place(frame, cells, F.lit(False))
    names = list(source.columns) or _header(spark, source)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in (*names, RECORD)])
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "columnNameOfCorruptRecord": RECORD}
    if source.quoted_newlines:
        frame = _quoted_records(spark, source, names, schema, options)
    else:
        frame = spark.read.schema(schema).options(**options).csv(source.path, header=True, encoding="UTF-8", enforceSchema=False)
    # Cells of a ragged record: separators outside quotes, plus one.
    bare = quoted.without_quoted(F.col(RECORD))
    n_cells = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    cells = [
        F.when(F.col(RECORD).isNull() | (F.lit(i) < n_cells), F.coalesce(F.col(f"`{n}`"), F.lit(""))).alias(n)
        for i, n in enumerate(names)
    ]
    malformed = F.coalesce(n_cells > len(names), F.lit(False))
    if source.quoted_newlines:
        return frame.select(*cells, malformed.alias("malformed"), *PLACE)
    return _with_place(frame, cells, malformed)


def _quoted_records(spark: SparkSession, source: Source, names: list[str], schema: T.StructType, options: dict[str, str]) -> DataFrame:
    """Parsed records whose cells may hold line breaks; files whose header isn't ``names`` are an error."""
    found = cut_lineage(quoted.records(spark, source.path), "records")
    ddl = ", ".join(f"`{n.replace('`', '``')}` string" for n in schema.names)
    parsed = found.select("header", *PLACE, F.from_csv("record", ddl, {**options, "multiLine": "true"}).alias("_row"))
    wrong = F.array(*[F.col("_row").getField(n) for n in names]) != F.array(*[F.lit(n) for n in names])
    other = parsed.where("header").where(F.coalesce(wrong, F.lit(True)) | F.col("_row").getField(RECORD).isNotNull()).select("source_file").first()
    if other:
        raise SourceError(f"source {source.name}: the header of {other['source_file']} is not {names}")
    return parsed.where("NOT header").select("_row.*", *PLACE)


def _with_place(frame: DataFrame, cells: list[Column], malformed: Column) -> DataFrame:
    return frame.select(
        *cells, malformed.alias("malformed"),
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("source_block"),
        F.monotonically_increasing_id().alias("source_position"),
    )


def raw_records(scanned: DataFrame) -> DataFrame:
    """Each row as payload and fingerprint."""
    compiled_methods(scanned.sparkSession)
    names = [c for c in scanned.columns if c not in (*PLACE, "malformed")]
    payload = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(f"`{n}`") for n in names]))
    return scanned.select(*PLACE, "malformed", fingerprint(names).alias("fingerprint"), payload.alias("payload"))


def source_splits(placed: DataFrame) -> DataFrame:
    """One row per file split: how many rows lie before it.

    Splits are ordered by file path and offset, as if all files of a source
    were one; there are as many as the scan had input splits.
    """
    splits = placed.groupBy("source_file", "source_block").agg(
        F.min("source_position").alias("first_position"), F.count(F.lit(1)).alias("records")
    )
    before = Window.orderBy("source_file", "source_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("records_before", F.coalesce(F.sum("records").over(before), F.lit(0)))


def number_rows(placed: DataFrame, splits: DataFrame) -> DataFrame:
    """``source_row_number`` from 2 (the header is row 1), blank lines not counted.

    ``placed`` must be a stored table: positions are only stable once written.
    """
    place = F.struct("source_file", "source_block").alias("_split")
    keyed = splits.select(place, "first_position", "records_before")
    rows = placed.withColumn("_split", F.struct("source_file", "source_block"))
    number = F.col("source_position") - F.col("first_position") + F.col("records_before") + 2
    return (
        join_one(rows, keyed, "_split", "inner", ["source_position"])
        .withColumn("source_row_number", number.cast("bigint"))
        .drop("_split", "first_position", "records_before", *PLACE)
    )


def unpack(records: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Payload cells as columns; an absent cell is null."""
    return records.select("source_row_number", *[F.try_element_at("payload", F.lit(n)).alias(n) for n in names])
