"""What the operators share: reading tables, and texts in batches of bounded bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH_BYTES = 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plain_names(docs: DataFrame, *columns: str) -> tuple[DataFrame, list[str]]:
    """The frame with columns named c0, c1, ..., so that none has a name an operator uses, and the new names of some."""
    places = {name.lower(): i for i, name in enumerate(docs.columns)}
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), [f"c{places[c.lower()]}" for c in columns]


def with_text(docs: DataFrame, text_column: str) -> tuple[DataFrame, str]:
    """The frame and its column of texts as strings: the given one if it is such, else ``_text``, so that no text is handed over twice."""
    if isinstance(docs.schema[text_column].dataType, T.StringType):
        return docs, text_column
    return docs.withColumn("_text", F.col(text_column).cast("string")), "_text"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def by_bytes(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold at most ``limit`` bytes; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = total = 0
    for row, size in enumerate(sizes):
        if total + size > limit and row > start:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The texts of a batch; a null is an empty text."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def safe_segments(text: str, limit: int, cut_at: str = " ") -> Iterator[str]:
    """Parts of at most ``limit`` characters, cut in front of a blank between two other characters.

    The blank stays the first character of the next part; a part without any
    such place is longer.
    """
    start, size = 0, len(text)
    while size - start > limit:
        cut = _cut(text, start, limit, cut_at)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut
    yield text[start:]


def _cut(text: str, start: int, limit: int, cut_at: str) -> int:
    cut = text.rfind(cut_at, start + 1, start + limit)
    while cut > start and not _is_single(text, cut):
        cut = text.rfind(cut_at, start + 1, cut)
    if cut > start:
        return cut
    cut = text.find(cut_at, start + limit)
    while cut >= 0 and not _is_single(text, cut):
        cut = text.find(cut_at, cut + 1)
    return cut


def _is_single(text: str, at: int) -> bool:
    return 0 < at < len(text) - 1 and text[at - 1] not in " ▁" and text[at + 1] not in " ▁"
