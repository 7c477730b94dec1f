"""Operator 9: token counts of whole texts, only lengths leave the Arrow functions.

A null text is an empty text.  Repeated rows are counted each; a null id is
kept.  Extra columns are left out, whatever their names.  An empty table gives
no rows.  A very long text is encoded in segments cut at safe boundaries, and
batches hold a bounded number of bytes, not of rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table, texts_of
from sumstead.llm.tokens import piece_counts

MODEL = "piece_bpe_32k.model"
LIMIT = 4096


def token_counts(docs: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """Per row: its id, ``n_bytes``, ``n_tokens`` and whether the tokens are over the limit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counts(model_path)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                n = pa.array(counter.count(texts_of(batch, "text")), pa.int64())
                size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), size, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"]
                )

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL))


QUERIES = {"op9_token_counts": op9_token_counts}
ORACLES: dict[str, str] = {}
