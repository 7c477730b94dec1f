"""Operator 2: vector best-fit packing of documents into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum
of the squares of its pieces' lengths).  Pieces go longest first into the open
sequence that still holds them under every capacity and scores least, either
by the norm of what would be left (``"norm"``) or by the weighted dot product
of what the piece needs and what is left (``"dot"``).

Pieces are dealt at random to shards of some SHARD_PIECES, whose number grows
with the table, and each shard is packed by itself; only lengths are dealt.  A
shard leaves about one sequence half full.

A null text is an empty text, which is its end id alone; repeated rows are
packed each; ids pass through as they are, nulls and large ones too; extra columns
are left out; an empty table gives no rows.  Texts are encoded in batches of
bounded bytes, a longer text alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table, texts_of
from sumstead.llm.tokens import word_ids
from sumstead.session import cut_lineage

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
SEQUENCE_TOKENS = 4096
SHARD_PIECES = 8192

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PLACED = f"{PIECES}, sequence_id bigint, offset bigint"


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  By default only tokens ever bind: no more pieces
    than tokens, and no more cost than one piece of full length."""

    tokens: int = SEQUENCE_TOKENS
    documents: int = SEQUENCE_TOKENS
    cost: int = SEQUENCE_TOKENS**2
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    score: str = "norm"


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and the offset of each piece, sequences numbered from 0.

    Ties go to the sequence opened first.
    """
    if capacity.score not in ("norm", "dot"):
        raise ValueError(f"unknown score {capacity.score}")
    if len(lengths) and (lengths.max() > capacity.tokens or int(lengths.max()) ** 2 > capacity.cost
                         or capacity.documents < 1):
        raise ValueError("a piece doesn't fit into an empty sequence")
    most = np.array([capacity.tokens, capacity.documents, capacity.cost], dtype=np.float64)
    scale = np.sqrt(np.array(capacity.weights)) / most
    left = np.empty((3, len(lengths)), dtype=np.float64)
    names = np.empty(len(lengths), dtype=np.int64)
    sequence, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    smallest = float(lengths.min()) if len(lengths) else 0.0
    n = opened = 0
    for i in order.tolist():
        need = np.array([lengths[i], 1.0, float(lengths[i]) ** 2])
        rest = left[:, :n] - need[:, None]
        fits = np.flatnonzero(rest.min(axis=0) >= 0) if n else ()
        if len(fits):
            if capacity.score == "norm":
                score = ((rest[:, fits] * scale[:, None]) ** 2).sum(axis=0)
            else:
                score = (left[:, fits] * (need * scale**2)[:, None]).sum(axis=0)
            at = int(fits[np.argmin(score)])
        else:
            at, n = n, n + 1
            left[:, at], names[at] = most, opened
            opened += 1
        sequence[i], offset[i] = names[at], int(capacity.tokens - left[0, at])
        left[:, at] -= need
        if left[0, at] < smallest or left[1, at] < 1 or left[2, at] < smallest**2:  # full: nothing fits any more
            n -= 1
            left[:, at : n], names[at : n] = left[:, at + 1 : n + 1].copy(), names[at + 1 : n + 1].copy()
    return sequence, offset


def pieces(docs: DataFrame, vocabulary_path: str, tokens: int = SEQUENCE_TOKENS, end_id: int = END_ID,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids and its end id, cut only where they are more than a sequence holds."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary_path)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                rows = []
                for doc, data in zip(batch.column("id").to_pylist(), encoder.encode(texts_of(batch, "text")),
                                     strict=True):
                    ids = memoryview(data + end)
                    for piece, at in enumerate(range(0, len(ids), 4 * tokens)):
                        own = ids[at : at + 4 * tokens]
                        rows.append((doc, piece, at // 4, len(own) // 4, zlib.crc32(own)))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def pack(cut: DataFrame, capacity: Capacity | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; ``cut`` must be a stored table."""
    capacity = capacity or Capacity()
    shards = max(1, -(-cut.count() // shard_pieces))

    def place(key: tuple, group: pa.Table) -> pa.Table:
        # Rows arrive in any order; the result must be the same when a task is repeated.
        group = group.sort_by([(c, "ascending") for c in ("length", "ids_crc32", "doc_id", "start")]).drop_columns("shard")
        sequence, offset = best_fit(group["length"].to_numpy(), capacity)
        placed = pa.array(sequence + (key[0].as_py() << 32))
        return group.append_column("sequence_id", placed).append_column("offset", pa.array(offset))

    # By row, not by id: rows with one id are dealt to all shards.
    shard = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))
    return cut.withColumn("shard", shard).groupBy("shard").applyInArrow(place, PLACED)


def packed(docs: DataFrame, vocabulary_path: str, capacity: Capacity | None = None) -> DataFrame:
    capacity = capacity or Capacity()
    return pack(cut_lineage(pieces(docs, vocabulary_path, capacity.tokens), "pieces"), capacity)


def sequences(docs: DataFrame, placed: DataFrame, vocabulary_path: str) -> DataFrame:
    """The ids of each sequence in order: ``sequence_id``, ``ids``.

    For documents whose ids are unique and not null; a sequence is bounded by its capacity.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(vocabulary_path)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                data = encoder.encode(texts_of(batch, "text"))
                ids = [np.append(np.frombuffer(d, dtype="<u4"), END_ID).astype(np.int64) for d in data]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "doc_ids"]
                )

    texts = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(encode, "doc_id bigint, doc_ids array<bigint>")
    own = F.slice("doc_ids", (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    parts = placed.join(texts, "doc_id").select("sequence_id", F.struct("offset", own.alias("ids")).alias("part"))
    in_order = F.array_sort(F.collect_list("part"))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(in_order, lambda p: p["ids"])).alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLES: dict[str, str] = {}
