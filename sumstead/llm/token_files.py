"""Operator 4: token ids in patched frame-of-reference blocks, written in id order and read back.

A file is a table of segments; each row is one self-contained image.  An image
holds the ids of consecutive documents in blocks of BLOCK values.  A block
keeps its minimum and a width, the bits of its value at a percentile above
that minimum; the low bits of every value are packed at that width, and the
rest of the few larger values goes to the block's list of exceptions.  Where
each block starts is indexed, so a range of values is read without the rest.

A null text is an empty text, which still has its end id.  Documents with the
same id follow each other in the order of their texts; a null id comes first.
An empty table gives a file without rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table, texts_of
from sumstead.llm.tokens import word_ids
from sumstead.session import new_folder

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
BLOCK = 128
PERCENTILE = 90
SEGMENT_IDS = 1 << 18
_LANE = 64
_MAGIC = b"PFR1"
_HEAD = struct.Struct("<4sIQQQ")

SEGMENTS = (
    "part int, segment int, part_start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "image binary"
)
DOCUMENTS = "doc_id bigint, part int, part_offset bigint, n_tokens bigint, ids_crc32 bigint"


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(lanes: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values below 2**width as rows of ``width`` 64-bit words."""
    packed = np.zeros((width, len(lanes)), dtype=np.uint64)
    columns = np.ascontiguousarray(lanes.T).astype(np.uint64)
    for i in range(_LANE):
        word, shift = divmod(i * width, _LANE)
        packed[word] |= columns[i] << np.uint64(shift)
        if shift + width > _LANE:
            packed[word + 1] |= columns[i] >> np.uint64(_LANE - shift)
    return np.ascontiguousarray(packed.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.ascontiguousarray(words.T)
    lanes = np.empty((_LANE, rows.shape[1]), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(_LANE):
        word, shift = divmod(i * width, _LANE)
        value = rows[word] >> np.uint64(shift)
        if shift + width > _LANE:
            value |= rows[word + 1] << np.uint64(_LANE - shift)
        lanes[i] = value & mask
    return np.ascontiguousarray(lanes.T)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """The image of unsigned 32-bit values."""
    n = len(ids)
    blocks = -(-n // BLOCK)
    values = np.zeros(blocks * BLOCK, dtype=np.uint32)
    values[:n] = ids
    if n:
        values[n:] = ids[-1]
    values = values.reshape(blocks, BLOCK)
    least = values.min(axis=1) if blocks else np.zeros(0, dtype=np.uint32)
    above = values - least[:, None]
    at = min(BLOCK - 1, int(BLOCK * percentile / 100))
    widths = bit_lengths(np.partition(above, at, axis=1)[:, at]) if blocks else np.zeros(0, dtype=np.uint8)
    starts = np.zeros(blocks + 1, dtype=np.uint64)
    np.cumsum(widths.astype(np.uint64) * np.uint64(BLOCK // _LANE), out=starts[1:])
    packed = np.zeros(int(starts[-1]), dtype=np.uint64)
    for width in np.unique(widths[widths > 0]).tolist():
        rows = np.flatnonzero(widths == width)
        low = above[rows] & np.uint32((1 << width) - 1)
        words = _pack(low.reshape(-1, _LANE), width).reshape(len(rows), -1)
        packed[starts[rows].astype(np.int64)[:, None] + np.arange(words.shape[1])] = words
    high = above.astype(np.uint64) >> widths[:, None].astype(np.uint64)
    block, place = np.nonzero(high)
    first = np.searchsorted(block, np.arange(blocks + 1)).astype(np.uint32)
    head = _HEAD.pack(_MAGIC, BLOCK, n, len(packed), len(block))
    parts = (least, widths, starts, first, packed, place.astype(np.uint8), high[block, place].astype(np.uint32))
    return head + b"".join(p.tobytes() for p in parts)


@dataclass(frozen=True)
class Image:
    """An image opened for reading any of its blocks."""

    n: int
    least: np.ndarray
    widths: np.ndarray
    starts: np.ndarray
    first: np.ndarray
    packed: np.ndarray
    places: np.ndarray
    highs: np.ndarray

    @classmethod
    def open(cls, data: bytes) -> Image:
        magic, block, n, words, exceptions = _HEAD.unpack_from(data)
        if magic != _MAGIC or block != BLOCK:
            raise ValueError("not an image of this format")
        blocks, at, arrays = -(-n // BLOCK), _HEAD.size, []
        for kind, count in (("<u4", blocks), ("u1", blocks), ("<u8", blocks + 1), ("<u4", blocks + 1),
                            ("<u8", words), ("u1", exceptions), ("<u4", exceptions)):
            arrays.append(np.frombuffer(data, kind, count, at))
            at += arrays[-1].nbytes
        return cls(n, *arrays)

    def blocks(self, start: int, stop: int) -> np.ndarray:
        """The values of blocks ``start`` to ``stop``, found through the index."""
        values = np.zeros((stop - start, BLOCK), dtype=np.uint64)
        widths = self.widths[start:stop]
        for width in np.unique(widths[widths > 0]).tolist():
            rows = np.flatnonzero(widths == width)
            places = self.starts[start + rows].astype(np.int64)[:, None] + np.arange(width * BLOCK // _LANE)
            values[rows] = _unpack(self.packed[places].reshape(-1, width), width).reshape(len(rows), BLOCK)
        own = slice(int(self.first[start]), int(self.first[stop]))
        block = np.repeat(np.arange(stop - start), np.diff(self.first[start : stop + 1].astype(np.int64)))
        values[block, self.places[own]] |= self.highs[own].astype(np.uint64) << widths[block].astype(np.uint64)
        return (values + self.least[start:stop, None]).astype("<u4").reshape(-1)

    def values(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        stop = self.n if stop is None else min(stop, self.n)
        if start >= stop:
            return np.zeros(0, dtype="<u4")
        first = start // BLOCK
        return self.blocks(first, -(-stop // BLOCK))[start - first * BLOCK : stop - first * BLOCK]


def write_token_file(docs: DataFrame, path: str, vocabulary_path: str, id_column: str = "doc_id",
                     text_column: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of all documents in ascending order of their ids."""
    end = np.array([end_id], dtype="<u4").tobytes()

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = word_ids(vocabulary_path), TaskContext.get().partitionId()
        ids, lengths, parts, total, before, segment = [], [], [], 0, 0, 0

        def image() -> pa.RecordBatch:
            data = encode_blocks(np.frombuffer(b"".join(parts), dtype="<u4"))
            row = [[part], [segment], [before], [total], [ids], [lengths], [data]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()),
                     pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, k) for v, k in zip(row, kinds, strict=True)],
                ["part", "segment", "part_start", "n_ids", "doc_ids", "doc_lengths", "image"],
            )

        for whole in batches:
            for batch in by_bytes(whole, "text"):
                for doc, data in zip(batch.column("id").to_pylist(), encoder.encode(texts_of(batch, "text")),
                                     strict=True):
                    ids.append(doc)
                    parts.append(data + end)
                    lengths.append(len(parts[-1]) // 4)
                    total += lengths[-1]
                    if total >= SEGMENT_IDS:
                        yield image()
                        before, segment = before + total, segment + 1
                        ids, lengths, parts, total = [], [], [], 0
        if ids:
            yield image()

    rows = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).cast("string").alias("text"))
    ranged = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(segments, SEGMENTS).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the images alone: its place in the file, its ids' number and checksum."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = Image.open(row["image"]).values()
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                data = memoryview(ids.tobytes())
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array([row["part"]] * len(crc), pa.int32()),
                     pa.array(starts + row["part_start"], pa.int64()), pa.array(row["doc_lengths"], pa.int64()),
                     pa.array(crc, pa.int64())],
                    ["doc_id", "part", "part_offset", "n_tokens", "ids_crc32"],
                )

    table = spark.read.schema(SEGMENTS).parquet(path)
    # One row for each writing task: where its ids start in the whole file.
    parts = table.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.expr("sum(n) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    bases = parts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    read = table.select("part", "part_start", "doc_ids", "doc_lengths", "image").mapInArrow(documents, DOCUMENTS)
    return read.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("part_offset")).alias("start"), "n_tokens", "ids_crc32"
    )


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "tokens")
    write_token_file(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY))
    return read_token_file(spark, path)


QUERIES = {"op4_token_file": op4_token_file}
ORACLES: dict[str, str] = {}
