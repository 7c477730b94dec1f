"""Operator 3: quality by the votes of the nearest labelled documents.

A text becomes term counts: windows of three over the kinds of its bytes (runs
of one kind count once), pairs of its lower-cased bytes, and how long and how
repetitive it is.  Counts are damped by their logarithm and weighted by the
inverse frequency of the term over all documents.  Latent-semantic axes are the
leading singular vectors of the labelled texts.  The labelled vectors are
broadcast, cosine products with all of them are computed in blocks for every
document, and the NEIGHBOURS closest vote with their label, weighted by a power
of their similarity.

What is fitted is bounded: LABELLED_ROWS labelled documents at most, those with
the least hashes of their ids, whatever the size of the corpus.  Frequencies
come from every document.  Labels of held-out documents are never read.

A null text is an empty text and gets a score like any other.  Null ids are not
held out and keep their rows, as do repeated rows.  Extra columns are left out.
A document labelled more than once has its mean label.  Without any label every
score is 0.5.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import by_bytes, read_table

LABELLED_ROWS = 6000
NEIGHBOURS = 25
AXES = 64
POWER = 4
FOLDS = 5
THRESHOLD = 0.3
BLOCK_ROWS = 256
_KIND_TERMS, _PAIR_TERMS, _LEVELS = 2048, 1024, 16
TERMS = _KIND_TERMS + _PAIR_TERMS + 2 * _LEVELS
_PART_BYTES = 1 << 20

SCORES = "doc_id bigint, score double, predicted int"


def _kinds() -> np.ndarray:
    """Letters, digits and bytes beyond ASCII share a kind; blanks and marks stay what they are."""
    kind = np.arange(256, dtype=np.int64)
    kind[ord("a") : ord("z") + 1] = 1
    kind[ord("A") : ord("Z") + 1] = 2
    kind[ord("0") : ord("9") + 1] = 3
    kind[128:] = 1
    return kind


_KIND = _kinds()
_LOWER = np.arange(256, dtype=np.int64)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _level(share: float) -> int:
    return min(_LEVELS - 1, int(share * _LEVELS))


def term_counts(text: bytes) -> np.ndarray:
    """Counts of all terms; a long text is counted in parts, whose borders' windows are left out."""
    counts = np.zeros(TERMS, dtype=np.float32)
    data = np.frombuffer(text, dtype=np.uint8)
    for at in range(0, len(data), _PART_BYTES):
        part = data[at : at + _PART_BYTES]
        kinds = _KIND[part]
        kinds = kinds[np.flatnonzero(np.diff(kinds, prepend=-1))]
        windows = (kinds[:-2] * 31 + kinds[1:-1]) * 31 + kinds[2:]
        counts[:_KIND_TERMS] += np.bincount(windows * 40503 % 65521 % _KIND_TERMS, minlength=_KIND_TERMS)
        low = _LOWER[part]
        pairs = (low[:-1] * 256 + low[1:]) * 40503 % 65521 % _PAIR_TERMS
        counts[_KIND_TERMS : _KIND_TERMS + _PAIR_TERMS] += np.bincount(pairs, minlength=_PAIR_TERMS)
    words = text.split()
    distinct = len(set(words)) / max(1, len(words))
    # As heavy as the most frequent terms, so that they tell texts apart.
    weight = 50.0
    counts[_KIND_TERMS + _PAIR_TERMS + _level(np.log2(len(words) + 1) / 20)] = weight
    counts[_KIND_TERMS + _PAIR_TERMS + _LEVELS + _level(distinct)] = weight
    return counts


def _counts_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([term_counts(t.as_py() or b"") for t in batch.column("text")])


@dataclass(frozen=True)
class Model:
    """Weights of terms, axes, and the labelled vectors with their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        return unit(unit(np.log1p(counts) * self.weights) @ self.axes)

    def score(self, counts: np.ndarray) -> np.ndarray:
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        near = min(NEIGHBOURS, len(self.labels))
        own, scores = self.project(counts), np.empty(len(counts))
        for at in range(0, len(own), BLOCK_ROWS):
            cosine = own[at : at + BLOCK_ROWS] @ self.vectors.T
            best = np.argpartition(-cosine, near - 1, axis=1)[:, :near]
            weight = np.maximum(np.take_along_axis(cosine, best, axis=1), 1e-6).astype(np.float64) ** POWER
            scores[at : at + BLOCK_ROWS] = (weight * self.labels[best]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(scores, 0.0, 1.0)


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def leading_axes(rows: np.ndarray, axes: int = AXES) -> np.ndarray:
    """Leading right singular vectors, by subspace iteration from a fixed start."""
    axes = min(axes, *rows.shape)
    start = np.random.default_rng(7).standard_normal((rows.shape[1], min(axes + 16, *rows.shape))).astype(np.float32)
    basis = np.linalg.qr(start)[0]
    for _ in range(6):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    right = np.linalg.svd(rows @ basis, full_matrices=False)[2]
    return (basis @ right.T)[:, :axes].astype(np.float32)


def _texts(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    text = F.col(text_column).cast("string").cast("binary").alias("text")
    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), text)


def term_weights(texts: DataFrame) -> np.ndarray:
    """Inverse frequencies of all terms over all documents; TERMS rows reach the driver."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(TERMS + 1, dtype=np.int64)
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                seen[:TERMS] += (_counts_of(batch) > 0).sum(axis=0)
                seen[TERMS] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TERMS + 1)), pa.array(seen)], ["term", "n"])

    rows = texts.mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    seen = np.zeros(TERMS + 1)
    for row in rows:
        seen[row["term"]] = row["n"]
    return np.log((1 + seen[TERMS]) / (1 + seen[:TERMS])).astype(np.float32) + 0.1


def fold(id_column: str) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % FOLDS


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
        text_column: str = "text", labelled_rows: int = LABELLED_ROWS) -> Model:
    """A model from the labels of documents that are not held out."""
    texts = _texts(docs, id_column, text_column)
    known = labels.where(F.col(label).isNotNull() & (fold(id_column) != 0)).groupBy(
        F.col(id_column).cast("bigint").alias("doc_id")).agg(F.avg(label).alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                counts = [c.astype("<f4").tobytes() for c in _counts_of(batch)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"),
                                                  pa.array(counts, pa.binary())], ["doc_id", "label", "counts"])

    # The chosen rows are bounded by labelled_rows; one document stands for repeated ones.
    found = texts.join(F.broadcast(chosen), "doc_id").mapInArrow(count, "doc_id bigint, label double, counts binary")
    rows = {}
    for row in found.toLocalIterator():
        if row["doc_id"] not in rows or row["counts"] < rows[row["doc_id"]][1]:
            rows[row["doc_id"]] = (row["label"], bytes(row["counts"]))
    weights = term_weights(texts)
    if not rows:
        nothing = np.zeros((0, 1), dtype=np.float32)
        return Model(weights, np.zeros((TERMS, 1), dtype=np.float32), nothing, np.zeros(0))
    ordered = [rows[doc] for doc in sorted(rows)]
    counts = np.frombuffer(b"".join(c for _, c in ordered), dtype="<f4").reshape(-1, TERMS)
    axes = leading_axes(unit(np.log1p(counts) * weights))
    plain = Model(weights, axes, np.zeros((0, axes.shape[1]), dtype=np.float32), np.zeros(0))
    return Model(weights, axes, plain.project(counts), np.array([label for label, _ in ordered]))


def classify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text",
             threshold: float = THRESHOLD) -> DataFrame:
    """Score of every row, and whether it reaches the threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_bytes(whole, "text"):
                scores = np.concatenate([
                    shared.value.score(_counts_of(batch.slice(at, BLOCK_ROWS)))
                    for at in range(0, batch.num_rows, BLOCK_ROWS)
                ])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))],
                    ["doc_id", "score", "predicted"],
                )

    return _texts(docs, id_column, text_column).mapInArrow(score, SCORES)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "quality"))
    held_out = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return classify(docs, model).select("doc_id", held_out, "score", "predicted")


QUERIES = {"op3_quality_classifier": op3_quality_classifier}
ORACLES: dict[str, str] = {}
