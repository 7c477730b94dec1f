"""The quality classifier: held-out accuracy, exact neighbours, edge rows."""

import zlib

import numpy as np
import pytest

import __spark_entry__ as contract
from sumstead.llm import quality_classifier as q
from tests.llm.edge_rows import ROWS, edge_documents, no_documents

SF = "/root/testdata/sf0.1"


def area(scores, labels):
    """Share of pairs of a good and a bad document in the right order."""
    good, bad = scores[labels == 1], np.sort(scores[labels == 0])
    below = np.searchsorted(bad, good, "left") + np.searchsorted(bad, good, "right")
    return below.sum() / (2 * len(good) * len(bad))


def test_held_out_documents(spark):
    found = contract.queries()["op3_quality_classifier"](spark, SF).toPandas()
    assert len(found) == 10_000 and found["score"].between(0, 1).all()
    assert (found["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found["doc_id"]]).all()
    assert (found["predicted"] == (found["score"] >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = found[found["held_out"]].merge(labels, on="doc_id")
    right = both["predicted"] == both["quality"]
    print("held-out area", area(both["score"].to_numpy(), both["quality"].to_numpy()), "right", right.mean())
    assert area(both["score"].to_numpy(), both["quality"].to_numpy()) >= 0.95
    assert right.mean() >= 0.95


def test_neighbours_are_exact():
    rng = np.random.default_rng(1)
    counts = rng.poisson(2, (300, q.TERMS)).astype(np.float32)
    weights = np.ones(q.TERMS, dtype=np.float32)
    axes = q.leading_axes(q.unit(np.log1p(counts)), 8)
    empty = q.Model(weights, axes, np.zeros((0, 8), dtype=np.float32), np.zeros(0))
    model = q.Model(weights, axes, empty.project(counts[:200]), rng.integers(0, 2, 200).astype(float))
    for row, score in zip(counts[200:], model.score(counts[200:]), strict=True):
        cosine = (model.project(row[None]) @ model.vectors.T)[0].astype(float)
        best = np.argsort(-cosine)[: q.NEIGHBOURS]
        weight = np.maximum(cosine[best], 1e-6) ** q.POWER
        assert score == pytest.approx((weight * model.labels[best]).sum() / weight.sum(), abs=1e-5)


def test_axes_are_singular_vectors():
    rows = np.random.default_rng(2).standard_normal((60, 40)).astype(np.float32) * np.linspace(9, 0.1, 40, dtype=np.float32) ** 2
    right = np.linalg.svd(rows)[2][:5]
    assert np.abs(right @ q.leading_axes(rows, 5)).round(2).tolist() == np.eye(5).tolist()


def test_edge_rows(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(n, i % 2) for i, n in enumerate([1, 2, 3, 4, 6, 7, 8, 9])] + [(None, 1), (1, 1), (9, None)],
                                   "doc_id bigint, quality int").selectExpr("*", "'x' AS text")
    model = q.fit(docs, labels)
    assert len(model.labels) <= 8 and 0.5 in model.labels  # document 1 has both labels
    rows = q.classify(docs, model).collect()
    assert sorted((r["doc_id"] for r in rows), key=repr) == sorted((r[0] for r in ROWS), key=repr)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert q.classify(no_documents(spark), model).count() == 0
    none = q.fit(docs, labels.where("false"))
    assert {r["score"] for r in q.classify(docs, none).collect()} == {0.5}
    assert len(q.fit(no_documents(spark), labels).labels) == 0


def test_labels_of_held_out_documents_are_not_read(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id bigint, text string")
    model = q.fit(docs, docs.selectExpr("doc_id", "CAST(crc32(CAST(CAST(doc_id AS string) AS binary)) % 5 = 0 AS int) AS quality"))
    assert len(model.labels) and not model.labels.any()
