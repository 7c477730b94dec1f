"""Substring dedup against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from sumstead.llm import suffix_dedup as s
from tests.llm.edge_rows import ROWS, edge_documents, no_documents


def brute(docs):
    least = {}
    for doc, text in docs:
        own = -(2**63) if doc is None else doc
        data = (text or "").encode()
        for i in range(len(data) - 49):
            string = data[i : i + 50]
            least[string] = min(own, least.get(string, own))
    out = []
    for doc, text in docs:
        own = -(2**63) if doc is None else doc
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for i in range(len(data) - 49):
            if least[data[i : i + 50]] < own:
                gone[i : i + 50] = True
        kept = bytes(b for b, g in zip(data, gone, strict=False) if not g)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, letters="abcdefghij é"):
    rng = random.Random(seed)
    parts = ["".join(rng.choice(letters) for _ in range(rng.randrange(20, 140))) for _ in range(12)] + ["a" * 120, "ab" * 60]
    docs = []
    for i in range(n):
        text = "".join(rng.choice(parts)[rng.randrange(10) :] if rng.random() < 0.5
                       else "".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(rng.randrange(6)))
        docs.append((i, text))
    return docs + [(n + i, docs[rng.randrange(n)][1]) for i in range(5)]


def found(frame):
    return sorted(map(tuple, s.dedup_strings(frame).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_made_documents(spark, seed):
    docs = made(seed, 80)
    random.Random(seed).shuffle(docs)
    assert found(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)) == brute(docs)


def test_many_buckets_and_shuffled_joins(spark, monkeypatch):
    monkeypatch.setattr(s, "BUCKET_BYTES", 500)
    monkeypatch.setattr(s, "BROADCAST_BYTES", 0)
    docs = made(7, 60)
    assert found(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)) == brute(docs)


def test_edge_rows(spark):
    short = [(d, t if t is None or len(t) < 10_000 else t[:4000]) for d, t, _ in ROWS]
    frame = edge_documents(spark).selectExpr("* EXCEPT (text)", "substring(text, 1, 4000) AS text")
    rows = short + [(20, "y" * 49), (21, "z" * 49 + "y" * 50)]
    extra = spark.createDataFrame(rows[-2:], "doc_id bigint, text string")
    assert found(frame.unionByName(extra, allowMissingColumns=True)) == brute(
        [(d, t[:4000] if t else t) for d, t in rows])
    assert found(no_documents(spark)) == []


def test_texts_of_one_id_are_told_apart(spark):
    """Two texts of one id whose hashes agree in the low 24 bits, as among thousands of rows with one id."""
    passage, seen, at = "".join(random.Random(4).choice("abcdefgh ") for _ in range(90)), {}, 0
    while True:  # with the passage at an even number, without at an odd one
        text = f"{at} {passage}" if at % 2 == 0 else f"{at} " + str(at) * 30
        other = seen.setdefault(xxhash.xxh64_intdigest(text.encode(), 42) & 0xFFFFFF, text)
        if (passage in text) != (passage in other):
            break
        at += 1
    docs = [(1, passage), (7, text), (7, other), (8, "some other text, also with a part of it: " + passage[:70])]
    rows = found(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert rows == brute(docs)


def test_long_texts_are_cut_into_pieces(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefghijklmnop ") for _ in range(3 * s._PIECE))
    docs = [(1, text), (2, "x" * 30 + text[s._PIECE - 500 : 2 * s._PIECE + 500] + "y" * 30), (3, text[:100])]
    rows = {r[0]: r for r in found(spark.createDataFrame(docs, "doc_id bigint, text string"))}
    assert rows[1][2] == 0 and rows[3][2:4] == (100, 1)
    assert rows[2][2:4] == (s._PIECE + 1000, 1)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=50, max_size=400), st.integers(0, 300))
def test_each_string_is_in_one_run_and_equal_ones_meet(data, shift):
    data = np.frombuffer(data + data, dtype=np.uint8)
    starts, stops, _, anchors, _ = s.runs(data, np.array([len(data)]))
    assert starts[0] == 0 and stops[-1] == len(data) - 49 and (starts[1:] == stops[:-1]).all()
    anchor = np.repeat(anchors, stops - starts)
    half = len(data) // 2
    assert (anchor[: half - 49] == anchor[half : half + half - 49]).all()


def test_query_equals_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    result = contract.queries()["op10_suffix_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, result), key=repr) == brute([tuple(r) for r in rows])
