"""Line dedup against brute force over all pairs of lines."""

import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from sumstead.llm import line_dedup as d
from tests.llm.edge_rows import edge_documents, no_documents

BLANKS = " \t\n\x0b\x0c\r"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def at_most_one(a, b):
    """Whether ``distance`` is one at most, told from the first difference: brute force has millions of pairs."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def test_at_most_one_is_a_distance():
    rng = random.Random(4)
    for _ in range(4000):
        a, b = ([rng.choice("ab") for _ in range(rng.randrange(6))] for _ in range(2))
        assert at_most_one(a, b) == (distance(a, b) <= 1)


def brute(docs):
    """docs: (id, text), ids unique; the texts that are left."""
    earlier, out = [], {}
    for doc, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        kept = []
        for line in (text or "").split("\n"):
            words = line.split(" ")
            if line.strip(BLANKS):
                gone = any(words == e or (min(len(words), len(e)) >= d.MIN_WORDS and at_most_one(words, e)) for e in earlier)
                earlier.append(words)
                if gone:
                    continue
            kept.append(line)
        out[doc] = None if text is None else "\n".join(kept)
    return out


def made(seed, n):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(12))) for _ in range(25)]
    docs = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(6)):
            words = rng.choice(lines).split(" ")
            if rng.random() < 0.6:
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [[], ["zz"], ["y"]][rng.randrange(3)]
            own.append(" ".join(words))
        docs.append((i, "\n".join(own)))
    return docs


@pytest.mark.parametrize("seed", range(3))
def test_made_documents(spark, seed):
    docs = made(seed, 60)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5)
    found = d.dedup_lines(frame).collect()
    assert {r["doc_id"]: r["text"] for r in found} == brute(docs)
    removed = sum(r["n_removed"] for r in found)
    assert removed == sum(len(t.split("\n")) - len(brute(docs)[i].split("\n")) + (brute(docs)[i] == "" and r["n_removed"] == len(t.split("\n")))
                          for (i, t), r in zip(docs, sorted(found, key=lambda r: r["doc_id"]), strict=True))


def test_large_sides_are_shuffled_to_the_same_result(spark, monkeypatch):
    docs = made(9, 50)
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    found = d.dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in found} == brute(docs)


def test_edge_rows(spark):
    docs = edge_documents(spark)
    found = d.dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_removed"] and found.count() == docs.count()
    texts = {(r["doc_id"], r["text"]) for r in found.collect()}
    assert {(2, None), (3, ""), (4, " \n\t "), (7, "same text here"), (8, "")} <= texts
    assert d.dedup_lines(no_documents(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), st.lists(st.sampled_from("abc"), min_size=1, max_size=8))
def test_one_edit(a, b):
    near = distance(a, b) <= 1
    assert d.within_one_edit(a, b) == near
    (whole_a, without_a), (whole_b, without_b) = d.variants(a), d.variants(b)
    met = (whole_a == whole_b or np.uint64(whole_a) in without_b or np.uint64(whole_b) in without_a
           or (len(a) == len(b) and (without_a == without_b).any()))
    assert met == near


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, sf):
    database = duckdb.connect()
    database.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    frame = contract.queries()["op1_line_dedup"](spark, f"/root/testdata/{sf}")
    wanted = database.execute(f"SELECT {', '.join(frame.columns)} FROM ({contract.oracle_sql()['op1_line_dedup']})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(wanted)
