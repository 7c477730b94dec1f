"""Alignments and matches against a plain table of all cells, for every document and item."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from sumstead.llm import decontaminate as d
from tests.llm.edge_rows import edge_documents, no_documents

SF = "/root/testdata/sf0.001"


def slow_score(item, words):
    row, best = [0] * (len(words) + 1), 0
    for x in item:
        new = [0]
        for j, y in enumerate(words, 1):
            new.append(max(0, row[j - 1] + (2 if x == y else -1), row[j] - 2, new[-1] - 2))
        row, best = new, max(best, *new)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=15), st.lists(st.integers(0, 5), max_size=25))
def test_alignment_score(item, words):
    score, first, last = d.span(np.array(item, dtype=np.int64), np.array(words, dtype=np.int64))
    assert score == slow_score(item, words)
    if score:
        assert slow_score(item, words[first : last + 1]) == score


def edited(rng, words, rate):
    out = []
    for w in words:
        kind = rng.random()
        if kind < rate:
            out += rng.choice([[], [rng.choice("pqrs")], [w, rng.choice("pqrs")]])
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("block_words", [d.BLOCK_WORDS, 60])
def test_matches_equal_brute_force(spark, block_words):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, [rng.choice(vocabulary) for _ in range(rng.randrange(10, 40))]) for i in range(12)]
    docs = []
    for n in range(250):
        own = [rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        if n % 3:
            own += edited(rng, rng.choice(items)[1], rng.random() * 0.5)
        docs.append((n, own + [rng.choice(vocabulary) for _ in range(rng.randrange(30))]))
    frame = spark.createDataFrame([(n, " ".join(w).title() + ".") for n, w in docs], "doc_id bigint, text string")
    table = spark.createDataFrame([(n, ", ".join(w)) for n, w in items], "item_id bigint, text string")
    found = d.contaminated(frame, table, block_words=block_words).collect()
    wanted = {(n, i): slow_score(item, words) / (2 * len(item)) for n, words in docs for i, item in items}
    wanted = {pair: score for pair, score in wanted.items() if score >= d.MIN_SCORE}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == wanted and len(wanted) > 20
    kept = {r["doc_id"] for r in d.clean(frame, table, block_words=block_words).collect()}
    assert kept == {n for n, _ in docs} - {n for n, _ in wanted}


@pytest.mark.parametrize("min_score", [0.5, 0.6, 0.75, 1.0])
def test_short_items_equal_brute_force(spark, min_score):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, [rng.choice(vocabulary) for _ in range(1 + i % 12)]) for i in range(36)]
    docs = [(0, "so the quick red fox jumps far".split())]
    items.append((36, "the quick brown fox jumps".split()))
    for n in range(1, 300):
        own = edited(rng, rng.choice(items)[1], rng.random() * 0.5)
        docs.append((n, [f"v{n}"] * rng.randrange(3) + own + [rng.choice(vocabulary) for _ in range(rng.randrange(4))]))
    frame = spark.createDataFrame([(n, " ".join(w)) for n, w in docs], "doc_id bigint, text string")
    table = spark.createDataFrame([(n, " ".join(w)) for n, w in items], "item_id bigint, text string")
    found = d.contaminated(frame, table, min_score).collect()
    wanted = {(n, i): slow_score(item, words) / (2 * len(item)) for n, words in docs for i, item in items}
    wanted = {pair: score for pair, score in wanted.items() if score >= min_score}
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in found} == wanted and len(wanted) > 100
    assert ((0, 36) in wanted) == (min_score <= 0.7)


def test_common_seeds_are_left_out():
    words = [f"w{i}" for i in range(40)]
    block = d.Block.of([(1, words)])
    rare = block.rarest({c: i for i, c in enumerate(block.codes.tolist())}, 0.6)
    assert len(block.codes) == 38 and len(rare.codes) == 38 - 5


def test_edge_rows(spark):
    docs = edge_documents(spark)
    items = spark.createDataFrame([(1, "Same TEXT here"), (1, "same text here"), (None, "the answer of a long text the answer of a"),
                                   (2, None), (3, ""), (4, "ab")], "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    found = sorted((r["doc_id"], r["item_id"] or 0, r["score"]) for r in d.contaminated(docs, items).collect())
    # Item 4 is one word, which document 6 holds.
    assert found == sorted([(5, 0, 1.0), (6, 4, 1.0)] + [(n, 1, 1.0) for n in (7, 7, 8)] * 2)
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    clashing = docs.selectExpr("doc_id", "text", "id AS _text", "id AS c1")
    assert d.clean(clashing, items).columns == clashing.columns and d.clean(clashing, items).count() == docs.count() - 5
    assert d.contaminated(no_documents(spark), items).count() == 0
    assert d.contaminated(docs, items.where("false")).count() == 0
    assert d.clean(docs, items.where("false")).count() == docs.count()


def test_query_finds_whole_items(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    found = {(r["doc_id"], r["item_id"]) for r in contract.queries()["op6_decontaminate"](spark, SF).collect()}
    held = {(r["doc_id"], i["item_id"]) for r in docs for i in items if i["text"] in r["text"]}
    words = {r["doc_id"]: d.words_of(r["text"]) for r in docs}
    own = {i["item_id"]: d.words_of(i["text"]) for i in items}
    assert held <= found
    assert all(slow_score(own[i], words[n]) >= 1.2 * len(own[i]) for n, i in found)
