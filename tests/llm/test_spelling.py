"""Spelling variants against all pairs of words."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as contract
from sumstead.llm import spelling_variants as v
from tests.llm.edge_rows import ROWS, edge_documents, no_documents

SF = "/root/testdata/sf0.001"


def slow_counts(docs):
    counts = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def shortened(word):
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and a in shortened(b)


def slow_rows(docs):
    counts = slow_counts(docs)
    # Words one edit apart share a shortened form or one is the other's: fewer pairs to look at than all.
    met = {}
    for w in counts:
        for s in shortened(w) | {w}:
            met.setdefault(s, []).append(w)
    near = {w: set() for w in counts}
    for group in met.values():
        for a, b in itertools.combinations(group, 2):
            if is_near(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda o: (-counts[o], o))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), counts[form[w]] if w in form else None) for w, n in counts.items())


def fast_rows(frame, **sizes):
    return sorted(map(tuple, v.variants(frame, **sizes).collect()))


def made(seed, alphabet, n=400, size=6):
    rng = random.Random(seed)
    stems = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(4, size + 3))) for _ in range(n)]
    return [(i, " ".join(rng.choice(stems[: 1 + int(rng.paretovariate(0.4)) % n]) for _ in range(80))) for i in range(150)]


@pytest.mark.parametrize(("seed", "alphabet", "cell"), [(1, "abc", 10**6), (2, "abcdeé", 40), (3, "aÀÿbZ", 15), (4, "ab", 5)])
def test_variants_equal_all_pairs(spark, seed, alphabet, cell):
    docs = made(seed, alphabet)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert fast_rows(frame, cell_words=cell) == slow_rows(docs)


def test_chains_lead_to_their_last_form(spark):
    chain = ["abcde", "abcdef", "abcdefg", "abcdefgh", "abcdefghi", "abcdefghij"]
    docs = [(i, " ".join(w for k, w in enumerate(chain) for _ in range(3 * 2**k))) for i in range(2)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    rows = fast_rows(frame)
    assert rows == slow_rows(docs) and {r[2] for r in rows} == {"abcdefghij"}


def test_edge_rows(spark):
    docs = [(d, f"{t or ''} lengthy lengthy lengthy lengthi lengthi lengthi" if t else t) for d, t, _ in ROWS]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr(
        "doc_id", "text", "1 AS word", "2 AS n", "3 AS form", "4 AS cell", "5 AS length", "6 AS role")
    assert fast_rows(frame) == slow_rows(docs)
    assert fast_rows(edge_documents(spark)) == slow_rows([r[:2] for r in ROWS])
    assert fast_rows(no_documents(spark)) == []


def test_long_texts_are_cut_between_words(monkeypatch):
    text = " ".join(["some", "wordé", "x" * 70, "1", ""] * 30)
    whole = v.words_of(7, text)
    monkeypatch.setattr(v, "PART_CHARS", 11)
    assert len(list(v._parts(text))) > 50 and v.words_of(7, text) == whole


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 150), st.integers(2, 7), st.sampled_from([1, 4, 32]))
def test_searches_find_all_pairs(seed, n, size, leaf):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcÿ") for _ in range(size + rng.randrange(2))) for _ in range(n)}
    points = sorted(w for w in words if len(w) == size + 1)
    queries = [(w, v.SAME) for w in points] + [(w, v.LONGER) for w in words if len(w) == size]
    rows = [*points, *(w for w, _ in queries)]
    roles = np.array([v.POINT] * len(points) + [r for _, r in queries])
    before, v.LEAF = v.LEAF, leaf
    try:
        left, right = v.near_in_cell(rows, np.ones(len(rows)), roles)
    finally:
        v.LEAF = before
    found = sorted((rows[i], rows[j]) for i, j in zip(left.tolist(), right.tolist(), strict=True))
    assert found == sorted((a, b) for a, role in queries for b in points if is_near(a, b) and (role == v.LONGER or a < b))
    for role in (v.SAME, v.LONGER):
        own = [w for w, r in queries if r == role]
        assert [(own[i], points[j]) for i, j in v.by_shortened(own, points, role)] == [
            (a, b) for a in own for b in points if is_near(a, b) and (role == v.LONGER or a < b)]


def test_query_equals_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, contract.queries()["op12_spelling_variants"](spark, SF).collect())) == slow_rows(docs)
