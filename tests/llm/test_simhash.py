"""Fingerprints, links and components against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sumstead.llm import components
from sumstead.llm import simhash_tree as tree
from tests.llm.edge_rows import ROWS, edge_documents, no_documents

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """Component number of each value, by comparing all pairs."""
    values = np.array(fps, dtype=np.uint64)
    label = list(range(len(fps)))

    def find(i):
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4).tolist():
            a, b = find(i), find(i + 1 + j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def slow_rows(docs):
    fps = [slow_fingerprint(t) for _, t in docs]
    label = slow_components(fps)
    least = {}
    for (doc, _), own in zip(docs, label, strict=True):
        if doc is not None:
            least[own] = min(doc, least.get(own, doc))
    return sorted(((d, f"{f:016x}", least.get(c)) for (d, _), f, c in zip(docs, fps, label, strict=True)), key=repr)


def test_edge_rows(spark):
    found = tree.near_duplicates(edge_documents(spark)).collect()
    assert sorted(map(tuple, found), key=repr) == slow_rows([r[:2] for r in ROWS])
    assert tree.near_duplicates(no_documents(spark)).count() == 0
    assert tree.keep_one(no_documents(spark)).count() == 0


def test_one_row_of_each_group_stays(spark):
    docs = edge_documents(spark)
    kept = tree.keep_one(docs)
    assert kept.columns == docs.columns
    wanted = {c for *_, c in slow_rows([r[:2] for r in ROWS])}
    rows = [r["doc_id"] for r in kept.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    found = contract.queries()["op8_simhash_tree"](spark, SF).collect()
    assert sorted(map(tuple, found), key=repr) == slow_rows(docs)


def flipped(value, bits):
    for b in bits:
        value ^= 1 << b
    return value


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 120), st.integers(1, 16))
def test_a_tree_connects_what_is_within_the_radius(seed, n, spread):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    values = list({flipped(rng.choice(centres), [rng.randrange(spread * 4) for _ in range(rng.randrange(5))]) for _ in range(n)})
    label = list(range(len(values)))
    place = {v: i for i, v in enumerate(values)}

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    links = tree.shard_links(values)
    assert all((a ^ b).bit_count() <= 4 for a, b in links) and len(links) < len(values)
    for a, b in links:
        x, y = find(place[a]), find(place[b])
        label[max(x, y)] = min(x, y)
    assert [find(i) for i in range(len(values))] == slow_components(values)


@pytest.mark.parametrize("agree", [1, 2, 3, 4])
def test_close_values_share_a_shard(agree):
    rng = random.Random(agree)
    masks = tree.masks(4 + agree, agree)
    for _ in range(500):
        value = rng.getrandbits(64)
        other = value ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(value & m == other & m for m in masks)


def test_more_values_are_dealt_by_more_bits():
    chosen = [tree.block_choice(10**n)[1] for n in range(3, 12)]
    assert chosen == sorted(chosen) and chosen[0] == 2 and chosen[-1] > 3


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 2000 + i) for i in range(300)]
    rows = [*path, *star, (7, 7), (1, 0)]
    found = components.roots(spark.createDataFrame(rows, "a bigint, b bigint")).collect()
    assert {r["node"]: r["root"] for r in found} == {**{i: 0 for i in range(1, 61)}, **{2000 + i: 1000 for i in range(300)}}
    assert components.roots(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    docs = [(i, " ".join([*words[:-1], f"x{i}"])) for i in range(600)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(map(tuple, tree.near_duplicates(frame).collect()), key=repr) == slow_rows(docs)
    assert tree.keep_one(frame).count() == len({c for *_, c in slow_rows(docs)})
    assert tree.near_duplicates(frame).select(F.countDistinct("component_id")).first()[0] < 20
