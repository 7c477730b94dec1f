"""Near copies of the pipeline against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from sumstead.llm import near_copies as n
from tests.llm.edge_rows import ROWS, edge_documents, no_documents


def slow_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    """Ids that stay, by comparing all pairs."""
    sets = [slow_set(t) for _, t in docs]
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) > 0:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[find(i)] = min((doc is None, doc or 0), least.get(find(i), (True, 0)))
    return sorted((None if gone else doc for gone, doc in least.values()), key=repr)


def kept(frame):
    return sorted((r["doc_id"] for r in pipeline.drop_near_copies(frame.sparkSession, frame, "").collect()), key=repr)


def made(seed, size, share=0.6):
    """Texts with copies of them that have 0 to 12 of a hundred words replaced, and a passage that most hold."""
    rng = random.Random(seed)
    passage, docs = [f"p{i}" for i in range(20)], []
    for _ in range(size):
        if docs and rng.random() < share:
            words = list(rng.choice(docs))
            for _ in range(rng.randrange(1 + len(words) // 20)):
                words[rng.randrange(len(words))] = f"x{rng.random()}"
        else:
            words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(3, 150))] + passage * (rng.random() < 0.7)
        docs.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_stage_equals_the_similarity_of_all_pairs(spark, seed):
    docs = made(seed, 150)
    assert kept(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)) == brute(docs)


def test_copies_whose_fingerprints_differ_widely_go(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs = [(0, " ".join(words))]
    for i in range(1, 20):
        some = list(words)
        for at in rng.sample(range(0, 300, 10), 5):
            some[at] = f"y{i}"
        docs.append((i, " ".join(some)))
    assert kept(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs) == [0]


def test_a_group_of_copies_around_a_text_they_all_resemble(spark):
    words = [f"w{i}" for i in range(200)]
    docs = [(100, " ".join(words))]
    for i in range(40):  # similar to the text in the middle only
        some = list(words)
        for at in range(5 * (i % 20), 200, 60):
            some[at] = f"z{i}"
        docs.append((i, " ".join(some)))
    assert kept(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs)


def test_edge_rows(spark):
    frame = edge_documents(spark)
    assert pipeline.drop_near_copies(spark, frame, "").columns == frame.columns
    assert kept(frame) == brute([r[:2] for r in ROWS])
    assert kept(no_documents(spark)) == []
    clashing = frame.selectExpr("doc_id", "text", *[f"id AS {c}" for c in ("_n", "_h", "_g", "_text", "_row", "node", "key", "c1", "DOC")])
    assert kept(clashing) == kept(frame) and pipeline.drop_near_copies(spark, clashing, "").columns == clashing.columns


def test_similar_sets_share_a_first_shingle():
    rng = np.random.default_rng(1)
    for size in [*range(1, 40), 100, 333]:
        own = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        gone = len(own) // 9  # both sides lose as many: 0.8 at least
        a = np.sort(rng.permutation(own)[: len(own) - gone // 2])
        b = np.union1d(own, rng.integers(0, 1 << 63, gone // 2, dtype=np.uint64))
        if 9 * len(np.intersect1d(a, b)) >= 4 * (len(a) + len(b)):
            counts = rng.integers(0, 9, 1 + size // 2).astype(np.uint16)
            assert np.intersect1d(n.first_shingles(a, counts), n.first_shingles(b, counts)).size


def test_the_trees_link_before_the_exact_check(spark, monkeypatch):
    """Texts that differ in one word of many have one fingerprint or two that a tree links."""
    linked = []

    def spied(nodes, *more):
        found = trees(nodes, *more)
        linked.extend(tuple(r) for r in found.collect())
        return found

    trees = n.simhash_tree.links
    monkeypatch.setattr(n.simhash_tree, "links", spied)
    words = [f"w{i}" for i in range(3000)]
    docs = [(0, " ".join(words)), (1, " ".join([*words[:-1], "other"])), (2, " ".join(reversed(words)))]
    assert kept(spark.createDataFrame(docs, "doc_id bigint, text string")) == brute(docs) == [0, 2]
    prints = [n.simhash_tree.of_hashes([n.shingles(t.encode())]) for _, t in docs]
    assert prints[0] == prints[1] or {prints[0], prints[1]} in [set(e) for e in linked]


def test_the_order_of_shingles_counts_every_text(spark, monkeypatch):
    found = []

    def spied(texts, counts):
        found.append(counts)
        return keys(texts, counts)

    keys = n._keys
    monkeypatch.setattr(n, "_keys", spied)
    docs = [(i, f"w{i} a b c d e f") for i in range(9000)]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    assert pipeline.drop_near_copies(spark, frame, "").count() == 9000
    at = np.concatenate([n.shingles(t.encode()) for _, t in docs]) % np.uint64(n.COUNTERS)
    wanted = np.bincount(at.astype(np.int64), minlength=n.COUNTERS)
    assert wanted.max() >= 9000 and np.array_equal(found[0], wanted)


def test_counters_grow_with_what_they_count(spark, monkeypatch):
    """Batches of 50 texts: two tasks count 350 of a shingle each, more than a byte holds."""
    monkeypatch.setattr(n, "by_bytes", lambda batch, *_: (batch.slice(i, 50) for i in range(0, batch.num_rows, 50)))
    docs = [(i, f"a b c d e{i % 2} f") for i in range(1400)] + [(1400, None), (1401, " ")]
    texts = spark.createDataFrame(docs, "node bigint, _text string").repartition(2)
    wanted = np.bincount((np.concatenate([n.shingles((t or "").encode()) for _, t in docs]) % np.uint64(n.COUNTERS)).astype(np.int64),
                         minlength=n.COUNTERS)
    counts = n.shingle_counters(texts)
    assert counts.dtype == np.uint16 and np.array_equal(counts, wanted)
    assert not n.shingle_counters(texts.where("false")).any()
