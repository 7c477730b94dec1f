"""Bit-plane clusters against plain arithmetic on whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumstead.llm import bitplane_clusters as b

SCHEMA = "vec_id bigint, embedding array<double>, planes string, norm int, cluster string"


def slow_rows(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((r for r in kept if r[0] is not None), key=lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest())
    centroids = [v for _, v in (first + [r for r in kept if r[0] is None])[:k]]

    def nearest(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(x) for x in zip(*groups[n], strict=True)] if n in groups else c
                     for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, v in kept]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(x for _, x, m in found if m == n), sum(x for _, x, _ in found), digests[n])
                   for i, d, n in found), key=repr)


def run(spark, rows, **more):
    frame = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, b.clusters(frame, **more).collect()), key=repr)


def vectors(seed, n, size=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, size) for _ in range(64)] for _ in range(7)]
    return [(i, [x + rng.gauss(0, size / 3) for x in rng.choice(centres)]) for i in range(n)]


@pytest.mark.parametrize(("seed", "n", "size"), [(1, 300, 0.2), (2, 120, 3.0), (3, 9, 1.0), (4, 200, 3000.0)])
def test_clusters_equal_plain_arithmetic(spark, seed, n, size):
    rows = vectors(seed, n, size)
    assert run(spark, rows) == slow_rows(rows)


def test_edge_rows(spark):
    v = vectors(5, 40)
    rows = v + [(100, None), (101, []), (102, [0.5] * 63), (103, [0.5] * 65), (104, [0.5] * 63 + [None]),
                (105, [0.5] * 63 + [float("nan")]), (106, [float("-inf")] + [0.5] * 63), (107, [0.0] * 64), (108, [-0.0] * 64),
                (1, v[1][1]), (1, v[1][1]), (None, v[2][1]), (109, [-1e-300] * 64)] + [(200 + i, v[3][1]) for i in range(60)]
    assert run(spark, rows) == slow_rows(rows)


def test_none_is_left(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None), (2, [1.0])]) == []
    frame = spark.createDataFrame([], SCHEMA)
    assert b.clusters(frame).columns == [c.split()[0] for c in b.RESULT.split(", ")]


def test_ties_go_to_the_smaller_cluster(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63) for i in range(20)]
    assert run(spark, rows, k=4) == slow_rows(rows, k=4)


def test_components_that_are_too_large_stop_the_job(spark):
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(1, [1e9] * 64)])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 27), st.integers(1, 9), st.integers(0, 2**32))
def test_planes_give_products_and_sums(bits, n, seed):
    rng = np.random.default_rng(seed)
    v, c = (rng.integers(-(1 << bits) + 1, 1 << bits, (m, 64)) for m in (n, 3))
    planes = b.to_planes(v)
    assert (b.products(planes, b.to_planes(c)) == v @ c.T).all()
    assert (b.norms(planes) == (v * v).sum(axis=1)).all()
    assert (b.bit_sums(planes) == v.sum(axis=0)).all()
