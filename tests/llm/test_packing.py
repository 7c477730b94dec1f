"""Where pieces go: against a plain best fit, and with ids that floats can't hold."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sumstead.llm import packing


def slow_best_fit(lengths, capacity):
    """The sequence and offset of each piece: longest first, every sequence looked at."""
    most = (capacity.tokens, capacity.documents, capacity.cost)
    sequences, place = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need, best = (lengths[i], 1, lengths[i] ** 2), None
        for number, left in enumerate(sequences):
            rest = [a - b for a, b in zip(left, need, strict=True)]
            if min(rest) < 0:
                continue
            if capacity.score == "norm":
                score = sum(w * (r / m) ** 2 for w, r, m in zip(capacity.weights, rest, most, strict=True))
            else:
                score = sum(w * a * b / m**2 for w, a, b, m in zip(capacity.weights, left, need, most, strict=True))
            if best is None or score < best[0] - 1e-12:
                best = (score, number)
        if best is None:
            sequences.append(list(most))
            best = (0, len(sequences) - 1)
        left = sequences[best[1]]
        place[i] = (best[1], capacity.tokens - left[0])
        sequences[best[1]] = [a - b for a, b in zip(left, need, strict=True)]
    return [place[i] for i in range(len(lengths))]


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 120), st.sampled_from(["norm", "dot"]), st.integers(1, 9), st.sampled_from([1.0, 0.4]))
def test_each_piece_goes_where_it_fits_best(seed, n, score, documents, cost):
    rng = random.Random(seed)
    capacity = packing.Capacity(tokens=100, documents=documents, cost=int(10_000 * cost), score=score)
    lengths = [rng.randrange(1, 64) for _ in range(n)]
    sequence, offset = packing.best_fit(np.array(lengths, dtype=np.int64), capacity)
    assert list(zip(sequence.tolist(), offset.tolist(), strict=True)) == slow_best_fit(lengths, capacity)


@pytest.mark.parametrize("shard", [2, 1000])
def test_ids_stay_as_they_are(spark, shard):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**63), 2**63 - 1, None, 5]
    rows = [(i, 0, 0, 10 + n, 7) for n, i in enumerate(ids)]
    cut = packing.cut_lineage(spark.createDataFrame(rows, packing.PIECES))
    placed = packing.pack(cut, shard_pieces=shard).collect()
    assert sorted(((r["doc_id"], r["length"]) for r in placed), key=repr) == sorted(((i, 10 + n) for n, i in enumerate(ids)), key=repr)
    assert packing.pack(cut.where("false")).count() == 0
