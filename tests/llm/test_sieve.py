"""Rows picked and left out against plain sets, with sieves too small for their lists."""

import pytest

from sumstead.llm import sieve


@pytest.mark.parametrize("words", [sieve.SIEVE_WORDS, 1])
@pytest.mark.parametrize("every", [1, 3, 700, 10_000])
def test_only_and_without(spark, monkeypatch, words, every):
    monkeypatch.setattr(sieve, "SIEVE_WORDS", words)
    rows = spark.range(-500, 2000).selectExpr("id * 3 AS k", "id AS other")
    listed = spark.range(-400, 5000).where(f"id % {every} = 1 OR {every} = 1").selectExpr("id AS k")
    keys, held = {3 * i for i in range(-500, 2000)}, {r["k"] for r in listed.collect()}
    assert sorted(r["k"] for r in sieve.only(rows, listed, "k").collect()) == sorted(keys & held)
    parts = sieve.without(rows, listed, "k")
    assert sorted(r["k"] for p in parts for r in p.collect()) == sorted(keys - held)
    assert all(p.columns == rows.columns for p in [*parts, sieve.only(rows, listed, "k")])


def test_empty_list(spark):
    rows, none = spark.range(5).toDF("k"), spark.range(0).toDF("k")
    assert sieve.only(rows, none, "k").count() == 0
    assert [p.count() for p in sieve.without(rows, none, "k")] == [5]
