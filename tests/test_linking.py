"""The alias index and its probes against all substrings of all names."""

import random
from collections import Counter

import pytest

from sumstead.operators import linking as li
from sumstead.session import cut_lineage


def parts(name):
    return {name[i:j] for i in range(len(name)) for j in range(i + 2, len(name) + 1)}


def slow_aliases(names):
    owners = Counter(p for key in names.values() for p in parts(key))
    return {(p, name) for name, key in names.items() for p in parts(key) if owners[p] == 1}


def slow_shortest(names):
    every = slow_aliases(names)
    known = {p for p, _ in every}
    return {(p, n) for p, n in every if not (parts(p) - {p}) & known}


def catalog(spark, names):
    return spark.createDataFrame(list(names.items()), "product string, product_key string").repartition(3)


def made(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé牛") for _ in range(rng.randrange(1, 9))) for _ in range(12)]
    names = {f"p{i}": "".join(rng.choice(words) for _ in range(rng.randrange(4))) for i in range(40)}
    return names | {"twin": "samekey", "other twin": "samekey", "one": "x", "none": "", "inner": "abcab", "outer": "zzabcabzz"}


@pytest.mark.parametrize("seed", range(3))
def test_aliases_equal_all_substrings(spark, seed, monkeypatch):
    if seed:
        monkeypatch.setattr(li, "FIRST_WINDOW", 2)
        monkeypatch.setattr(li, "WINDOW_GROWTH", 2)
    names = made(seed)
    positions = li.shared_lengths(catalog(spark, names))
    found = list(map(tuple, li.unique_aliases(positions).collect()))
    assert len(found) == len(set(found)) and set(found) == slow_aliases(names)
    found = list(map(tuple, li.shortest_aliases(positions).collect()))
    assert len(found) == len(set(found)) and set(found) == slow_shortest(names)


def test_long_names_deal_rows_in_proportion(spark):
    rng = random.Random(7)
    long = "".join(rng.choice("abcdefghij") for _ in range(500))
    names = {"long": long, "near": long[:230] + "X" + long[231:], "far": "".join(rng.choice("abcdefghij") for _ in range(500))}
    positions = li.shared_lengths(catalog(spark, names))
    shared = {r["product"]: r["_shared"] for r in positions.collect()}
    assert shared["long"][0] == 230 and shared["long"][231] == 269 and shared["long"][229] == max(
        n for n in range(1, 12) if any(long[229 : 229 + n] in k for p, k in names.items() if p != "long") or n == 1)
    far, rest = names["far"], names["long"] + "|" + names["near"]
    ends = {i: next((j for j in range(i + 2, 501) if far[i:j] not in rest), None) for i in range(500)}
    wanted = {far[i:j] for i, j in ends.items() if j and (ends.get(i + 1) is None or ends[i + 1] > j)}
    assert {a for a, p in map(tuple, li.shortest_aliases(positions).collect()) if p == "far"} == wanted


def test_nothing_to_index(spark):
    positions = li.shared_lengths(catalog(spark, {"a": ""}).where("false"))
    assert li.unique_aliases(positions).isEmpty() and li.shortest_aliases(positions).isEmpty()
    texts = spark.createDataFrame([("abc",)], "t string")
    assert li.question_matches(texts, "t", cut_lineage(li.shortest_aliases(positions))).isEmpty()


@pytest.mark.parametrize("bound", [None, 0])
def test_questions_and_phrases_find_their_names(spark, bound):
    names = made(5)
    rng = random.Random(1)
    keys = sorted(names.values())
    asked = {rng.choice(keys)[rng.randrange(3) :] + rng.choice("ab?") + rng.choice(keys)[: rng.randrange(9)] for _ in range(150)}
    asked |= set(keys) | {k[1:] for k in keys} | {"", "x", "zz"}
    texts = spark.createDataFrame([(t,) for t in sorted(asked)] * 2, "t string")
    positions = li.shared_lengths(catalog(spark, names))
    shortest = cut_lineage(li.shortest_aliases(positions))
    every = slow_aliases(names)
    found = {r["t"]: (r["match_count"], r["matched"]) for r in li.question_matches(texts, "t", shortest, bound).collect()}
    wanted = {}
    for t in asked:
        own = {n for a, n in every if a in t}
        if own:
            wanted[t] = (len(own), min(own))
    assert found == wanted
    owners = Counter(names.values())
    whole = {k: n for n, k in names.items() if owners[k] == 1}
    by_part = dict(every)
    found = {r["t"]: r["_by_phrase"] for r in li.phrase_products(texts, "t", positions, shortest, bound).collect()}
    assert found == {t: whole.get(t, by_part.get(t)) for t in asked if t in whole or t in by_part}


def test_filters_leave_little_beside_matches(spark):
    names = {f"n{i}": "".join(random.Random(i).choice("abcdefghijklmnop") for _ in range(30)) for i in range(200)}
    shortest = cut_lineage(li.shortest_aliases(li.shared_lengths(catalog(spark, names))))
    texts = spark.createDataFrame([("".join(random.Random(-i).choice("abcdefghijklmnop") for _ in range(60)),) for i in range(1, 90)], "t string")
    known = {r["alias"] for r in shortest.collect()}
    found = [tuple(r) for r in li.alias_parts(texts, "t", shortest).collect()]
    wanted = [(t, p) for (t,) in texts.collect() for i in range(60) for j in range(i + 2, 61) if (p := t[i:j]) in known]
    assert sorted(p for p in found if p[1] in known) == sorted(wanted)
    assert len(found) <= len(wanted) + 89 * 60 // 4
