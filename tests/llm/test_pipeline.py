"""The pipeline against brute force, stage by stage."""

import numpy as np
import pytest

import __spark_entry__ as contract
import corpus_pipeline as pipeline
from sumstead.llm import decontaminate, packing
from tests.llm.edge_rows import edge_documents
from tests.llm.test_line_dedup import BLANKS, brute
from tests.llm.test_native import counts
from tests.llm.test_near_copies import brute as without_near_copies
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"


def good(text):
    words, chars, symbols, dup_lines, repeated = counts(text)
    lines = [x for x in (text or "").split("\n") if x.strip(BLANKS)]
    capitals = sum(c.isupper() for c in text or "")
    return not (words < 50 or 2 * repeated > words or 100 * symbols > 30 * words or 2 * (text or "").count("!") > words
                or 2 * capitals > chars or chars < 2 * words or chars > 20 * words or 2 * dup_lines > len(lines))


def expected(docs, items):
    docs = [(d, t) for d, t in docs if good(t)]
    yield docs
    left = brute(docs)
    docs = [(d, left[d]) for d, t in docs if left[d] == t or left[d].strip(BLANKS)]
    yield docs
    kept = set(without_near_copies(docs))
    docs = [(d, t) for d, t in docs if d in kept]
    yield docs
    # Every item against every text that has enough of its words; align() itself is tested cell by cell elsewhere.
    block = decontaminate.Block.of([(None, decontaminate.words_of(t)) for t in items])
    clean = []
    for doc, text in docs:
        numbers = block.hits(text)[0]
        there = np.bincount(numbers, minlength=len(block.words) + 1)
        may = (i for i in block.items if len(i) >= 3 and decontaminate.MATCH * np.minimum(
            np.bincount(i, minlength=len(there)), there).sum() >= 1.2 * len(i))
        if not any(decontaminate.align(i, numbers)[0] >= 1.2 * len(i) for i in may):
            clean.append((doc, text))
    yield clean


def test_stages_equal_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs, columns = table, table.columns
    for (name, stage), wanted in zip(pipeline.STAGES[:-1], expected(
            [(r["doc_id"], r["text"]) for r in table.collect()], items), strict=True):
        docs = pipeline.cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns, name
        rows = docs.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(wanted), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows), name
    rows = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, {d: [t] for d, t in wanted}, packing.Capacity())
    whole = contract.queries()["pipeline"](spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted(
        (r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


@pytest.mark.parametrize("number", range(5))
def test_stages_take_edge_rows(spark, number):
    docs = edge_documents(spark).selectExpr("*", "'en' AS lang", "'s' AS source", "10L AS n_chars")
    name, stage = pipeline.STAGES[number]
    found = stage(spark, docs, SF)
    if number < 4:
        assert found.columns == docs.columns
    assert number == 0 or found.count() > 0
    assert stage(spark, docs.where("false"), SF).count() == 0
