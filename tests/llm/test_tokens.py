"""Token counts, token files and packing against the tokenizer libraries and brute force."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

import __spark_entry__ as contract
from sumstead.llm import common, packing, token_counts, token_files
from sumstead.llm.tokens import PieceCounts, WordIds
from tests.llm.edge_rows import ROWS, edge_documents, no_documents

SF = "/root/testdata/sf0.001"
WORDS, MODEL = public_tokenizers.path(packing.VOCABULARY), public_tokenizers.path(token_counts.MODEL)
LIBRARY = Tokenizer.from_file(WORDS)
PIECES = SentencePieceProcessor(model_file=MODEL)
KNOWN_WORDS, KNOWN_PIECES = WordIds(WORDS), PieceCounts(MODEL)
TEXTS = st.text(st.one_of(st.sampled_from(" \n▁abEé.,'#!\t\xa0̈İΣ<|>/s0"), st.characters(codec="utf-8")), max_size=60)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_ids_and_counts_equal_the_libraries(text):
    assert np.frombuffer(KNOWN_WORDS.encode([text])[0], dtype="<u4").tolist() == ids_of(text)
    assert KNOWN_PIECES.count([text]) == [len(PIECES.encode(text))]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ▁\n", max_size=80), st.integers(2, 12))
def test_segments_keep_the_text_and_the_count(text, limit):
    parts = list(common.safe_segments(text, limit))
    assert "".join(parts) == text
    total = sum(len(PIECES.encode(p[1:] if n else p)) for n, p in enumerate(parts))
    assert total == len(PIECES.encode(text))


def test_special_strings_count_as_the_library_does():
    for text in ("a<|endoftext|>b c", "<|startoftext|>", "x <s> </s>"):
        assert np.frombuffer(KNOWN_WORDS.encode([text])[0], dtype="<u4").tolist() == ids_of(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(1, 100), st.data())
def test_blocks_round_trip_and_open_anywhere(values, percentile, data):
    image = token_files.Image.open(token_files.encode_blocks(np.array(values, dtype="<u4"), percentile))
    assert image.values().tolist() == values
    start = data.draw(st.integers(0, len(values)))
    stop = data.draw(st.integers(start, len(values)))
    assert image.values(start, stop).tolist() == values[start:stop]


def test_outliers_do_not_widen_a_block():
    plain = np.arange(128, dtype="<u4") % 16
    image = token_files.Image.open(token_files.encode_blocks(np.where(np.arange(128) == 5, 1 << 30, plain).astype("<u4")))
    assert image.widths.tolist() == [4] and image.places.tolist() == [5]


def test_token_counts(spark):
    rows = token_counts.token_counts(edge_documents(spark), MODEL).collect()
    found = sorted((tuple(r) for r in rows), key=repr)
    wanted = []
    for doc, text, _ in ROWS:
        n = len(PIECES.encode(text or ""))
        wanted.append((doc, len((text or "").encode()), n, n > 4096))
    assert found == sorted(wanted, key=repr)
    assert token_counts.token_counts(no_documents(spark), MODEL).count() == 0


def test_token_file(spark, tmp_path):
    token_files.write_token_file(edge_documents(spark), str(tmp_path / "a"), WORDS)
    found = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                   for r in token_files.read_token_file(spark, str(tmp_path / "a")).collect())
    ordered = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    wanted, start = [], 0
    for doc, text, _ in ordered:
        ids = [*ids_of(text), 2]
        wanted.append((start, doc, len(ids), crc(ids)))
        start += len(ids)
    assert found == wanted
    token_files.write_token_file(no_documents(spark), str(tmp_path / "b"), WORDS)
    assert token_files.read_token_file(spark, str(tmp_path / "b")).count() == 0


def check_packing(rows, docs, capacity):
    places = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity.tokens and len(own) <= capacity.documents
        assert sum(n * n for _, n in own) <= capacity.cost
    for doc, texts in docs.items():
        wanted = []
        for text in texts:
            ids = [*ids_of(text), 1]
            for piece, at in enumerate(range(0, len(ids), capacity.tokens)):
                own = ids[at : at + capacity.tokens]
                wanted.append((piece, at, len(own), crc(own)))
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc]) == sorted(wanted)
    assert len(by_doc) == len(docs)
    return len(places)


@pytest.mark.parametrize("capacity", [
    packing.Capacity(), packing.Capacity(documents=3), packing.Capacity(cost=4096 * 4096, weights=(1, 1, 1), score="dot"),
    packing.Capacity(tokens=512, documents=4, cost=512 * 512 // 1, score="norm"),
])
def test_packing_under_every_capacity(spark, capacity):
    docs = defaultdict(list)
    for doc, text, _ in ROWS:
        docs[doc].append(text)
    check_packing(packing.packed(edge_documents(spark), WORDS, capacity).collect(), docs, capacity)


def test_packing_an_empty_table(spark):
    assert packing.packed(no_documents(spark), WORDS).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=60), st.integers(1, 8), st.integers(3600, 9000), st.sampled_from(["norm", "dot"]))
def test_best_fit_keeps_capacities(lengths, documents, cost, score):
    capacity = packing.Capacity(60, documents, cost, (1.0, 0.5, 0.5), score)
    sequence, offset = packing.best_fit(np.array(lengths, dtype=np.int64), capacity)
    own = defaultdict(list)
    for s, o, n in zip(sequence.tolist(), offset.tolist(), lengths, strict=True):
        own[s].append((o, n))
    for items in own.values():
        assert len(items) <= documents and sum(n * n for _, n in items) <= cost
        assert [o for o, _ in sorted(items)] == [sum(n for _, n in sorted(items)[:i]) for i in range(len(items))]
        assert sum(n for _, n in items) <= 60


def test_documents_of_the_table_fill_sequences(spark):
    rows = contract.queries()["op2_best_fit_packing"](spark, SF).collect()
    docs = {r["doc_id"]: [r["text"]] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used = check_packing(rows, docs, packing.Capacity())
    assert used <= 1.02 * sum(r["length"] for r in rows) / 4096 + 1


def test_sequences_hold_the_ids(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i + 1)) for i in range(40)], "doc_id bigint, text string")
    placed = packing.packed(docs, WORDS, packing.Capacity(tokens=256, cost=256 * 256)).persist()
    rows = {r["sequence_id"]: r["ids"] for r in packing.sequences(docs, placed, WORDS).collect()}
    for r in placed.collect():
        assert crc(rows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]) == r["ids_crc32"]
