"""Texts that come as bytes are handled like the same texts as strings."""

import pytest

from sumstead.llm import decontaminate, near_copies

ITEM = "one two three four five six seven eight nine ten eleven twelve"
TEXTS = [ITEM + " x", ITEM + " x", "other words " + ITEM, "nothing of that kind is here", None, ""]


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_bytes_are_texts(spark, kind):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").selectExpr(
        "doc_id", f"CAST(text AS {kind}) AS text", "doc_id AS _text")
    items = spark.createDataFrame([(0, ITEM)], "item_id bigint, text string")
    for frame, kept in ((near_copies.keep_one(docs), [0, 2, 3, 4]), (decontaminate.clean(docs, items), [3, 4, 5])):
        assert frame.schema == docs.schema
        rows = sorted(frame.collect())
        assert [r["doc_id"] for r in rows] == kept == [r["_text"] for r in rows]
        assert [bytes(r["text"]).decode() if isinstance(r["text"], (bytes, bytearray)) else r["text"] for r in rows] == [TEXTS[n] for n in kept]
