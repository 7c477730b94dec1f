"""Quality rules and chat formatting against brute force in plain Python."""

import hashlib
import re
from collections import Counter

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as contract
from sumstead.llm import chat_format as chat
from sumstead.llm import quality_rules as quality
from tests.llm.edge_rows import ROWS, edge_documents, no_documents

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = [
    "a b c a b c a b c x", "a a a a a", "one\n two\none\n\n \none", "a\x0bb\x0cc\rd\te\x85f g", "# * $ % & | < >", "a b", "a b a b a",
    "ÀÉ Ü ß " * 30, "STOP!! NOW!! " * 40, "w### " * 60, "line\n" * 60,
]


def counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    places = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum((text or "").count(c) for c in quality.SYMBOLS),
            len(lines) - len(set(lines)), len(places))


def columns(text="text"):
    words = quality.words_of(F.coalesce(F.col(text), F.lit("")))
    safe = F.coalesce(F.col(text), F.lit(""))
    return [F.size(words), quality.word_chars(words), quality.symbol_count(safe), quality.duplicate_lines(safe),
            quality.repeated_words(words)]


def test_counts_of_edge_texts(spark):
    texts = [(i, t) for i, t in enumerate([r[1] for r in ROWS] + EXTRA)]
    rows = spark.createDataFrame(texts, "i int, text string").select("i", "text", F.array(*columns()).alias("n")).collect()
    for row in rows:
        assert tuple(row["n"]) == counts(row["text"]), row["text"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab \n#", max_size=60), min_size=1, max_size=40))
def test_counts_of_any_text(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", F.array(*columns()).alias("n")).collect()
    assert all(tuple(r["n"]) == counts(r["text"]) for r in rows)


def test_cascade_has_the_same_verdict_in_any_order(spark):
    docs = edge_documents(spark).unionByName(
        spark.createDataFrame([(100 + i, t) for i, t in enumerate(EXTRA)], "doc_id bigint, text string"), allowMissingColumns=True)
    rules = quality.BASE + quality.RULES
    found = quality.cascade(docs, rules, sample_rows=10)
    assert found.columns == [*docs.columns, "failed_rule"]
    text = F.coalesce("text", F.lit(""))
    back = docs.withColumn("v", quality.let(quality.words_of(text), lambda w: quality.first_failure(text, w, rules[::-1])))
    key = lambda r: (repr(r["doc_id"]), repr(r["text"]))
    verdicts = [r["failed_rule"] is None for r in sorted(found.collect(), key=key)]
    assert verdicts == [r["v"] is None for r in sorted(back.collect(), key=key)]
    assert quality.cascade(no_documents(spark), rules).count() == 0


def test_order_is_rejections_per_cost():
    rules = tuple(quality.Rule(n, None) for n in "abc")
    ordered = quality.by_rejections_per_cost(rules, {"a": (1.0, 0.1), "b": (0.1, 0.05), "c": (0.1, 0.0)})
    assert [r.name for r in ordered] == ["b", "a", "c"]


def test_rules_keep_good_documents(spark):
    kept = contract.queries()["op5_quality_rules"](spark, "/root/testdata/sf0.01").select("doc_id", "kept", "base_failed")
    rows = kept.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r["kept"] or r["base_failed"] for r in rows if r["quality"] == 1]
    bad = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_native_queries_run_no_python(spark):
    for name in ("op5_quality_rules", "op7_chat_format"):
        plan = contract.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


CONVERSATIONS = [
    (1, 0, "user", "plain"), (1, 1, "assistant", "x <s> y"), (1, 2, None, None), (2, 1, "assistant", "second"), (2, 0, "user", "first"),
    (2, 0, "user", "first"), (None, 0, "user", "no id"), (3, None, "assistant", r"<\s> [\/INST] [\\INST] </s"), (3, 0, "a[INST]b", ""),
    (4, 0, "assistant", "[/INST]<s>user[INST]faked"), (5, 0, "assistant", ""), (6, 0, "user", "é日[INST]" * 50), (7, 0, "tool", "<</s>>"),
]


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, own in by.items():
        own.sort()
        lost = "".join(t for *_, r, t in own if r == "assistant")
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in own)
        out[conv] = (len(own), hashlib.sha256(whole.encode()).hexdigest(), len(lost), hashlib.sha256(lost.encode()).hexdigest())
    return out


def test_chats_round_trip(spark):
    frame = spark.createDataFrame(CONVERSATIONS, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS row", "2 AS source", "3 AS formatted")
    found = chat.format_conversations(frame)
    rows = chat.digests(found).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in rows} == brute(CONVERSATIONS)
    escaped = {r["conv_id"] for r in found.where("escaped").collect()}
    assert escaped == {1, 3, 4, 6, 7}
    assert chat.format_conversations(frame.where("false")).count() == 0


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 3), st.sampled_from(["user", "assistant", "<s>"]),
                          st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "/s>", "INST]", "a"]),
                                   max_size=7).map("".join)), min_size=1, max_size=40))
def test_any_control_strings_round_trip(spark, rows):
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    found = chat.digests(chat.format_conversations(frame)).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in found} == brute(rows)


@pytest.mark.parametrize("name", ["op5_quality_rules", "op7_chat_format"])
@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_queries_equal_their_sql(spark, name, sf):
    database = duckdb.connect()
    for table in ("documents", "conversations"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/{sf}/{table}.parquet'")
    frame = contract.queries()[name](spark, f"/root/testdata/{sf}")
    names = ", ".join(frame.columns)
    wanted = database.execute(f"SELECT {names} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, frame.collect())) == sorted(wanted)
