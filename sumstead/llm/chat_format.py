"""Operator 7: conversations as one text each, proved by parsing it back.

Grammar, with four control strings::

    conversation = { "<s>" role "[INST]" text "[/INST]" } "</s>"

The parser is deterministic: it cuts at every control string, so a rendering
is only read back right if no role or text holds one.  In roles and texts it
then takes one backslash out of what looks like an escaped control string.
Every conversation is first rendered as it is and parsed; where the turns that
come back differ from the source, its conflicting roles and texts are escaped
(one more backslash inside each control string, escaped or not) and it is
rendered and parsed again.  A rendering that still differs is an error.

Only built-in expressions are used.  A null role or text is an empty one.
Turns are ordered by turn, role and text, nulls first; repeated rows are
turns of their own; rows without a conversation id are one conversation.  An
empty table gives no rows; extra columns are left out.  A conversation is one
text and so one row: a task holds a whole conversation, and no more than one
at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import read_table
from sumstead.session import new_folder

OPEN, BODY, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
ASSISTANT = "assistant"
_CONTROL = r"</?s>|\[/?INST\]"
_ESCAPE = (r"([<\[])(\\*)(/?s>|/?INST\])", r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)(/?s>|/?INST\])", r"$1$2$3")
#: The conversation whose texts hold the control strings.
PROBE = "SELECT * FROM VALUES " + ", ".join(
    f"(-7L, {turn}L, '{role}', '</s>[INST] ok [/INST]')" for turn, role in enumerate(("user", ASSISTANT))
) + " AS t(conv_id, turn, role, text)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *_ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *_UNESCAPE)


def _turn(role: Column, text: Column) -> Column:
    return F.struct(role.alias("role"), text.alias("text"))


def render(turns: Column) -> Column:
    """The text of an array of (role, text)."""
    each = F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(BODY), t["text"], F.lit(CLOSE)))
    return F.concat(F.array_join(each, ""), F.lit(END))


def parse(formatted: Column) -> Column:
    """Turns of a rendering: cut at control strings, each turn is a gap, a role and a text; null if it isn't one."""
    def turns(cut: Column) -> Column:
        count = ((F.size(cut) - 2) / 3).cast("int")
        own = F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: _turn(unescape(F.get(cut, 3 * i + 1)), unescape(F.get(cut, 3 * i + 2))),
        )
        return F.when((F.size(cut) % 3 == 2) & (F.size(cut) > 2), own)

    # One element: the split is computed once and named inside the function.
    return F.get(F.transform(F.array(F.split(formatted, _CONTROL)), turns), 0)


def loss_spans(written: Column) -> Column:
    """Start (from 1) and length of each assistant text in the rendering of ``written``."""
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(seen: Column, turn: Column) -> Column:
        body = seen["at"] + F.length(turn["role"]) + len(OPEN + BODY)
        size = F.length(turn["text"])
        span = F.struct(body.alias("start"), size.alias("length"))
        spans = F.when(turn["role"] == ASSISTANT, F.array_append(seen["spans"], span)).otherwise(seen["spans"])
        return F.struct((body + size + len(CLOSE)).alias("at"), spans.alias("spans"))

    return F.aggregate(written, start, step)["spans"]


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted``, ``loss`` (spans of assistant texts), ``escaped``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct("turn", role.alias("role"), text.alias("text")).alias("row"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    source = grouped.select("conv_id", F.transform("rows", lambda r: _turn(r["role"], r["text"])).alias("source"))
    tried = source.withColumn("plain", render(F.col("source")))
    conflict = ~F.col("plain").isNotNull() | ~parse(F.col("plain")).eqNullSafe(F.col("source"))
    escaped = F.transform("source", lambda t: _turn(escape(t["role"]), escape(t["text"])))
    written = tried.withColumn("escaped", conflict).withColumn(
        "written", F.when(F.col("escaped"), escaped).otherwise(F.col("source"))
    )
    final = written.withColumn(
        "formatted", F.when(F.col("escaped"), render(F.col("written"))).otherwise(F.col("plain"))
    )
    # What was not escaped has been read back already.
    proved = (~F.col("escaped")) | parse(F.col("formatted")).eqNullSafe(F.col("source"))
    checked = F.when(proved, F.col("formatted")).otherwise(F.raise_error("a conversation isn't read back as it was"))
    return final.select("conv_id", checked.alias("formatted"), loss_spans(F.col("written")).alias("loss"), "escaped")


def digests(formatted: DataFrame) -> DataFrame:
    """What the written output holds, read from it alone."""
    parsed = formatted.withColumn("turns", parse(F.col("formatted"))).withColumn(
        "lost", F.array_join(F.transform("loss", lambda s: unescape(F.substring("formatted", s["start"], s["length"]))), "")
    )
    each = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return parsed.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(each, ""), 256).alias("turns_sha256"),
        F.length("lost").cast("bigint").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "chats")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    format_conversations(rows.unionByName(spark.sql(PROBE))).write.parquet(path)
    return digests(spark.read.parquet(path))


_SQL_ESCAPE = r"regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')"
ORACLE = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
    UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, r, t) FILTER (r = 'assistant'), '')) AS loss_sha256,
       CAST(4 + sum(16 + length({_SQL_ESCAPE.format("r")}) + length({_SQL_ESCAPE.format("t")})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""

QUERIES = {"op7_chat_format": op7_chat_format}
ORACLES = {"op7_chat_format": ORACLE}
