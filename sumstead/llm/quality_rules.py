"""Operator 5: quality rules as a short-circuit cascade.

Each rule is a condition on a text and its words that rejects it.  Its cost
(seconds a row) and selectivity (share of rows rejected) are measured on a
sample of some SAMPLE_ROWS rows; the rules are then tried in order of
rejections per cost in one CASE, which leaves the rest alone once a rule
rejects.  The order changes the work, never the verdict.

Only built-in expressions are used.  Words are runs of characters other than
the six ASCII blanks.  A null text has no words; the base rejects it like any
text with few words.  Repeated rows and null ids are kept; extra columns stay.
An empty table gives no rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import let, read_table
from sumstead.session import cut_lineage

SAMPLE_ROWS = 2000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
_BLANKS = "\t\n\x0b\f\r"
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _BLANKS, " " * len(_BLANKS)), " "), "")


def symbol_count(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, SYMBOLS, ""))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, ""))


def lines_with_words(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(_NOT_BLANK))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(lines_with_words(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the text.

    Windows are sorted by their hashes; equal neighbours give the places of
    the repeated ones, and each place covers up to three words.
    """
    def of_places(places: Column) -> Column:
        steps = F.arrays_zip(places.alias("p"), F.slice(places, 2, F.size(places)).alias("q"))
        return F.aggregate(
            steps, F.lit(0), lambda n, s: n + F.least(F.lit(3), F.coalesce(s["q"] - s["p"], F.lit(3)))
        )

    def of_sorted(ordered: Column) -> Column:
        pairs = F.arrays_zip(F.slice(ordered, 1, F.size(ordered) - 1), F.slice(ordered, 2, F.size(ordered) - 1))
        equal = F.filter(pairs, lambda p: p["0"]["h"] == p["1"]["h"])
        places = F.flatten(F.transform(equal, lambda p: F.array(p["0"]["i"], p["1"]["i"])))
        return let(F.sort_array(F.array_distinct(places)), of_places)

    def of_hashes(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(same, F.lit(0)).otherwise(let(ordered, of_sorted))

    def of_words(w: Column) -> Column:
        n = F.size(w) - 2
        windows = F.arrays_zip(F.slice(w, 1, n), F.slice(w, 2, n), F.slice(w, 3, n))
        hashes = F.transform(windows, lambda z: F.xxhash64(z["0"], z["1"], z["2"]))
        return F.when(n < 2, F.lit(0)).otherwise(let(hashes, of_hashes))

    return let(words, of_words)


@dataclass(frozen=True)
class Rule:
    """``rejects`` takes the text and its words."""

    name: str
    rejects: Callable[[Column, Column], Column]


#: The base: too few words, or more than half of them in repeated windows.
BASE = (
    Rule("few_words", lambda text, words: F.size(words) < MIN_WORDS),
    Rule("repeated_words", lambda text, words: 100 * repeated_words(words) > 50 * F.size(words)),
)
#: The method's own rules.
RULES = (
    Rule("symbols", lambda text, words: 100 * symbol_count(text) > 30 * F.size(words)),
    Rule("shouting", lambda text, words: 100 * F.regexp_count(text, F.lit("!")) > 50 * F.size(words)),
    Rule("capitals", lambda text, words: 100 * F.regexp_count(text, F.lit(r"\p{Lu}")) > 50 * word_chars(words)),
    Rule("word_length", lambda text, words: (word_chars(words) < 2 * F.size(words)) | (word_chars(words) > 20 * F.size(words))),
    Rule("duplicate_lines", lambda text, words: let(
        lines_with_words(text), lambda lines: 2 * (F.size(lines) - F.size(F.array_distinct(lines))) > F.size(lines)
    )),
)


def _text(text_column: str) -> Column:
    return F.coalesce(F.col(text_column).cast("string"), F.lit(""))


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS, text_column: str = "text") -> DataFrame:
    """About ``rows`` texts, stored: what costs and selectivities are measured on."""
    share = min(1.0, rows / max(1, docs.count()))
    return cut_lineage(docs.select(_text(text_column).alias("text")).sample(share, 42), "sample")


def measure(sample: DataFrame, rules: tuple[Rule, ...]) -> dict[str, tuple[float, float]]:
    """Cost and share of rejected rows of each rule."""
    def run(rejects: Callable[[Column, Column], Column]) -> tuple[float, float]:
        verdict = let(words_of(F.col("text")), lambda w: rejects(F.col("text"), w))
        start = time.perf_counter()
        row = sample.agg(F.count_if(verdict).alias("n"), F.count(F.lit(1)).alias("all")).first()
        return time.perf_counter() - start, row["n"] / max(1, row["all"])

    nothing = min(run(lambda text, words: F.size(words) < 0)[0] for _ in range(2))
    found = {}
    for rule in rules:
        seconds, share = min(run(rule.rejects) for _ in range(2))
        found[rule.name] = (max(seconds - nothing, 1e-4), share)
    return found


def by_rejections_per_cost(rules: tuple[Rule, ...], measured: dict[str, tuple[float, float]]) -> tuple[Rule, ...]:
    return tuple(sorted(rules, key=lambda r: (-measured[r.name][1] / measured[r.name][0], measured[r.name][0], r.name)))


def first_failure(text: Column, words: Column, rules: tuple[Rule, ...]) -> Column:
    """Name of the first rule that rejects, null if none does."""
    found = F.lit(None).cast("string")
    for rule in reversed(rules):
        found = F.when(rule.rejects(text, words), F.lit(rule.name)).otherwise(found)
    return found


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = BASE + RULES, text_column: str = "text",
            sample_rows: int = SAMPLE_ROWS, verdict: str = "failed_rule") -> DataFrame:
    """Adds ``verdict``: the rule that rejects a row first, null for rows to keep."""
    ordered = by_rejections_per_cost(rules, measure(sample_of(docs, sample_rows, text_column), rules))
    text = _text(text_column)
    return docs.withColumn(verdict, let(words_of(text), lambda w: first_failure(text, w, ordered)))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", _text("text").alias("text"))
    ordered = by_rejections_per_cost(RULES, measure(sample_of(docs), RULES))
    text = F.col("text")
    base = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), word_chars(w).cast("bigint").alias("word_chars"),
        symbol_count(text).cast("bigint").alias("n_symbols"), duplicate_lines(text).cast("bigint").alias("n_dup_lines"),
        repeated_words(w).cast("bigint").alias("n_repeat_words"),
    ))
    rows = docs.select("doc_id", "text", base.alias("base")).select("doc_id", "text", "base.*")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The rest of the cascade runs only where the base has not rejected already.
    kept = F.when(failed, F.lit(False)).otherwise(
        let(words_of(text), lambda w: first_failure(text, w, ordered)).isNull()
    )
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"),
    )


ORACLE = r"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS t FROM documents),
split AS (
    SELECT row_id, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM texts
),
windows AS (
    SELECT row_id, unnest(range(1, greatest(len(w) - 1, 1))) AS i, w FROM split WHERE len(w) >= 3
),
keyed AS (SELECT row_id, i, {'a': w[i], 'b': w[i + 1], 'c': w[i + 2]} AS k FROM windows),
repeated AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, k) AS n FROM keyed) WHERE n > 1),
covered AS (
    SELECT row_id, CAST(count(DISTINCT place) AS BIGINT) AS n
    FROM (SELECT row_id, unnest([i, i + 1, i + 2]) AS place FROM repeated) GROUP BY row_id
),
base AS (
    SELECT s.row_id, doc_id, t, lines, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           coalesce(c.n, 0) AS n_repeat_words
    FROM split s LEFT JOIN covered c ON s.row_id = c.row_id
),
judged AS (
    SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           100 * n_symbols > 30 * n_words
           OR 100 * (length(t) - length(replace(t, '!', ''))) > 50 * n_words
           OR 100 * len(regexp_extract_all(t, '\p{Lu}')) > 50 * word_chars
           OR word_chars < 2 * n_words OR word_chars > 20 * n_words
           OR 2 * n_dup_lines > len(lines) AS rejected
    FROM base
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM judged
"""

QUERIES = {"op5_quality_rules": op5_quality_rules}
ORACLES = {"op5_quality_rules": ORACLE}
