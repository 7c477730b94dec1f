"""Operator 1: line dedup through deletion neighbourhoods.

A line is removed if an earlier line equals it or, for lines of MIN_WORDS words
or more, is one edit away: one word replaced, inserted or deleted (words as cut
by single blanks).  Earlier means a smaller (document id, text hash, line
number); null ids come first.  Lines without a visible character are neither
removed nor compared.

Near lines meet in their deletion neighbourhoods: each line emits a hashed key
for every way to leave out one word.  Lines of one length that share the key of
the same place differ there at most, and a key that equals a whole line is one
word away from it, so a group needs a minimum, never its pairs; the word edit
distance of every removed line and its witness is then verified on the texts.
Only lines that share half of their words with another line can be near it, so
only these, found by counting hashes of halves, emit their neighbourhoods.

Equal lines collapse by map-side combined minima before anything else, so a
line that fills a third of the corpus is one row.  What is broadcast has a
counted size under BROADCAST_BYTES; beyond it the same joins are shuffled.

A null text stays null.  Rows with the same id and text are one document for
the order and are treated alike.  Extra columns stay as they are.  An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumstead.llm.common import let, read_table
from sumstead.session import cut_lineage

MIN_WORDS = 6
BROADCAST_BYTES = 24 << 20
_ROW_BYTES = 64
_BASE = 0x9E3779B97F4A7C15


def _bounded(rows: DataFrame, size: int) -> DataFrame:
    """Broadcast if its counted size is under the bound."""
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _lines(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """Lines with a visible character: place, two independent hashes and text."""
    text = F.col(text_column).cast("string")
    rows = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.xxhash64(text).alias("th"),
                       F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    seen = rows.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return seen.withColumns({"h": F.xxhash64("line"), "g": F.xxhash64(F.lit(1), "line")})


def _place() -> Column:
    return F.struct("doc", "th", "pos")


def _half_keys(words: Column) -> Column:
    """Hashes of both halves as cut in this line's length and in the length of one word less."""
    n = F.size(words)
    keys = []
    for base in (n, n - 1):
        half = F.floor(base / 2).cast("int")
        keys += [F.xxhash64(F.lit("left"), base, F.slice(words, 1, half)),
                 F.xxhash64(F.lit("right"), base, F.slice(words, n - (base - half) + 1, base - half))]
    return F.when(n >= MIN_WORDS, F.array(*keys))


def variants(words: list[str]) -> tuple[int, np.ndarray]:
    """Hash of a whole line and of the line without each of its words, in one pass."""
    n = len(words)
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), dtype=np.uint64, count=n)
    powers = np.full(n + 1, _BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    # Word i counts with the base to the power of its place, or of one less behind the gap.
    before = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:n])])
    moved = np.concatenate([[np.uint64(0)], np.cumsum(hashes[1:] * powers[: n - 1])])
    without = before[:n] + (moved[n - 1 :] - moved) + powers[n - 1 : n] * np.uint64(7)
    return int((before[n:] + powers[n:] * np.uint64(7))[0]), without


def within_one_edit(a: list[str], b: list[str]) -> bool:
    """Whether two word lists are at most one edit apart."""
    shorter, longer = sorted((a, b), key=len)
    same = 0
    while same < len(shorter) and shorter[same] == longer[same]:
        same += 1
    if same == len(longer):
        return True
    return shorter[same + (len(shorter) == len(longer)) :] == longer[same + 1 :]


def _neighbourhoods(lines: DataFrame) -> DataFrame:
    """One row for each word left out (place of the gap from 0) and one for the whole line (place -1)."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, line in enumerate(batch.column("line").to_pylist()):
                words = line.split(" ")
                whole, without = variants(words)
                keys = np.concatenate([np.array([whole], dtype=np.uint64), without]).view(np.int64)
                first = pa.array([batch.column("first")[i].as_py()] * len(keys), batch.schema.field("first").type)
                gap = pa.array(np.arange(-1, len(words), dtype=np.int32))
                length = pa.array(np.full(len(keys), len(words), dtype=np.int32))
                yield pa.RecordBatch.from_arrays([first, pa.array(keys), gap, length], ["first", "key", "gap", "n"])

    kind = lines.schema["first"].dataType.simpleString()
    return lines.select("first", "line").mapInArrow(emit, f"first {kind}, key bigint, gap int, n int")


def _links(near: DataFrame) -> DataFrame:
    """For each line with an earlier neighbour: its first place and such a neighbour's."""
    keyed = cut_lineage(_neighbourhoods(near), "neighbourhoods")
    whole, gap = F.col("gap") < 0, F.col("gap") >= 0
    # Least first places by key: of lines with this gap and length, of the whole line, of longer lines.
    same = keyed.where(gap).groupBy("key", "gap", "n").agg(F.min("first").alias("least"), F.count(F.lit(1)).alias("c"))
    replaced = keyed.where(gap).join(same.where("c > 1").drop("c"), ["key", "gap", "n"])
    longer = keyed.where(gap).groupBy("key").agg(F.min("first").alias("least"))
    shortened = keyed.where(whole).join(longer, "key")
    wholes = keyed.where(whole).select("key", F.col("first").alias("least"))
    lengthened = keyed.where(gap).join(wholes, "key")
    found = replaced.select("first", "least").union(shortened.select("first", "least"))
    found = found.union(lengthened.select("first", "least")).where("least < first")
    return found.groupBy("first").agg(F.min("least").alias("least"))


def _verified(links: DataFrame, near: DataFrame) -> DataFrame:
    """Links whose lines are one edit apart indeed."""
    own = near.select("first", "h", "g", F.col("line").alias("a"))
    other = near.select(F.col("first").alias("least"), F.col("line").alias("b"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
            right = pa.array([within_one_edit(a.split(" "), b.split(" ")) for a, b in pairs], pa.bool_())
            yield batch.select(["h", "g"]).filter(right)

    pairs = links.join(own, "first").join(other, "least").select("h", "g", "a", "b")
    return pairs.mapInArrow(check, "h bigint, g bigint")


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per document (``doc``, ``th``) with lines to remove: ``gone``, their numbers from 0."""
    lines = _lines(docs, id_column, text_column)
    halves = let(F.split("line", " "), _half_keys).alias("halves")
    equal = lines.select("h", "g", _place().alias("place"), halves).groupBy("h", "g").agg(
        F.min("place").alias("first"), F.count(F.lit(1)).alias("c"), F.first("halves").alias("halves")
    )
    distinct = cut_lineage(equal, "lines")
    keyed = distinct.where("halves IS NOT NULL").select("h", "g", "first", F.explode("halves").alias("half"))
    shared = keyed.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    candidates = cut_lineage(keyed.join(shared, "half").select("h", "g", "first").distinct(), "candidates")
    n = candidates.count()
    texts = lines.withColumn("first", _place()).select("first", "line").join(
        _bounded(candidates, n * _ROW_BYTES), "first").dropDuplicates(["first"])
    near = cut_lineage(texts, "near")
    gone = cut_lineage(_verified(_links(near), near).distinct(), "gone")
    repeated = distinct.where("c > 1").select("h", "g", "first").join(gone, ["h", "g"], "left_anti").unionByName(
        gone.withColumn("first", F.lit(None).cast(distinct.schema["first"].dataType)))
    table = cut_lineage(repeated, "repeated")
    return (
        lines.select("h", "g", "doc", "th", "pos").join(_bounded(table, table.count() * _ROW_BYTES), ["h", "g"])
        .where(F.col("first").isNull() | (F.col("first") != _place()))
        .groupBy("doc", "th").agg(F.collect_set("pos").alias("gone"))
    )


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                removed: str = "n_removed") -> DataFrame:
    """All rows and columns, the text without its removed lines, and how many were removed."""
    gone = cut_lineage(removed_lines(docs, id_column, text_column), "removed")
    size = gone.agg(F.sum(F.size("gone") * 4 + _ROW_BYTES)).first()[0] or 0
    own = gone.select(F.struct("doc", "th").alias("_own"), F.col("gone").alias("_gone"))
    text = F.col(text_column).cast("string")
    key = F.struct(F.col(id_column).cast("bigint").alias("doc"), F.xxhash64(text).alias("th"))
    left = F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_gone", i))
    joined = docs.withColumn("_key", key).join(_bounded(own, size), F.col("_key") == F.col("_own"), "left")
    return joined.withColumns({
        text_column: F.when(F.col("_gone").isNull(), text).otherwise(F.array_join(left, "\n")),
        removed: F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
    }).select(*docs.columns, removed)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    return dedup_lines(docs).select(
        "doc_id", "n_removed", F.length(text).cast("bigint").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256")
    )


_SQL_HALVES = """[
    {'k': 'l', 'b': n, 'w': w[1:n // 2]}, {'k': 'r', 'b': n, 'w': w[n // 2 + 1:n]},
    {'k': 'l', 'b': n - 1, 'w': w[1:(n - 1) // 2]}, {'k': 'r', 'b': n - 1, 'w': w[n - (n - 1 - (n - 1) // 2) + 1:n]}]"""
ORACLE = f"""
WITH rows_ AS (
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS pos, ls
    FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
),
lines AS (SELECT doc_id, pos, ls[pos] AS line FROM rows_),
seen AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
firsts AS (SELECT line, min({{'d': doc_id, 'p': pos}}) AS f FROM seen GROUP BY line),
split AS (SELECT line, f, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM firsts),
halves AS (SELECT line, f, w, n, unnest({_SQL_HALVES}) AS k FROM split WHERE n >= {MIN_WORDS}),
pairs AS (
    SELECT DISTINCT a.line, a.w AS aw, a.n AS an, b.w AS bw, b.n AS bn
    FROM halves a JOIN halves b ON a.k = b.k AND b.f < a.f
),
near AS (
    SELECT DISTINCT line FROM pairs WHERE
        (an = bn AND len(list_filter(range(1, an + 1), lambda i: aw[i] <> bw[i])) = 1)
        OR (an = bn + 1 AND len(list_filter(range(1, an + 1), lambda i: list_concat(aw[1:i - 1], aw[i + 1:an]) = bw)) > 0)
        OR (bn = an + 1 AND len(list_filter(range(1, bn + 1), lambda i: list_concat(bw[1:i - 1], bw[i + 1:bn]) = aw)) > 0)
),
gone AS (
    SELECT s.doc_id, s.pos FROM seen s JOIN firsts f ON s.line = f.line
    WHERE f.f <> {{'d': s.doc_id, 'p': s.pos}} OR s.line IN (SELECT line FROM near)
),
left_ AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (g.pos IS NULL) AS t, count(g.pos) AS n
    FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_removed, length(coalesce(t, '')) AS kept_chars, sha256(coalesce(t, '')) AS kept_sha256
FROM documents d LEFT JOIN left_ ON d.doc_id = left_.doc_id
"""

QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": ORACLE}
