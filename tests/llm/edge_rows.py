"""Rows that every operator has to take: nulls, empty and long texts, ties, repeats, extra columns."""

from pyspark.sql import DataFrame, SparkSession

LONG = "the answer of a long text. " * 9000
ROWS = [
    (1, "Hello wörld, it's 42 <|endoftext|>!", "x"), (2, None, None), (3, "", "x"), (None, "no id", "y"), (4, " \n\t ", "z"),
    (5, LONG, "x"), (6, "Ab  cd ▁ ef\n\ngh ", None), (7, "same text here", "x"), (7, "same text here", "x"),
    (8, "same text here", "y"), (-3, "x" * 5000, "q"), (9, "日本語 テキスト café É ﬁ", "x"), (10, " a\x85b\x1cc̈ Σ", "x"),
]


def edge_documents(spark: SparkSession) -> DataFrame:
    """Extra columns carry names that operators use inside."""
    schema = "doc_id bigint, text string, id string"
    rows = spark.createDataFrame(ROWS, schema)
    return rows.selectExpr("doc_id", "text", "id", "id AS shard", "id AS length", "id AS part", "1 AS start", "2 AS line",
                           "3 AS word", "4 AS h", "5 AS kept", "6 AS fingerprint", "7 AS item_id", "8 AS score", "9 AS n_words")


def no_documents(spark: SparkSession) -> DataFrame:
    return edge_documents(spark).where("false")
