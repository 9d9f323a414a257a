"""Rows that operators must take: nulls, empty and long texts, repeated rows, clashing column names, empty tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PROSE = "the wind went over the hill and the old man in the house was glad of the fire that it had not put out for him "
LONG = " ".join(f"{w}{k % 977}" for k, w in enumerate(PROSE.split() * 1500))
ROWS = [
    (1, PROSE * 3, "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n\x0b ", "en", "b"),
    (5, PROSE * 3, "en", "a"),
    (5, PROSE * 3, "en", "a"),
    (None, PROSE * 3, "en", "a"),
    (None, None, None, None),
    (6, LONG, "en", "b"),
    (7, "one two three", "de", "b"),
    (8, "Mail a.b@c.example.org or +1 (555) 123-4567, card 4111 1111 1111 1111, host 10.0.0.255é\U0001f600", "fr", "b"),
]
CLASHES = ("chunk", "h", "x", "key", "print", "w", "label", "spans", "found", "id", "t", "lang_pred", "score", "base", "equal", "piece_ids", "kept", "_key", "key__", "id__", "row__", "row", "seed", "i")


def edge_docs(spark: SparkSession) -> DataFrame:
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    return docs.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit("clash") for c in CLASHES})


def empty_docs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
