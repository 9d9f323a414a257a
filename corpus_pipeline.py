"""A corpus pipeline: quality rules, near-dedup, decontamination, redaction and encoding, one after another.

Each stage is a function of (spark, docs, sf_dir) that takes all rows its predecessor kept.  Stages are written as
Parquet and read again, so a lost executor repeats one stage at most.

All stages read whole texts, take an empty table (and give one) and hand on every column of their input, whatever its
name.  A null text counts as an empty one: the quality rules reject both; a stage order without them keeps one text
without words of all, as they are near duplicates of each other.  Rows without an id are judged by their text; repeated rows
are kept or dropped alike, but near-dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import cut, documents, table
from millrace.llm.decontaminate import drop_contaminated
from millrace.llm.pieces import encode_documents
from millrace.llm.pii import redact_documents
from millrace.llm.quality import keep_documents
from millrace.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return keep_documents(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts' piece ids beside the columns of documents."""
    return encode_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("redaction", redaction),
    ("encoding", encoding),
]
#: Fingerprints and piece encoding are beyond SQL; the tests hold the pipeline against a plain Python version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the checkpoint folder before the next reads it."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
