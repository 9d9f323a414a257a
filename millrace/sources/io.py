"""Sources and sinks: CSV registry, landing manifest, JSON feeds, curated store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.scalars import content_type, document_kind
from .curated import MOST_LITERALS
from .shared import cut

QUEUE_ITEM = "fileId STRING, jobId STRING, priority INT, timestamp BIGINT, retries INT, status STRING, mode STRING"
STATUS_EVENT = "jobId STRING, fileId STRING, extraction_status STRING, processing_status STRING, message STRING, error STRING, timestamp STRING"


def read_registry(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A header CSV with every field a string; the schema is given, so nothing is inferred."""
    return spark.read.schema(StructType([StructField(c, StringType()) for c in columns])).option("header", True).csv(path)


def landing_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file: name, size, content hash, key, type and kind."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return files.select(name.alias("filename"), F.col("length").alias("size"), F.sha2("content", 256).alias("file_hash"), F.col("path").alias("s3_key"), content_type(name).alias("content_type"), document_kind(name).alias("kind"), F.lit("uploaded").alias("upload_status"))


def parse_items(rows: DataFrame, column: str = "value", schema: str = QUEUE_ITEM, required: str = "fileId") -> DataFrame:
    """JSON lines as rows; lines that do not parse or lack the required field are skipped."""
    parsed = rows.withColumn("item", F.from_json(column, schema))
    return parsed.filter(F.col(f"item.{required}").isNotNull()).select("item.*")


def read_events(spark: SparkSession, path: str, schema: str = STATUS_EVENT) -> DataFrame:
    """A stream of JSON status events from a folder."""
    return spark.readStream.schema(schema).json(path)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Missing columns added and nulls filled."""
    return df.withColumns({c: F.coalesce(c, v) if c in df.columns else v for c, v in defaults.items()})


def append(df: DataFrame, path: str, defaults: dict[str, Column] | None = None) -> None:
    with_defaults(df, defaults or {}).write.mode("append").parquet(path)


def write_curated(df: DataFrame, path: str, by: str = "job_id", files_per_key: int = 1) -> None:
    """The curated store, one folder per key.  Only the folders of keys in ``df`` are replaced; others stay.  Rows of a key are
    brought together first, into some files per key, so a hot key can be written by several tasks."""
    salt = F.pmod(F.xxhash64(*[c for c in df.columns if c != by]), F.lit(files_per_key)) if len(df.columns) > 1 else F.lit(0)
    df.repartition(F.col(by), salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def merge_curated(spark: SparkSession, changes: DataFrame, path: str, keys: list[str], by: str = "job_id") -> None:
    """Changes into a store without an index, by key: the greatest change of a key replaces the whole old row, nulls included;
    other rows stay.

    If ``by`` is one of the keys, only the folders that changes name are read, as literals of the scan.  Else a key may have
    been in any folder: keys and folders (two columns) of all rows are read to find out, then the touched folders.  Use
    CuratedStore to look such keys up instead.
    """
    rest = [c for c in changes.columns if c not in keys]
    row = F.max(F.struct(*rest)).alias("r__") if rest else F.count("*").alias("r__")
    new = cut(changes.groupBy(*keys).agg(row).select(*keys, *(["r__.*"] if rest else [])))
    old = spark.read.parquet(path)
    touched = new.select(by) if by in keys else new.select(by).union(old.join(new.select(*keys), keys, "left_semi").select(by))
    folders = [r[0] for r in touched.distinct().limit(MOST_LITERALS + 1).collect()]
    if len(folders) <= MOST_LITERALS:
        held = old.filter(F.col(by).isin([x for x in folders if x is not None]) | (F.col(by).isNull() if None in folders else F.lit(False)))
    else:
        held = old.join(touched.distinct(), by, "left_semi")
    now = cut(held.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True))
    emptied = [] if by in keys else [x for x in folders[:MOST_LITERALS] if x is not None]
    if emptied:  # a folder is only replaced by rows: one that lost all of them keeps a row without a key
        gone = cut(held.select(by).distinct().join(now.select(by).distinct(), by, "left_anti"))
        now = now.unionByName(gone, allowMissingColumns=True)
    write_curated(now, path, by)


def publish(stream: DataFrame, path: str, checkpoint: str, key: str = "job_id"):
    """Status changes to a keyed sink, for a bounded run over what is there."""
    return stream.writeStream.partitionBy(key).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
