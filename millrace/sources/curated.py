"""A curated store: one row per key, in one folder per value of a column, changed by merges that read what they touch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut

#: Folders of one merge that are named to the scan as literals; more are found by a join with dynamic pruning.
MOST_LITERALS = 10_000


class CuratedStore:
    """Rows under ``path/rows/<by>=…`` and, under ``path/folders/bucket=…``, which folder each key is in.

    The second table is dealt by a hash of the key into a fixed number of buckets.  A merge looks its keys up there, so it
    knows the folders that hold old rows, also of keys that move, and the scan of the rows gets these folders as literals.

    ``order``: columns that tell how new a row is.  Of several changes of a key the newest counts, and a stored row that
    is newer than the change stays, so merging a batch again, or an old one late, changes nothing.  Equal order: the greatest
    row of the changes; the change replaces the stored row.  Without order the greatest of the changes counts.

    ``first``: columns that keep the first value that a key's row was stored with.

    A key is never null (such changes are an error of the caller and are left out); folder values may be null.  A folder
    that loses its last row keeps one row without a key, which readers do not see, because a folder is only replaced by
    rows.  Folders are replaced one by one: a job that dies between leaves a mix, which the same merge mends.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, by: str = "job_id", order: Sequence[str] = (), first: Sequence[str] = (), buckets: int = 64):
        self.spark, self.path, self.key, self.by, self.order, self.first, self.buckets = spark, path, key, by, list(order), list(first), buckets

    def _read(self, name: str, schema) -> DataFrame:
        try:
            return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def rows(self, schema=None) -> DataFrame:
        """The rows of all keys; ``schema`` is needed only while nothing is stored."""
        found = self._read("rows", schema) if schema is not None else self.spark.read.parquet(f"{self.path}/rows")
        return found.filter(F.col(self.key).isNotNull())

    def _write(self, rows: DataFrame, name: str, by: str) -> None:
        """Replace the folders that ``rows`` have; a large folder is written by several tasks."""
        rows.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{self.path}/{name}")

    def newest(self, changes: DataFrame) -> DataFrame:
        """One change per key."""
        row = F.struct(*[c for c in changes.columns if c != self.key])
        last = F.max_by(row, F.struct(*self.order, row)) if self.order else F.max(row)
        return changes.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(last.alias("r__")).select(self.key, "r__.*").select(*changes.columns)

    def _within(self, name: str, schema, column: str, wanted: DataFrame) -> DataFrame:
        """The rows of a table in the wanted folders (a column of distinct values); named as literals while they are few."""
        found = self._read(name, schema)
        some = [r[0] for r in wanted.limit(MOST_LITERALS + 1).collect()]
        if len(some) > MOST_LITERALS:
            both = wanted.select(F.col(wanted.columns[0]).alias("w__"))
            return found.join(both, F.col(column).eqNullSafe(F.col("w__")), "left_semi")
        test = F.col(column).isin([x for x in some if x is not None])
        return found.filter(test | F.col(column).isNull() if None in some else test)

    def merge(self, changes: DataFrame) -> DataFrame:
        """Replace the rows of the changed keys by their newest change, whole rows, nulls included.  Returns the folders that
        were read."""
        by, key, bucket = self.by, self.key, F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = cut(self.newest(changes))
        places = new.select(key, by).schema
        index_schema = new.select(key, F.col(by).alias("folder"), F.lit(0).alias("bucket")).schema
        index = self._within("folders", index_schema, "bucket", new.select(bucket.alias("bucket")).distinct())
        index = cut(index)
        was = index.join(new.select(key), key, "left_semi").select(F.col("folder").alias(places[by].name))
        folders = cut(was.union(new.select(by)).distinct())
        touched = self._within("rows", new.schema, by, folders)
        old = touched.filter(F.col(key).isNotNull())
        if self.order:
            stored = old.select(key, F.struct(*self.order).alias("s__"))
            newer = stored.join(new.select(key, F.struct(*self.order).alias("n__")), key).filter("s__ > n__").select(key)
            new = cut(new.join(newer, key, "left_anti").select(*new.columns))
        if self.first:
            kept = old.select(key, *[F.col(c).alias(f"first__{c}") for c in self.first])
            new = cut(new.join(kept, key, "left").select(*[F.coalesce(f"first__{c}", c).alias(c) if c in self.first else c for c in new.columns]))
        now = cut(old.join(new.select(key), key, "left_anti").select(*new.columns).union(new))
        blank = folders.join(now.select(F.col(by).alias("f__")).distinct(), F.col(by).eqNullSafe(F.col("f__")), "left_anti")
        nothing = blank.select(*[F.col(c) if c == by else F.lit(None).cast(new.schema[c].dataType).alias(c) for c in new.columns])
        self._write(now.union(nothing), "rows", by)
        entries = new.select(key, F.col(by).alias("folder"), bucket.alias("bucket"))
        kept = index.join(new.select(key), key, "left_anti").select(key, "folder", "bucket")
        self._write(kept.union(entries), "folders", "bucket")
        return folders
