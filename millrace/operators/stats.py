"""Statistics over jobs, files and tenants.

Counts that a join would multiply are aggregated on each branch first; ``mode="literal"`` gives the multiplied counts
by arithmetic on the branches instead of by the fan-out itself, so no join grows as users times files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def status_class(name: str, extraction: str = "extraction_status", processing: str = "processing_status") -> Column:
    """processed: both completed; processing: either under way; pending: both pending."""
    e, p = F.col(extraction), F.col(processing)
    return {"processed": (e == "completed") & (p == "completed"), "processing": (e == "processing") | (p == "processing"), "pending": (e == "pending") & (p == "pending")}[name]


def n(condition: Column) -> Column:
    return F.count_if(condition)


def _file_counts() -> list[Column]:
    both = (F.col("extraction_status") == "completed") & (F.col("processing_status") == "completed")
    either_failed = (F.col("extraction_status") == "failed") | (F.col("processing_status") == "failed")
    out = [F.count(F.col("file_id")).alias("total_files")]
    for stage in ("extraction", "processing"):
        out += [n(F.col(f"{stage}_status") == s).alias(f"{stage}_{s}") for s in ("pending", "processing", "completed", "failed")]
    return [*out, n(both).alias("fully_completed"), n(either_failed).alias("any_failed")]


def job_statistics(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Per job: files, files by outcome and total bytes (null without files)."""
    per = files.groupBy("job_id").agg(
        F.count("*").alias("total_files"),
        n(F.col("extraction_status") == "completed").alias("extracted_files"),
        n(F.col("processing_status") == "completed").alias("processed_files"),
        n(F.col("extraction_status") == "failed").alias("extraction_failed"),
        n(F.col("processing_status") == "failed").alias("processing_failed"),
        F.sum("size").alias("total_bytes"),
    )
    zero = ("total_files", "extracted_files", "processed_files", "extraction_failed", "processing_failed")
    return jobs.select(F.col("id").alias("job_id"), "name", "status").join(per, "job_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def job_summary(files: DataFrame) -> DataFrame:
    """Per job: the total and ten filtered counts."""
    return files.withColumnRenamed("id", "file_id").groupBy("job_id").agg(*_file_counts())


def system_statistics(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """One row: jobs by status, files and bytes."""
    statuses = ("queued", "processing", "completed", "partial", "failed")
    j = jobs.agg(F.count("*").alias("total_jobs"), *[n(F.col("status") == s).alias(f"{s}_jobs") for s in statuses])
    f = files.agg(F.count("*").alias("total_files"), n(F.col("extraction_status") == "completed").alias("extracted_files"), n(F.col("processing_status") == "completed").alias("processed_files"), F.sum("size").alias("total_bytes"))
    return j.crossJoin(f)  # two rows of one each


def _branches(users: DataFrame, jobs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    u = users.groupBy("organization_id").agg(F.count("*").alias("users"), *[n(F.col("role") == r).alias(f"{r}s") for r in ("owner", "admin", "member", "viewer")])
    per_job = files.groupBy("job_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    j = (
        jobs.select(F.col("id").alias("job_id"), "organization_id", "status")
        .join(per_job, "job_id", "left")
        .groupBy("organization_id")
        .agg(
            F.count("*").alias("jobs"),
            F.coalesce(F.sum("files"), F.lit(0)).alias("files"),
            F.sum("bytes").alias("bytes"),
            F.sum(F.greatest(F.coalesce("files", F.lit(0)), F.lit(1))).alias("job_rows"),
            n(F.col("status") == "completed").alias("completed_jobs"),
            F.sum(F.when(F.col("status") == "completed", F.greatest(F.coalesce("files", F.lit(0)), F.lit(1))).otherwise(0)).alias("completed_rows"),
        )
    )
    return u, j


def organization_statistics(organizations: DataFrame, users: DataFrame, jobs: DataFrame, files: DataFrame, mode: str = "exact") -> DataFrame:
    """Per organization: members, roles, jobs, files and bytes.  literal: role counts and bytes as the fan-out of
    users times jobs times files multiplies them."""
    u, j = _branches(users, jobs, files)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    wide = organizations.select("id", "name").join(u.withColumnRenamed("organization_id", "id"), "id", "left").join(j.withColumnRenamed("organization_id", "id"), "id", "left")
    rows = F.greatest(zero("job_rows"), F.lit(1)) if mode == "literal" else F.lit(1)
    people = F.greatest(zero("users"), F.lit(1)) if mode == "literal" else F.lit(1)
    return wide.select(
        "id",
        "name",
        zero("users").alias("total_users"),
        *[(zero(f"{r}s") * rows).alias(f"{r}_count") for r in ("owner", "admin", "member", "viewer")],
        zero("jobs").alias("total_jobs"),
        zero("files").alias("total_files"),
        (F.coalesce("completed_rows" if mode == "literal" else "completed_jobs", F.lit(0)).cast("long") * people).alias("completed_jobs"),
        (F.col("bytes") * people).alias("total_bytes"),
    )


def membership_statistics(organizations: DataFrame, memberships: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Per organization: members by membership, roles, jobs, files and bytes, each counted once."""
    members = memberships.dropDuplicates(["user_id", "organization_id"])
    return organization_statistics(organizations, members, jobs, files)


def user_statistics(users: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Per user: jobs, completed jobs, files and bytes."""
    per_job = files.groupBy("job_id").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    j = jobs.select(F.col("id").alias("job_id"), "user_id", "status").join(per_job, "job_id", "left").groupBy("user_id").agg(F.count("*").alias("total_jobs"), n(F.col("status") == "completed").alias("completed_jobs"), F.sum("files").alias("total_files"), F.sum("bytes").alias("total_bytes"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return users.select(F.col("id").alias("user_id"), "name").join(j, "user_id", "left").select("user_id", "name", *[zero(c) for c in ("total_jobs", "completed_jobs", "total_files", "total_bytes")])


def file_stats(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Files by status class, per key or over all; an empty table gives zeros where no key is asked for."""
    counts = [F.count("*").alias("total"), *[n(status_class(c)).alias(c) for c in ("processed", "processing", "pending")]]
    return files.groupBy(*by).agg(*counts) if by else files.agg(*counts)


def processing_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total"), *[n(F.col("processing_status") == s).alias(s) for s in ("pending", "processing", "completed", "failed")])


def job_rollup(files: DataFrame) -> DataFrame:
    """completed if all files are, partial if some, else failed."""
    done = n(status_class("processed"))
    return files.groupBy("job_id").agg(F.count("*").alias("files"), done.alias("done")).withColumn("rollup", F.when(F.col("done") == F.col("files"), "completed").when(F.col("done") > 0, "partial").otherwise("failed"))


def outcome_summary(outcomes: DataFrame, column: str = "outcome", values: tuple[str, ...] = ()) -> DataFrame:
    """One row: the total and the number of each outcome."""
    return outcomes.agg(F.count("*").alias("total"), *[n(F.col(column) == v).alias(v) for v in values])
