"""Access, filters, joins and paged listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import extension
from ..sources.shared import cut

MAX_UPLOAD = 50 * 1024 * 1024
#: What may be uploaded, by extension or by content type.
ALLOWED = (".pdf", ".txt", ".doc", ".docx", ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".tiff", ".tif", ".webp")
ALLOWED_TYPES = (
    "application/pdf", "text/plain", "application/msword", "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "image/png", "image/jpeg", "image/jpg", "image/gif", "image/bmp", "image/tiff", "image/tif", "image/webp",
)


def where_given(df: DataFrame, **values) -> DataFrame:
    """Equality on each given column; a list means membership; None means no condition; an empty list, no rows."""
    for column, value in values.items():
        if value is None:
            continue
        df = df.filter(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == value)
    return df


def in_either(columns: tuple[str, str], value) -> Column:
    return (F.col(columns[0]) == value) | (F.col(columns[1]) == value)


def in_dataset(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in another dataset."""
    return df.join(keys.select(on), on, "left_semi")


def accessible(rows: DataFrame, memberships: DataFrame, user_id, organization: str = "organization_id") -> DataFrame:
    """Rows of the organizations that a user belongs to, in any role; rows without an organization are no one's."""
    mine = memberships.filter(F.col("user_id") == user_id).select(F.col("organization_id").alias(organization)).distinct()
    return rows.join(mine, organization, "left_semi")


def access_partition(requested: DataFrame, files: DataFrame, jobs: DataFrame, memberships: DataFrame, user_id) -> DataFrame:
    """Every requested file id with whether the user may see it, and why not."""
    own = accessible(jobs, memberships, user_id).select(F.col("id").alias("job_id"), F.lit(True).alias("mine"))
    found = requested.select("file_id").distinct().join(files.select(F.col("id").alias("file_id"), "job_id"), "file_id", "left").join(own, "job_id", "left")
    reason = F.when(F.col("job_id").isNull(), "File not found").when(F.col("mine").isNull(), "Access denied")
    return found.select("file_id", F.coalesce("mine", F.lit(False)).alias("accessible"), reason.alias("reason"))


def page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def page_metadata(total: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row: page number, page size, total and number of pages, from a frame of one row with ``total``."""
    return total.select(F.lit(offset // limit + 1).alias("page"), F.lit(limit).alias("page_size"), F.col("total"), F.ceil(F.col("total") / limit).cast("long").alias("pages"))


def job_listing(jobs: DataFrame, files: DataFrame, memberships: DataFrame, user_id, limit: int, offset: int) -> DataFrame:
    """A page of a user's jobs with file counts, latest first; files of other pages are not counted."""
    mine = accessible(jobs, memberships, user_id)
    shown = page(mine.select(F.col("id").alias("job_id"), "name", "status", "created_at"), [F.col("created_at").desc_nulls_first(), F.col("job_id")], limit, offset)
    counts = files.join(shown.select("job_id"), "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("file_count"))
    return shown.join(counts, "job_id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0)))


def previews_by_file(files: DataFrame, previews: DataFrame, details: tuple[str, ...] = ()) -> DataFrame:
    """Files with the ids of the previews that list them, each once however often it lists them, in order of ids; with
    details, columns of previews, structs of the id and these.

    previews: (preview_id, items array, details).  The arrays are exploded and joined by id, so no row is compared with all
    arrays.
    """
    shown = F.struct("preview_id", *details) if details else F.col("preview_id")
    links = previews.select(shown.alias("shown"), F.explode(F.array_distinct("items")).alias("id"))
    listed = links.groupBy("id").agg(F.array_sort(F.collect_list("shown")).alias("previews"))
    return files.join(listed, "id", "left").withColumn("previews", F.coalesce("previews", F.array().cast(listed.schema["previews"].dataType)))


def with_inviter(users: DataFrame) -> DataFrame:
    """Users with the name of who invited them, null if no one or no longer there."""
    inviter = users.select(F.col("id").alias("invited_by"), F.col("name").alias("inviter"))
    return users.join(inviter, "invited_by", "left").select("id", "name", "role", "organization_id", "inviter")


def without_membership(users: DataFrame, memberships: DataFrame) -> DataFrame:
    return users.join(memberships.select(F.col("user_id").alias("id")), "id", "left_anti")


def not_queued(files: DataFrame, queued: DataFrame, active: DataFrame) -> DataFrame:
    """Files with the reason that keeps them out of the queue: queued already, or under way."""
    q, a = queued.select(F.col("file_id").alias("id"), F.lit(True).alias("q")).distinct(), active.select(F.col("file_id").alias("id"), F.lit(True).alias("a")).distinct()
    reason = F.when(F.col("q"), "File already in processing queue").when(F.col("a"), "File currently being processed")
    return files.join(q, "id", "left").join(a, "id", "left").withColumn("queue_reason", reason).drop("q", "a")


def fallback(primary: DataFrame, secondary: DataFrame, on: str, value: str) -> DataFrame:
    """Per key the first source's value, else the second's, and which it was."""
    p, s = primary.select(on, F.col(value).alias("p")), secondary.select(on, F.col(value).alias("s"))
    return p.join(s, on, "full").select(on, F.coalesce("p", "s").alias(value), F.when(F.col("p").isNotNull(), "primary").when(F.col("s").isNotNull(), "secondary").alias("origin"))


def admission(files: DataFrame, name: str = "filename", size: str = "size", allowed: tuple[str, ...] = ALLOWED, most: int = MAX_UPLOAD, mime: str | None = None, types: tuple[str, ...] = ALLOWED_TYPES) -> DataFrame:
    """Whether a file may be taken in, with the first reason against it: neither its extension nor its content type (where
    that column is given) is allowed, or it is too large."""
    known = F.coalesce(extension(F.col(name)).isin(*allowed), F.lit(False))
    if mime is not None:
        known |= F.coalesce(F.col(mime).isin(*types), F.lit(False))
    return files.withColumn("reject_reason", F.when(~known, "type").when(F.col(size) > most, "size"))


def unique_slugs(names: DataFrame, base: str, order: str, taken: DataFrame | None = None) -> DataFrame:
    """A slug for every row, in order: the first of base, base-1, base-2 and so on that neither ``taken`` nor a row before
    has.  A null base has no slug; rows of one order value are taken by base.

    The r-th row of a base cannot get a lower number than r.  So every row proposes that number; where another base's row
    before it (or ``taken``) holds the slug, it goes on to the next number that is free of such, and pushes the later rows of its base
    before it.  Slugs thus only pass to rows further ahead, so rounds end, with the same slugs as one row after the other.
    Only bases that can clash take part: those whose numbered slugs are bases or taken, and those that are such slugs.
    """
    columns = [c for c in names.columns if c != "slug"]
    text = F.col("slug__")
    number = F.regexp_extract(text, r"-([1-9][0-9]{0,17})$", 1)
    stem = F.when(number != "", F.substring(text, F.lit(1), F.length(text) - F.length(number) - 1))
    have = (taken.select(F.col("slug").alias("slug__")) if taken is not None else names.sparkSession.createDataFrame([], "slug__ string")).filter("slug__ IS NOT NULL").distinct()
    rows = names.filter(F.col(base).isNotNull()).select(*columns, F.col(base).alias("base__"), F.struct(F.col(order).alias("o"), F.col(base).alias("b")).alias("at__"))
    rows = rows.withColumn("rank__", F.row_number().over(Window.partitionBy("base__").orderBy("at__")).cast("long") - 1)
    none = names.filter(F.col(base).isNull()).select(*columns, F.lit(None).cast("string").alias("slug"))

    bases = rows.select(F.col("base__").alias("slug__")).distinct()
    numbered = bases.select(F.col("slug__").alias("whole"), stem.alias("stem")).filter("stem IS NOT NULL").join(bases.withColumnRenamed("slug__", "stem"), "stem")
    clash = numbered.select("stem").union(numbered.select("whole")).union(have.select("slug__")).union(have.select(stem.alias("stem")).filter("stem IS NOT NULL"))
    clash = cut(clash.toDF("base__").distinct())
    slug = F.when(F.col("low__") == 0, F.col("base__")).otherwise(F.concat_ws("-", "base__", F.col("low__").cast("string")))
    if not clash.limit(1).count():
        return rows.withColumn("low__", F.col("rank__")).select(*columns, slug.alias("slug")).union(none)
    calm = rows.join(clash, "base__", "left_anti").withColumn("low__", F.col("rank__"))
    busy = cut(rows.join(clash, "base__", "left_semi").withColumn("low__", F.col("rank__")))
    run = Window.partitionBy("base__", "run__")
    while True:
        held = busy.select(slug.alias("slug__"), F.col("base__").alias("of"), "at__").union(have.select("slug__", F.lit(None).cast("string").alias("of"), F.lit(None).cast(busy.schema["at__"].dataType).alias("at__")))
        claims = held.select(text.alias("base__"), F.lit(0).cast("long").alias("low__"), "of", "at__").union(held.filter(number != "").select(stem, number.cast("long"), "of", "at__"))
        others = claims.filter(~F.col("of").eqNullSafe(F.col("base__"))).join(clash, "base__", "left_semi")
        # of several claims on a number the first row's counts, before all rows the taken ones
        first = others.groupBy("base__", "low__").agg(F.min(F.struct(F.col("at__").isNotNull().alias("row"), "at__")).alias("c"))
        first = first.withColumn("run__", F.col("low__") - F.row_number().over(Window.partitionBy("base__").orderBy("low__")))
        first = first.withColumn("last", F.max("low__").over(run)).withColumn("latest", F.max("c").over(run)).select("base__", "low__", "c", "last", "latest")
        before = lambda c: ~F.col(f"{c}.row") | (F.col(f"{c}.at__") < F.col("at__"))
        lost = F.coalesce(before("c"), F.lit(False))
        low = F.when(lost & before("latest"), F.col("last") + 1).when(lost, F.col("low__") + 1).otherwise(F.col("low__"))
        moved = busy.join(first, ["base__", "low__"], "left").select(*columns, "base__", "at__", "rank__", low.alias("low__"), lost.alias("lost__"))
        pushed = F.max(F.col("low__") - F.col("rank__")).over(Window.partitionBy("base__").orderBy("rank__").rowsBetween(Window.unboundedPreceding, 0)) + F.col("rank__")
        now = cut(moved.withColumn("low__", pushed))
        again = now.filter("lost__").limit(1).count()
        busy = now.drop("lost__").select(*busy.columns)
        if not again:
            break
    return calm.select(*columns, slug.alias("slug")).union(busy.select(*columns, slug.alias("slug"))).union(none)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
