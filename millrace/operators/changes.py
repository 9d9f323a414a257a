"""Table changes as snapshot plus changes gives new snapshot, and constraint reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import owner_slug, terminal_time


def last_change(changes: DataFrame, keys: list[str], order: str | None) -> DataFrame:
    """One change per key: the last by an order, else the greatest row."""
    rest = [c for c in changes.columns if c not in keys]
    row = F.struct(*rest)
    last = F.max_by(row, F.struct(order, row)) if order else F.max(row)
    return changes.groupBy(*keys).agg(last.alias("r")).select(*keys, "r.*")


def upsert(snapshot: DataFrame, changes: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of the snapshot with the columns of their change, and new rows; doing it again changes nothing."""
    change = last_change(changes, keys, order)
    columns = [c for c in snapshot.columns if c not in keys]
    given = [c for c in columns if c in change.columns]
    new = change.select(*keys, F.lit(True).alias("new__"), *[F.col(c).alias(f"n__{c}") for c in given])
    joined = snapshot.join(new, keys, "full")
    return joined.select(*keys, *[F.when(F.col("new__"), F.col(f"n__{c}")).otherwise(F.col(c)).alias(c) if c in given else F.col(c) for c in columns]).select(*snapshot.columns)


def insert_ignore(snapshot: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """The snapshot and those rows whose key it does not have."""
    new = last_change(rows, keys, None).join(snapshot.select(*keys), keys, "left_anti")
    return snapshot.unionByName(new.select(*snapshot.columns))


def review_update(files: DataFrame, updates: DataFrame, as_of: Column) -> DataFrame:
    """New review status by id; the time is set on an end status, cleared on pending, kept on in_review."""
    u = last_change(updates.select("id", F.col("status").alias("new__")), ["id"], None)
    time = F.when(F.col("new__").isin("reviewed", "approved", "rejected"), as_of).when(F.col("new__") == "pending", None).otherwise(F.col("reviewed_at"))
    joined = files.join(u, "id", "left").withColumn("reviewed_at", time)
    return joined.withColumn("review_status", F.coalesce("new__", "review_status")).drop("new__").select(*files.columns)


def verification_update(files: DataFrame, updates: DataFrame, flags: tuple[str, ...] = ("admin_verified", "customer_verified")) -> DataFrame:
    """Flags by id; a null flag leaves the value."""
    u = last_change(updates, ["id"], None).select("id", *[F.col(f).alias(f"n__{f}") for f in flags])
    out = files.join(u, "id", "left")
    return out.withColumns({f: F.coalesce(f"n__{f}", f) for f in flags}).select(*files.columns)


def fold_results(events: DataFrame, key: str, order: list[str], content: list[str], result: str = "result", status: str = "status", ts: str = "ts") -> DataFrame:
    """Per key its newest event as a whole: status and all content columns, nulls included.  processed_at is that event's time
    if it ends the work; actual_result is the first result that a completed event brought, whatever came after."""
    newest = F.max_by(F.struct(status, *content, *order), F.struct(*order))
    brought = (F.col(status) == "completed") & F.col(result).isNotNull()
    first = F.min_by(result, F.when(brought, F.struct(*order)))
    folded = events.groupBy(key).agg(newest.alias("r__"), first.alias("actual_result")).select(key, "r__.*", "actual_result")
    return folded.withColumn("processed_at", terminal_time(F.col(status), F.col(ts)))


def partial_update(snapshot: DataFrame, changes: DataFrame, keys: list[str], allowed: list[str], present: str | None = None) -> DataFrame:
    """Only allowed columns change, and only where the change has a value; present: a column of changes that lists the
    columns that a change gives, each of which is then taken as it is, null too."""
    given = [c for c in allowed if c in changes.columns]
    flags = [present] if present else []
    u = last_change(changes.select(*keys, *given, *flags), keys, None)
    u = u.select(*keys, *[F.col(c).alias(f"n__{c}") for c in given], *[F.col(c).alias("present__") for c in flags])
    taken = lambda c: F.when(F.array_contains("present__", c), F.col(f"n__{c}")).otherwise(F.col(c)) if present else F.coalesce(f"n__{c}", c)
    return snapshot.join(u, keys, "left").withColumns({c: taken(c) for c in given}).select(*snapshot.columns)


def delete_rows(snapshot: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return snapshot.join(keys.select(on), on, "left_anti")


def cascade(parents: DataFrame, children: DataFrame, parent_key: str, foreign: str, on_delete: str = "cascade") -> DataFrame:
    """Children after their parents were removed: gone with them, or with a null reference."""
    there = parents.select(F.col(parent_key).alias(foreign)).distinct()
    if on_delete == "cascade":
        return children.join(there, foreign, "left_semi").unionByName(children.filter(F.col(foreign).isNull())).select(*children.columns)
    kept = children.join(there.withColumn("there__", F.lit(True)), foreign, "left")
    return kept.withColumn(foreign, F.when(F.col("there__"), F.col(foreign))).select(*children.columns)


def backfill(df: DataFrame, column: str, value: Column) -> DataFrame:
    return df.withColumn(column, F.coalesce(column, value))


def add_counts(snapshot: DataFrame, events: DataFrame, key: str, counter: str) -> DataFrame:
    """Counters grown by the number of events under their key; a missing counter is zero."""
    delta = events.groupBy(key).agg(F.count("*").alias("d__"))
    return snapshot.join(delta, key, "left").withColumn(counter, F.coalesce(counter, F.lit(0)) + F.coalesce("d__", F.lit(0))).select(*snapshot.columns)


def append_items(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Arrays with the changes' items behind them, in order, repeats kept.  changes: (key, pos, item)."""
    add = changes.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda s: s["item"]).alias("a__"))
    empty = F.array().cast(rows.schema[column].dataType)
    return rows.join(add, key, "left").withColumn(column, F.concat(F.coalesce(column, empty), F.coalesce("a__", empty))).select(*rows.columns)


def remove_items(rows: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """Arrays without any copy of the changes' items."""
    gone = changes.groupBy(key).agg(F.collect_set("item").alias("g__"))
    empty = F.array().cast(rows.schema[column].dataType)
    return rows.join(gone, key, "left").withColumn(column, F.filter(column, lambda x: ~F.array_contains(F.coalesce("g__", empty), x))).select(*rows.columns)


def verified_to_reviewed(files: DataFrame) -> DataFrame:
    """Files that both sides verified and that are not reviewed become so, dated by their last update."""
    due = F.coalesce("admin_verified", F.lit(False)) & F.coalesce("customer_verified", F.lit(False)) & ~F.col("review_status").eqNullSafe(F.lit("reviewed"))
    return files.withColumn("reviewed_at", F.when(due, F.col("updated_at")).otherwise(F.col("reviewed_at"))).withColumn("review_status", F.when(due, "reviewed").otherwise(F.col("review_status")))


def retry_outcome(files: DataFrame, most: int = 3) -> DataFrame:
    """Whether a file may be tried again, else why not."""
    success = (F.col("extraction_status") == "completed") & (F.col("processing_status") == "completed")
    outcome = F.when(success, "already successful").when(F.coalesce("retry_count", F.lit(0)) >= most, "retry limit reached").otherwise("retry")
    return files.withColumn("outcome", outcome).withColumn("retry_count", F.coalesce("retry_count", F.lit(0)) + F.when(outcome == "retry", 1).otherwise(0))


def json_array_rows(rows: DataFrame, key: str, column: str, item: str) -> DataFrame:
    """One row per item of a JSON array column; rows without an array give none."""
    return rows.filter(F.json_array_length(column) > 0).select(key, F.posexplode(F.from_json(column, f"array<{item}>")).alias("pos", "item"))


def with_owner_organizations(organizations: DataFrame, users: DataFrame, memberships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables with an organization for every user without a membership, and the membership that makes them its owner.

    The organization's key follows from the user's: the largest key plus the user's id plus one.  The slug ends with the user's id,
    so doing it again on the results changes nothing.
    """
    alone = users.select("id", "name").join(memberships.select(F.col("user_id").alias("id")).distinct(), "id", "left_anti")
    top = organizations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top__"))  # one row
    made = alone.join(F.broadcast(top)).select((F.col("top__") + F.col("id") + 1).alias("key"), F.col("id").alias("user_id"), "name")
    new = made.select(F.col("key").alias("id"), F.concat("name", F.lit("'s Organization")).alias("name"), F.concat(owner_slug(F.col("name")), F.lit("-org-"), F.col("user_id").cast("string")).alias("slug"), F.lit("free").alias("plan"))
    owners = made.select("user_id", F.col("key").alias("organization_id"), F.lit("owner").alias("role"))
    return organizations.unionByName(new.select(*organizations.columns)), insert_ignore(memberships, owners, ["user_id", "organization_id"])


# --- constraints -----------------------------------------------------------------------------------------------


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, key: str) -> DataFrame:
    return children.filter(F.col(foreign).isNotNull()).join(parents.select(F.col(key).alias(foreign)), foreign, "left_anti")


def out_of_domain(df: DataFrame, column: str, domain: list[str]) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(domain))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])


def ownerless(organizations: DataFrame, memberships: DataFrame) -> DataFrame:
    """Organizations without an owner."""
    owners = memberships.filter("role = 'owner'").select(F.col("organization_id").alias("id"))
    return organizations.join(owners, "id", "left_anti")


def constraint_report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per check with its number of violations."""
    out = None
    for name, found in checks.items():
        row = found.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"))
        out = row if out is None else out.union(row)
    return out


def append_comments(rows: DataFrame, comments: DataFrame, key: str, column: str, order: list[str]) -> DataFrame:
    """JSON arrays with the comments of their key behind them, in order; what is not an array as a whole gives way to a new
    one.  comments: (key, order columns, and the comment's own fields)."""
    fields = [c for c in comments.columns if c not in (key, *order)]
    item = F.struct(F.struct(*order).alias("o"), F.to_json(F.struct(*fields)).alias("text"))
    add = comments.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["text"]).alias("add__"))
    return rows.join(add, key, "left").withColumn(column, F.when(F.col("add__").isNotNull(), appended(F.col(column), F.col("add__"))).otherwise(F.col(column))).select(*rows.columns)


def appended(comments: Column, texts: Column) -> Column:
    """A JSON array, as it parses, with JSON texts behind its items; anything else counts as an empty array."""
    # the parser stops after one value, so the text is parsed as the only item of an array
    whole = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), comments, F.lit("]"))), "$", "array<variant>")
    items = F.when(F.size(whole) == 1, F.try_variant_get(F.get(whole, F.lit(0)), "$", "array<variant>"))
    old = F.transform(F.coalesce(items, F.array().cast("array<variant>")), lambda x: F.to_json(x))
    return F.concat(F.lit("["), F.array_join(F.concat(old, texts), ","), F.lit("]"))


def append_comment(comments: Column, comment: Column) -> Column:
    """A JSON array of comments with one more at its end.  comment: a struct."""
    return appended(comments, F.array(F.to_json(comment)))
