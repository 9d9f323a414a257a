"""Named queries over the fixture views, each with the same query as SQL text where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes as M
from ..operators import documents as D
from ..operators import enrich as X
from ..operators import listing as L
from ..operators import records as R
from ..operators import stats as A
from ..sources.fixtures import oracle, read, view
from ..streaming import flows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
USER = 7


def query(*views: str, sql: str | None = None, name: str | None = None):
    """Register a function of (frames of the named views); sql: the query's body over the same views."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = lambda spark, sf_dir: f(*[view(spark, sf_dir, v) for v in views])
        if sql is not None:
            ORACLES[key] = oracle(*views, body=sql)
        return f

    return add


def table_query(*tables: str, sql: str | None = None):
    """The same over base tables."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read(spark, sf_dir, t) for t in tables])
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- statistics ------------------------------------------------------------------------------------------------

query("jobs", "job_files", name="job_statistics", sql="""
SELECT j.id AS job_id, j.name, j.status, count(f.id) AS total_files,
  count(*) FILTER (WHERE f.extraction_status = 'completed') AS extracted_files,
  count(*) FILTER (WHERE f.processing_status = 'completed') AS processed_files,
  count(*) FILTER (WHERE f.extraction_status = 'failed') AS extraction_failed,
  count(*) FILTER (WHERE f.processing_status = 'failed') AS processing_failed,
  CAST(sum(f.size) AS BIGINT) AS total_bytes
FROM jobs j LEFT JOIN job_files f ON f.job_id = j.id GROUP BY j.id, j.name, j.status""")(A.job_statistics)

query("jobs", "job_files", name="system_statistics", sql="""
SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'queued') AS queued_jobs, count(*) FILTER (WHERE status = 'processing') AS processing_jobs,
  count(*) FILTER (WHERE status = 'completed') AS completed_jobs, count(*) FILTER (WHERE status = 'partial') AS partial_jobs,
  count(*) FILTER (WHERE status = 'failed') AS failed_jobs, (SELECT count(*) FROM job_files) AS total_files,
  (SELECT count(*) FROM job_files WHERE extraction_status = 'completed') AS extracted_files,
  (SELECT count(*) FROM job_files WHERE processing_status = 'completed') AS processed_files,
  (SELECT CAST(sum(size) AS BIGINT) FROM job_files) AS total_bytes FROM jobs""")(A.system_statistics)

_ORG_EXACT = """
, u AS (SELECT organization_id, count(*) AS n, count(*) FILTER (WHERE role = 'owner') AS o, count(*) FILTER (WHERE role = 'admin') AS a,
          count(*) FILTER (WHERE role = 'member') AS m, count(*) FILTER (WHERE role = 'viewer') AS v FROM {people} GROUP BY 1),
j AS (SELECT organization_id, count(*) AS n, count(*) FILTER (WHERE status = 'completed') AS c FROM jobs GROUP BY 1),
f AS (SELECT organization_id, count(*) AS n, sum(size) AS b FROM job_files JOIN jobs ON job_files.job_id = jobs.id GROUP BY 1)
SELECT g.id, g.name, coalesce(u.n, 0) AS total_users, coalesce(u.o, 0) AS owner_count, coalesce(u.a, 0) AS admin_count, coalesce(u.m, 0) AS member_count,
  coalesce(u.v, 0) AS viewer_count, coalesce(j.n, 0) AS total_jobs, coalesce(f.n, 0) AS total_files, coalesce(j.c, 0) AS completed_jobs, CAST(f.b AS BIGINT) AS total_bytes
FROM organizations g LEFT JOIN u ON u.organization_id = g.id LEFT JOIN j ON j.organization_id = g.id LEFT JOIN f ON f.organization_id = g.id"""
query("organizations", "users", "jobs", "job_files", name="organization_statistics_exact", sql=_ORG_EXACT.format(people="users"))(A.organization_statistics)
query("organizations", "memberships", "jobs", "job_files", name="membership_statistics", sql=_ORG_EXACT.format(people="(SELECT DISTINCT user_id, organization_id, role FROM memberships)"))(A.membership_statistics)

#: The fan-out join itself would take users times jobs times files rows; its counts as arithmetic on the branches.
query("organizations", "users", "jobs", "job_files", name="organization_statistics_literal", sql="""
, u AS (SELECT organization_id, count(*) AS n, count(*) FILTER (WHERE role = 'owner') AS o, count(*) FILTER (WHERE role = 'admin') AS a,
          count(*) FILTER (WHERE role = 'member') AS m, count(*) FILTER (WHERE role = 'viewer') AS v FROM users GROUP BY 1),
r AS (SELECT j.organization_id, j.id, j.status, f.id AS fid, f.size FROM jobs j LEFT JOIN job_files f ON f.job_id = j.id),
j AS (SELECT organization_id, count(*) AS n, count(DISTINCT id) AS jobs, count(fid) AS files, count(*) FILTER (WHERE status = 'completed') AS c, sum(size) AS b FROM r GROUP BY 1)
SELECT g.id, g.name, coalesce(u.n, 0) AS total_users, CAST(coalesce(u.o, 0) * greatest(coalesce(j.n, 0), 1) AS BIGINT) AS owner_count,
  CAST(coalesce(u.a, 0) * greatest(coalesce(j.n, 0), 1) AS BIGINT) AS admin_count, CAST(coalesce(u.m, 0) * greatest(coalesce(j.n, 0), 1) AS BIGINT) AS member_count,
  CAST(coalesce(u.v, 0) * greatest(coalesce(j.n, 0), 1) AS BIGINT) AS viewer_count, coalesce(j.jobs, 0) AS total_jobs, coalesce(j.files, 0) AS total_files,
  CAST(coalesce(j.c, 0) * greatest(coalesce(u.n, 0), 1) AS BIGINT) AS completed_jobs, CAST(j.b * greatest(coalesce(u.n, 0), 1) AS BIGINT) AS total_bytes
FROM organizations g LEFT JOIN u ON u.organization_id = g.id LEFT JOIN j ON j.organization_id = g.id""")(lambda *t: A.organization_statistics(*t, mode="literal"))

query("users", "jobs", "job_files", name="user_statistics", sql="""
, f AS (SELECT job_id, count(*) AS n, sum(size) AS b FROM job_files GROUP BY 1)
SELECT u.id AS user_id, u.name, count(j.id) AS total_jobs, count(*) FILTER (WHERE j.status = 'completed') AS completed_jobs,
  CAST(coalesce(sum(f.n), 0) AS BIGINT) AS total_files, CAST(coalesce(sum(f.b), 0) AS BIGINT) AS total_bytes
FROM users u LEFT JOIN jobs j ON j.user_id = u.id LEFT JOIN f ON f.job_id = j.id GROUP BY u.id, u.name""")(A.user_statistics)

query("job_files", name="job_summary", sql="""
SELECT job_id, count(*) AS total_files, """ + ", ".join(f"count(*) FILTER (WHERE {s}_status = '{v}') AS {s}_{v}" for s in ("extraction", "processing") for v in ("pending", "processing", "completed", "failed")) + """,
  count(*) FILTER (WHERE extraction_status = 'completed' AND processing_status = 'completed') AS fully_completed,
  count(*) FILTER (WHERE extraction_status = 'failed' OR processing_status = 'failed') AS any_failed FROM job_files GROUP BY job_id""")(A.job_summary)

_CLASSES = """count(*) AS total, count(*) FILTER (WHERE extraction_status = 'completed' AND processing_status = 'completed') AS processed,
  count(*) FILTER (WHERE extraction_status = 'processing' OR processing_status = 'processing') AS processing,
  count(*) FILTER (WHERE extraction_status = 'pending' AND processing_status = 'pending') AS pending"""
query("job_files", name="files_by_status_class", sql=f"SELECT job_id, {_CLASSES} FROM job_files GROUP BY job_id")(lambda f: A.file_stats(f, ["job_id"]))
query("job_files", name="file_stats_of_no_job", sql=f"SELECT {_CLASSES} FROM job_files WHERE FALSE")(lambda f: A.file_stats(L.where_given(f, job_id=[])))
query("job_files", name="processing_totals_filtered", sql="""
SELECT count(*) AS total, """ + ", ".join(f"count(*) FILTER (WHERE processing_status = '{v}') AS {v}" for v in ("pending", "processing", "completed", "failed")) + """
FROM job_files WHERE extraction_status = 'completed' AND review_status IN ('reviewed', 'approved')""")(lambda f: A.processing_totals(L.where_given(f, extraction_status="completed", review_status=["reviewed", "approved"], job_id=None)))
query("job_files", name="job_rollup", sql="""
SELECT job_id, count(*) AS files, count(*) FILTER (WHERE extraction_status = 'completed' AND processing_status = 'completed') AS done,
  CASE WHEN count(*) FILTER (WHERE extraction_status = 'completed' AND processing_status = 'completed') = count(*) THEN 'completed'
       WHEN count(*) FILTER (WHERE extraction_status = 'completed' AND processing_status = 'completed') > 0 THEN 'partial' ELSE 'failed' END AS rollup
FROM job_files GROUP BY job_id""")(A.job_rollup)

# --- listings and access ---------------------------------------------------------------------------------------

_MINE = f"SELECT organization_id FROM memberships WHERE user_id = {USER}"
query("jobs", "job_files", "memberships", name="job_listing_page", sql=f"""
, p AS (SELECT id, name, status, created_at FROM jobs WHERE organization_id IN ({_MINE}) ORDER BY created_at DESC NULLS FIRST, id LIMIT 20 OFFSET 40)
SELECT p.id AS job_id, p.name, p.status, p.created_at, count(f.id) AS file_count FROM p LEFT JOIN job_files f ON f.job_id = p.id GROUP BY 1, 2, 3, 4""")(lambda j, f, m: L.job_listing(j, f, m, USER, 20, 40))
query("jobs", "memberships", name="job_listing_metadata", sql=f"""
SELECT CAST(3 AS BIGINT) AS page, CAST(20 AS BIGINT) AS page_size, count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages
FROM jobs WHERE organization_id IN ({_MINE})""")(lambda j, m: L.page_metadata(L.accessible(j, m, USER).agg(F.count("*").alias("total")), 20, 40).withColumns({"page": F.col("page").cast("long"), "page_size": F.col("page_size").cast("long")}))


def _arrays(items: DataFrame) -> DataFrame:
    return items.groupBy("preview_id").agg(F.sort_array(F.collect_list("file_id")).alias("items"))


@query("job_files", "preview_items", sql="""
, l AS (SELECT DISTINCT preview_id, file_id FROM preview_items), g AS (SELECT file_id, string_agg(CAST(preview_id AS VARCHAR), ',' ORDER BY preview_id) AS p FROM l GROUP BY 1)
SELECT f.id, f.filename, coalesce(g.p, '') AS previews FROM job_files f LEFT JOIN g ON g.file_id = f.id""")
def file_previews(files: DataFrame, items: DataFrame) -> DataFrame:
    return L.previews_by_file(files, _arrays(items)).select("id", "filename", F.array_join("previews", ",").alias("previews"))


@query("preview_items", sql="SELECT preview_id, nullif(count(*), 0) AS item_count, count(DISTINCT file_id) AS n_files FROM preview_items GROUP BY 1")
def preview_cardinality(items: DataFrame) -> DataFrame:
    return _arrays(items).select("preview_id", F.nullif(F.size("items"), F.lit(0)).cast("long").alias("item_count"), F.size(F.array_distinct("items")).cast("long").alias("n_files"))


@query("job_files", "preview_items", sql="""
SELECT DISTINCT i.preview_id, f.id FROM preview_items i JOIN job_files f ON f.id = i.file_id WHERE f.processing_status = 'completed' AND f.permit_number IS NOT NULL""")
def previews_of_available_files(files: DataFrame, items: DataFrame) -> DataFrame:
    ready = R.available_files(files, "permit_number").select("id")
    return _arrays(items).select("preview_id", F.explode(F.array_distinct("items")).alias("id")).join(ready, "id", "left_semi").select("preview_id", "id")


query("users", name="members_with_inviter", sql="SELECT u.id, u.name, u.role, u.organization_id, i.name AS inviter FROM users u LEFT JOIN users i ON u.invited_by = i.id")(L.with_inviter)
query("users", "memberships", name="users_without_membership", sql="SELECT * FROM users WHERE id NOT IN (SELECT user_id FROM memberships)")(L.without_membership)


@query("memberships", "jobs", "job_files", sql=f"""
, q AS (SELECT DISTINCT CASE WHEN job_id % 17 = 0 THEN 'x' || id ELSE id END AS file_id FROM job_files WHERE job_id % 3 = 0)
SELECT q.file_id, f.id IS NOT NULL AND coalesce(j.organization_id IN ({_MINE}), FALSE) AS accessible,
  CASE WHEN f.id IS NULL THEN 'File not found' WHEN NOT coalesce(j.organization_id IN ({_MINE}), FALSE) THEN 'Access denied' END AS reason
FROM q LEFT JOIN job_files f ON f.id = q.file_id LEFT JOIN jobs j ON j.id = f.job_id""")
def access_partition(memberships: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    ids = files.filter("job_id % 3 = 0").select(F.when(F.col("job_id") % 17 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("file_id"))
    return L.access_partition(ids, files, jobs, memberships, USER)


@query("users", "memberships", sql="""
, m AS (SELECT user_id, organization_id, max(CASE role WHEN 'viewer' THEN 0 WHEN 'member' THEN 1 WHEN 'admin' THEN 2 WHEN 'owner' THEN 3 ELSE -1 END) AS rank FROM memberships GROUP BY 1, 2)
SELECT u.id, m.organization_id, m.rank >= 2 AS is_admin FROM users u JOIN m ON m.user_id = u.id""")
def role_check(users: DataFrame, memberships: DataFrame) -> DataFrame:
    ranked = memberships.groupBy(F.col("user_id").alias("id"), "organization_id").agg(F.max(S.role_rank(F.col("role"))).alias("rank"))
    return users.select("id").join(ranked, "id").select("id", "organization_id", (F.col("rank") >= 2).alias("is_admin"))


@query("job_files", sql="""
SELECT id, CASE WHEN lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) = '.pdf' THEN 'pdf' WHEN regexp_matches(filename, '(?i)\\.(png|jpe?g|gif|bmp|tiff?|webp)$') THEN 'image' ELSE 'other' END AS kind,
  CASE WHEN lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) = '.pdf' THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type,
  CASE WHEN lower(regexp_extract(filename, '(\\.[^.]+)$', 1)) <> '.pdf' THEN 'type' WHEN size > 40000 THEN 'size' END AS reject_reason FROM job_files""")
def file_admission(files: DataFrame) -> DataFrame:
    name = F.col("filename")
    return L.admission(files, allowed=(".pdf",), most=40000).select("id", S.document_kind(name).alias("kind"), S.content_type(name).alias("content_type"), "reject_reason")


@query("job_files", sql="SELECT DISTINCT job_id, extraction_status FROM job_files WHERE review_status IS NULL OR review_status <> 'pending'")
def distinct_job_keys(files: DataFrame) -> DataFrame:
    return files.filter(~F.col("review_status").eqNullSafe(F.lit("pending"))).select("job_id", "extraction_status").distinct()


@query("job_files", sql="""
, p AS (SELECT job_id, sum(size) AS v FROM job_files WHERE extraction_status = 'completed' GROUP BY 1), s AS (SELECT job_id, sum(page_count) AS v FROM job_files WHERE page_count > 3 GROUP BY 1)
SELECT coalesce(p.job_id, s.job_id) AS job_id, CAST(coalesce(p.v, s.v) AS BIGINT) AS v, CASE WHEN p.v IS NOT NULL THEN 'primary' ELSE 'secondary' END AS origin
FROM p FULL JOIN s ON p.job_id = s.job_id""")
def fallback_source(files: DataFrame) -> DataFrame:
    p = files.filter("extraction_status = 'completed'").groupBy("job_id").agg(F.sum("size").alias("v"))
    s = files.filter("page_count > 3").groupBy("job_id").agg(F.sum("page_count").alias("v"))
    return L.fallback(p, s, "job_id", "v")


# --- enrichment ------------------------------------------------------------------------------------------------


@query("job_files", sql="""
, k AS (SELECT id, nullif(regexp_extract(filename, '([0-9]+)', 1), '') AS f, nullif(regexp_replace(permit_number, '[^0-9]', '', 'g'), '') AS d FROM job_files),
n AS (SELECT id, CASE WHEN f IS NOT NULL THEN coalesce(nullif(regexp_replace(f, '^0+', ''), ''), '0') END AS f, CASE WHEN d IS NOT NULL THEN coalesce(nullif(regexp_replace(d, '^0+', ''), ''), '0') END AS d FROM k)
SELECT id, coalesce(f, d) AS permit, f IS NOT DISTINCT FROM d AS agrees FROM n""")
def permit_reconciled(files: DataFrame) -> DataFrame:
    # Step by step, so that each pattern runs once a row.
    found = files.select("id", S.permit_of_filename(F.col("filename")).alias("f"), S.first_with_digits([F.col("permit_number")]).alias("d"))
    permit, agrees = S.reconcile(F.col("f"), F.col("d"))
    return found.select("id", permit.alias("permit"), agrees.alias("agrees"))


_REGISTRY = """
, r AS (SELECT *, trim(permit_no) AS k, row_number() OVER (PARTITION BY trim(permit_no) ORDER BY line_no) AS n FROM well_registry),
g AS (SELECT k, nullif(api_wellno, '') AS api_number, nullif(lease_name, '') AS lease_name, regexp_replace(nullif(well_no, ''), '^([A-Za-z0-9]+)\\s*/\\s*([A-Za-z0-9]+)$', '\\1-\\2') AS well_number,
  CAST(nullif(regexp_extract(lat_text, '^-?[0-9.]+', 0), '') AS DOUBLE) AS latitude, CAST(nullif(regexp_extract(lon_text, '^-?[0-9.]+', 0), '') AS DOUBLE) AS longitude,
  CAST(nullif(regexp_extract(elev_ref, '^-?[0-9.]+', 0), '') AS DOUBLE) AS elevation,
  CASE ref_tops WHEN 'K' THEN 'Kelly Bushing' WHEN 'G' THEN 'Ground' WHEN 'R' THEN 'Rotary Table' WHEN 'D' THEN 'Drill Floor' END AS elevation_datum,
  CASE well_type WHEN 'GAS' THEN 'Gas Production' WHEN 'OIL' THEN 'Oil Production' WHEN 'DH' THEN 'Dry Hole' WHEN 'MTW' THEN 'Mineral' ELSE nullif(well_type, '') END AS well_type,
  CASE slant WHEN 'H' THEN 'Horizontal' WHEN 'D' THEN 'Deviated' WHEN 'V' THEN 'Straight' END AS deviation FROM r WHERE n = 1),
f AS (SELECT id, job_id, lease_name AS own_lease, elevation AS own_elevation, ltrim(nullif(regexp_replace(permit_number, '[^0-9]', '', 'g'), ''), '0') AS key FROM job_files)"""


def _records(files: DataFrame) -> DataFrame:
    return files.select("id", "job_id", "lease_name", "elevation", S.normal_permit(S.digits_of(F.col("permit_number"))).alias("key"))


_FOUND = ("api_number", "lease_name", "well_number", "latitude", "longitude", "elevation", "elevation_datum", "well_type", "deviation")


@query("well_registry", sql=_REGISTRY[: _REGISTRY.index(",\nf AS")] + " SELECT k, " + ", ".join(_FOUND) + " FROM g")
def registry_decoded(registry: DataFrame) -> DataFrame:
    return X.decode_registry(X.first_per_key(registry, "permit_no", "line_no")).select("k", *_FOUND)


@query("job_files", "well_registry", sql=_REGISTRY + """
SELECT f.id, g.k IS NOT NULL AS matched, g.api_number, g.latitude, g.longitude, CASE WHEN coalesce(own_lease, '') <> '' THEN own_lease WHEN g.k IS NULL THEN own_lease ELSE g.lease_name END AS lease_name,
  CASE WHEN g.k IS NULL OR coalesce(own_elevation, 0) <> 0 THEN own_elevation ELSE g.elevation END AS elevation, g.well_number, g.elevation_datum, g.well_type, g.deviation
FROM f LEFT JOIN g ON g.k = f.key""")
def registry_enriched(files: DataFrame, registry: DataFrame) -> DataFrame:
    found = X.decode_registry(X.first_per_key(registry, "permit_no", "line_no"))
    return X.merge(_records(files), found, "key").select("id", "matched", *_FOUND)


@query("job_files", "well_registry", sql=_REGISTRY + """
, q AS (SELECT DISTINCT CASE WHEN job_id % 19 = 0 THEN 'x' || id ELSE id END AS file_id FROM job_files),
o AS (SELECT q.file_id, CASE WHEN f.id IS NULL THEN 'not_found' WHEN coalesce(f.key, '') = '' THEN 'no_key' WHEN g.k IS NULL THEN 'no_match' ELSE 'enriched' END AS outcome
      FROM q LEFT JOIN f ON f.id = q.file_id LEFT JOIN g ON g.k = f.key)
SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'enriched') AS enriched, count(*) FILTER (WHERE outcome = 'no_match') AS no_match,
  count(*) FILTER (WHERE outcome = 'no_key') AS no_key, count(*) FILTER (WHERE outcome = 'not_found') AS not_found FROM o""")
def enrichment_outcomes(files: DataFrame, registry: DataFrame) -> DataFrame:
    ids = files.select(F.when(F.col("job_id") % 19 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("file_id"))
    merged = X.merge(_records(files), X.decode_registry(X.first_per_key(registry, "permit_no", "line_no")), "key")
    return A.outcome_summary(X.enrichment_outcome(ids, merged, "key"), values=("enriched", "no_match", "no_key", "not_found"))


_POINTS = """
, p AS (SELECT line_no AS id, CAST(lat_text AS DOUBLE) AS lat, CAST(nullif(lon_text, '') AS DOUBLE) AS lon, CASE well_type WHEN 'XYZ' THEN 'Unknown' ELSE well_type END AS label FROM well_registry),
d AS (SELECT a.id AS point_id, b.id AS feature_id, b.label, 2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) AS distance
      FROM p a JOIN p b ON abs(a.lat - b.lat) < 0.02 AND abs(a.lon - b.lon) < 0.03)"""


def _points(registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    p = registry.select(F.col("line_no").alias("point_id"), S.lenient_number(F.col("lat_text")).alias("lat"), S.lenient_number(F.col("lon_text")).alias("lon"), F.when(F.col("well_type") == "XYZ", "Unknown").otherwise(F.col("well_type")).alias("label"))
    p = p.filter("lon IS NOT NULL")
    return p.select("point_id", "lat", "lon"), p.select(F.col("point_id").alias("feature_id"), "label", F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))


@query("well_registry", sql=_POINTS + " SELECT point_id, count(*) AS n_near, CAST(sum(feature_id) AS BIGINT) AS ids FROM d WHERE distance <= 1000 GROUP BY 1")
def features_within(registry: DataFrame) -> DataFrame:
    points, features = _points(registry)
    return X.near_sums(points, features, 1000.0)


@query("well_registry", sql=_POINTS + """
, b AS (SELECT point_id, feature_id, label, row_number() OVER (PARTITION BY point_id ORDER BY distance, feature_id) AS n FROM d WHERE distance <= 1000 AND label <> 'Unknown' AND point_id <> feature_id)
SELECT p.id AS point_id, coalesce(b.label, 'Unknown') AS label FROM p LEFT JOIN b ON b.point_id = p.id AND b.n = 1 WHERE p.lon IS NOT NULL""")
def nearest_feature(registry: DataFrame) -> DataFrame:
    points, features = _points(registry)
    return X.nearest_other_label(points, features)


@table_query("part", sql="""
SELECT p_partkey AS id, CASE p_partkey % 9 WHEN 0 THEN 'Residential' WHEN 1 THEN 'Public/Open' WHEN 2 THEN 'Transportation' WHEN 3 THEN 'Transportation' WHEN 4 THEN 'Commercial'
  WHEN 5 THEN 'Residential' WHEN 6 THEN 'Commercial' WHEN 7 THEN 'Water/Wetland' ELSE 'Unknown' END AS land_use FROM part""")
def land_use(part: DataFrame) -> DataFrame:
    tags = ({"landuse": "Residential"}, {"leisure": "park"}, {"amenity": "parking"}, {"highway": "primary"}, {"building": "Office block"}, {"building": "house"}, {"shop": "bakery"}, {"name": "Old River mouth"}, {"name": "x"})
    pick = None
    for k, t in enumerate(tags):
        m = F.create_map(*[F.lit(x) for kv in t.items() for x in kv])
        pick = (F if pick is None else pick).when(F.col("p_partkey") % len(tags) == k, m)
    return part.withColumn("tags", pick).select(F.col("p_partkey").alias("id"), X.land_use_class("tags").alias("land_use"))


_PLAN = f"""
, q AS (SELECT DISTINCT file_id FROM (SELECT id AS file_id FROM job_files UNION ALL SELECT 'x' || id FROM job_files WHERE job_id % 23 = 0) z),
f AS (SELECT q.file_id, f.job_id, f.extraction_status = 'completed' AS done, f.permit_number IS NOT NULL AS txt, j.organization_id IN ({_MINE}) AS own,
        f.job_id % 5 = 0 AS queued, f.job_id % 7 = 0 AS active FROM q LEFT JOIN job_files f ON f.id = q.file_id LEFT JOIN jobs j ON j.id = f.job_id)
SELECT file_id, coalesce(NOT done, FALSE) AS will_extract, coalesce(txt OR NOT done, FALSE) AS will_process,
  CASE WHEN job_id IS NULL THEN 'File not found' WHEN NOT coalesce(own, FALSE) THEN 'Access denied' WHEN done AND NOT txt THEN 'No extracted text available for AI processing'
       WHEN done THEN 'Extraction already completed (use forceExtraction: true to override)' WHEN queued THEN 'File already in processing queue' WHEN active THEN 'File currently being processed' END AS skip_reason,
  CASE WHEN job_id IS NOT NULL AND coalesce(own, FALSE) AND NOT done AND NOT queued AND NOT active THEN 'both' END AS queue_mode FROM f"""


@query("memberships", "jobs", "job_files", sql=_PLAN)
def reprocess_plan(memberships: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    ask = files.select(F.col("id").alias("file_id")).union(files.filter("job_id % 23 = 0").select(F.concat(F.lit("x"), "id")))
    mine = L.accessible(jobs, memberships, USER).select(F.col("id").alias("job_id"))
    rows = files.select("id", "job_id", "extraction_status", F.col("permit_number").isNotNull().alias("has_text"))
    queue = lambda n: files.filter(f"job_id % {n} = 0").select(F.col("id").alias("file_id"))
    return X.reprocess_plan(rows, mine, queue(5), queue(7), requested=ask)


# --- documents -------------------------------------------------------------------------------------------------

_BLOCKS = """WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents), b AS (SELECT doc_id, unnest(x) AS content, unnest(range(0, len(x))) AS p FROM l),
d AS (SELECT doc_id, p, p // 5 AS page, content, CASE WHEN p = 0 THEN 'doc_title' WHEN p % 5 = 0 THEN 'header' WHEN p % 7 = 3 THEN 'table' WHEN p % 5 = 4 THEN 'footer' ELSE 'text' END AS label FROM b),
k AS (SELECT *, trim(content, ' ') AS c FROM d WHERE trim(content, ' ') <> '')
"""


def _payload(documents: DataFrame) -> DataFrame:
    """Documents as nested payloads: five lines a page."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    label = lambda p: F.when(p == 0, "doc_title").when(p % 5 == 0, "header").when(p % 7 == 3, "table").when(p % 5 == 4, "footer").otherwise("text")
    block = lambda p, x: F.struct(F.concat(F.lit("b"), p.cast("string")).alias("blockId"), label(p).alias("blockLabel"), x.alias("blockContent"))
    page = lambda g: F.struct(g.cast("int").alias("pageIndex"), F.struct(F.array_join(F.slice("lines", g * 5 + 1, F.lit(5)), "\n").alias("text")).alias("markdown"), F.transform(F.slice("lines", g * 5 + 1, F.lit(5)), lambda x, k: block(g * 5 + k, x)).alias("sourceBlocks"), F.lit(None).cast("double").alias("pageHeight"), F.lit(None).cast("double").alias("pageWidth"))
    return documents.select("doc_id", lines.alias("lines")).select("doc_id", F.struct(F.transform(F.sequence(F.lit(0), F.expr("(size(lines) - 1) div 5").cast("int")), page).alias("pages")).alias("doc"))


def _block_rows(documents: DataFrame) -> DataFrame:
    return D.block_rows(D.page_rows(_payload(documents)))


@table_query("documents", sql=_BLOCKS + "SELECT doc_id, page AS page_pos, p % 5 AS block_pos, 'b' || p AS block_id, label, content FROM d")
def document_blocks(documents: DataFrame) -> DataFrame:
    b = _block_rows(documents)
    return b.select("doc_id", F.col("page_pos").cast("long").alias("page_pos"), F.col("block_pos").cast("long").alias("block_pos"), "block_id", "label", "content")


@table_query("documents", sql=_BLOCKS + "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS table_no, replace(content, '\\\"', '''') AS content FROM k WHERE label = 'table'")
def document_tables(documents: DataFrame) -> DataFrame:
    return D.tables(_block_rows(documents)).select("doc_id", F.col("table_no").cast("long").alias("table_no"), "content")


_FORMAT = "CASE label WHEN 'doc_title' THEN '# ' || c WHEN 'header' THEN '## ' || c WHEN 'footer' THEN '*' || c || '*' ELSE c END"


@table_query("documents", sql=_BLOCKS + f"SELECT doc_id, string_agg({_FORMAT} || chr(10), chr(10) ORDER BY p) AS feed FROM k GROUP BY 1")
def document_feed(documents: DataFrame) -> DataFrame:
    return D.feed(_block_rows(documents))


@table_query("documents", sql=_BLOCKS + f""", g AS (SELECT doc_id, page, p, '[BLOCK: b' || p || ']' || chr(10) || chr(10) || {_FORMAT} || chr(10) AS x FROM k),
h AS (SELECT DISTINCT d.doc_id, d.page, '=== PAGE ' || (d.page + 1) || ' ===' || chr(10) AS x FROM d),
u AS (SELECT doc_id, page, -1 AS p, x FROM h UNION ALL SELECT doc_id, page, p, x FROM g)
SELECT doc_id, string_agg(x, chr(10) ORDER BY page, p) AS feed FROM u GROUP BY 1""")
def document_feed_blocked(documents: DataFrame) -> DataFrame:
    return D.feed(_block_rows(documents), blocked=True)


@table_query("documents", sql=_BLOCKS + """, t AS (SELECT doc_id, count(*) AS n FROM k WHERE label = 'table' GROUP BY 1), g AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY p) AS x FROM d GROUP BY 1, 2)
SELECT g.doc_id, count(*) AS n_pages, CAST(sum(length(g.x)) AS BIGINT) AS text_length, coalesce(any_value(t.n), 0) AS n_tables FROM g LEFT JOIN t ON t.doc_id = g.doc_id GROUP BY 1""")
def document_totals(documents: DataFrame) -> DataFrame:
    pages = D.page_rows(_payload(documents))
    return D.document_totals(pages, D.block_rows(pages))


@table_query("documents", sql=_BLOCKS + """, g AS (SELECT doc_id, page, string_agg(content, chr(10) ORDER BY p) AS x FROM d GROUP BY 1, 2)
SELECT doc_id, string_agg(x, chr(10) || chr(10) ORDER BY page) AS text FROM g GROUP BY 1""")
def document_text(documents: DataFrame) -> DataFrame:
    return D.document_text(D.page_rows(_payload(documents)))


@table_query("documents", sql=_BLOCKS + """, c AS (SELECT doc_id, p, CASE WHEN label = 'table' THEN 'table' WHEN label = 'text' THEN 'page' ELSE 'other' END AS kind, p % 4 AS s FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY p) AS r FROM c)
SELECT doc_id, p AS pos, kind, CASE WHEN kind = 'page' THEN coalesce(nullif(s, 0), r) END AS page_no FROM n""")
def chunk_routing(documents: DataFrame) -> DataFrame:
    blocks = _block_rows(documents).withColumn("p", F.col("page_pos") * 5 + F.col("block_pos"))
    kind = F.when(F.col("label") == "text", "page").otherwise(F.col("label"))
    chunk = F.struct("p", F.struct(kind.alias("type"), "content", F.struct(F.struct((F.col("p") % 4).alias("start"), F.lit(None).cast("int").alias("end")).alias("pageRange")).alias("metadata")).alias("c"))
    docs = blocks.groupBy("doc_id").agg(F.struct(F.transform(F.array_sort(F.collect_list(chunk)), lambda s: s["c"]).alias("chunks")).alias("doc"))
    return D.route_chunks(docs).select("doc_id", F.col("pos").cast("long").alias("pos"), "kind", F.col("page_no").cast("long").alias("page_no"))


@table_query("part", sql="""
WITH s AS (SELECT p_partkey AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9\\s-]', '', 'g'), '\\s+', '-', 'g'), '-+', '-', 'g')) AS base FROM part)
SELECT id, CASE WHEN row_number() OVER w = 1 THEN base ELSE base || '-' || (row_number() OVER w - 1) END AS slug FROM s WINDOW w AS (PARTITION BY base ORDER BY id)""")
def unique_slugs(part: DataFrame) -> DataFrame:
    return L.unique_slugs(part.select(F.col("p_partkey").alias("id"), S.slug(F.col("p_name")).alias("base")), "base", "id").select("id", "slug")


@table_query("part", sql="SELECT p_partkey AS id, 'Well ' || p_name AS title, CASE WHEN p_size > 25 THEN 'ab' ELSE 'x' END || p_name AS raw FROM part")
def cleaned_titles(part: DataFrame) -> DataFrame:
    title = S.clean_title(F.concat(F.lit('"Job Well '), "p_name", F.lit(' Extraction"')))
    raw = S.sanitised(F.concat(F.lit(" "), F.when(F.col("p_size") > 25, "a<b>").otherwise("x"), F.lit("javascript:"), "p_name", F.lit(" ")))
    return part.select(F.col("p_partkey").alias("id"), title.alias("title"), raw.alias("raw"))


# --- records ---------------------------------------------------------------------------------------------------

#: A small record schema: a required key, an enum that allows null, and nested numbers.
RECORD = {"type": "object", "additionalProperties": False, "required": ["permit"], "properties": {"permit": {"type": "string", "description": "key"}, "elevation": {"type": ["number", "null"]}, "review": {"type": ["string", "null"], "enum": ["reviewed", "approved", None]}, "casing": {"type": "array", "items": {"type": "object", "properties": {"size": {"type": "number"}, "depth": {"type": "integer"}}}}}}


def _json(files: DataFrame) -> DataFrame:
    """Records as JSON text made from files: some lack the key, some have it as a number, some are cut off."""
    permit = F.when(F.col("permit_number").isNull(), "").when(F.col("page_count") == 2, F.concat(F.lit('"permit":'), F.col("size").cast("string"), F.lit(","))).otherwise(F.concat(F.lit('"permit":"'), "permit_number", F.lit('",')))
    casing = F.concat(F.lit('"casing":[{"size":1.5,"depth":'), F.col("page_count").cast("string"), F.lit('},{"size":2.5,"depth":'), F.col("size").cast("string"), F.lit("}]"))
    text = F.concat(F.lit("{"), permit, F.lit('"review":"'), "review_status", F.lit('",'), casing, F.when(F.col("page_count") == 3, ',"zz":1').otherwise(""), F.when(F.col("page_count") == 5, "").otherwise("}"))
    return files.select("id", "job_id", "page_count", "size", "permit_number", "review_status", text.alias("result"))


@query("job_files", sql="""
, v AS (SELECT id, page_count = 5 AS bad, permit_number IS NULL AS miss, permit_number IS NOT NULL AND page_count = 2 AS kind, review_status NOT IN ('reviewed', 'approved') AS dom, page_count = 3 AS extra FROM job_files)
SELECT id, CASE WHEN bad THEN '$: json' ELSE concat_ws('; ', CASE WHEN miss THEN '$.permit: required' END, CASE WHEN kind THEN '$.permit: type' END, CASE WHEN dom THEN '$.review: enum' END, CASE WHEN extra THEN '$: unknown zz' END) END AS violations FROM v""")
def record_conformance(files: DataFrame) -> DataFrame:
    return _json(files).select("id", F.array_join(R.violations("result", RECORD), "; ").alias("violations"))


@query("job_files", sql="SELECT CASE WHEN page_count = 5 THEN 'truncated' ELSE 'ok' END AS outcome, count(*) AS n FROM job_files GROUP BY 1")
def record_outcomes(files: DataFrame) -> DataFrame:
    return _json(files).select(R.parse_outcome("result").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("job_files", sql="""
, c AS (SELECT id, CAST(0 AS BIGINT) AS pos, 1.5 AS size, CAST(page_count AS BIGINT) AS depth FROM job_files WHERE page_count <> 5 UNION ALL SELECT id, 1, 2.5, size FROM job_files WHERE page_count <> 5)
SELECT id, pos, CAST(size AS DOUBLE) AS size, depth FROM c UNION ALL SELECT id, NULL, NULL, NULL FROM job_files WHERE page_count = 5""")
def record_children(files: DataFrame) -> DataFrame:
    rows = R.typed(_json(files), "result", RECORD).select("id", "record.casing")
    return R.child_table(rows, "id", "casing").withColumn("pos", F.col("pos").cast("long"))


@query("preview_items", "job_files", sql="""
, l AS (SELECT DISTINCT preview_id, file_id FROM preview_items)
SELECT l.preview_id, f.id, CASE WHEN f.page_count = 5 THEN NULL WHEN f.page_count = 2 AND f.permit_number IS NOT NULL THEN CAST(f.size AS VARCHAR) ELSE f.permit_number END AS permit, CASE WHEN f.page_count <> 5 THEN f.review_status END AS review FROM l JOIN job_files f ON f.id = l.file_id""")
def preview_records(items: DataFrame, files: DataFrame) -> DataFrame:
    return R.preview_table(_arrays(items), _json(files), RECORD).select("preview_id", "id", "permit", "review")


@query("job_files", sql="""
SELECT id, CASE WHEN page_count <> 5 THEN review_status END AS review, CASE WHEN page_count <> 5 THEN CAST(2 + (CASE WHEN permit_number IS NULL THEN 0 ELSE 1 END) + (CASE WHEN page_count = 3 THEN 1 ELSE 0 END) - 1 AS BIGINT) END AS other_keys FROM job_files""")
def record_key_split(files: DataFrame) -> DataFrame:
    others, review = R.without_key(F.col("result"), "review")
    return _json(files).select("id", F.try_variant_get(review, F.lit("$"), "string").alias("review"), F.when(others.isNotNull(), F.size(others).cast("long")).alias("other_keys"))


# --- events, changes, constraints ------------------------------------------------------------------------------

query("file_events", name="latest_status", sql="SELECT file_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(status, (ts, event_id)) AS status FROM file_events GROUP BY 1")(flows.latest_status_batch)


@query("file_events", sql="""
, c AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS n FROM file_events WHERE status = 'completed') SELECT file_id, event_id, value FROM c WHERE n = 1""")
def first_completed(events: DataFrame) -> DataFrame:
    return X.first_by(events.filter("status = 'completed'"), "file_id", ["ts", "event_id"], ["event_id", "value"])


@query("file_events", sql="""
, c AS (SELECT *, lag(status) OVER w AS b, row_number() OVER w AS n FROM file_events WINDOW w AS (PARTITION BY file_id ORDER BY ts, event_id))
SELECT file_id, event_id, status, row_number() OVER (PARTITION BY file_id ORDER BY ts, event_id) AS version FROM c WHERE n = 1 OR status IS DISTINCT FROM b""")
def status_versions(events: DataFrame) -> DataFrame:
    return X.changed_versions(events, "file_id", ["ts", "event_id"], "status").select("file_id", "event_id", "status", F.col("version").cast("long").alias("version"))


@query("file_events", sql="SELECT time_bucket(INTERVAL '15 minutes', ts) AS window_start, job_id, count(*) AS requests FROM file_events GROUP BY 1, 2 HAVING count(*) > 1")
def request_rate_windows(events: DataFrame) -> DataFrame:
    return flows.request_rate(events, "job_id", 1)


@query("file_events", sql="""
, m AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) FILTER (WHERE status = 'pending') AS waiting, count(*) FILTER (WHERE status = 'processing') AS active FROM file_events GROUP BY 1),
s AS (SELECT *, CAST(greatest(0, 100 - CASE WHEN waiting > 100 THEN 20 WHEN waiting > 50 THEN 10 ELSE 0 END - CASE WHEN active > 10 THEN 15 WHEN active > 5 THEN 5 ELSE 0 END) AS BIGINT) AS score FROM m)
SELECT window_start, waiting, active, score, CASE WHEN score < 50 THEN 'critical' WHEN score < 75 THEN 'warning' ELSE 'healthy' END AS health FROM s""")
def queue_health(events: DataFrame) -> DataFrame:
    return flows.queue_metrics(events).select("window_start", "waiting", "active", F.col("score").cast("long").alias("score"), "health")


@query("file_events", sql="""
, t AS (SELECT file_id, arg_max(status, (ts, event_id)) AS status, arg_max(ts, (ts, event_id)) AS since FROM file_events GROUP BY 1)
SELECT file_id, since FROM t WHERE status = 'processing' AND since + INTERVAL '2 days' < (SELECT max(ts) FROM file_events)""")
def stuck_files(events: DataFrame) -> DataFrame:
    newest = events.agg(F.max("ts").alias("as_of"))
    last = events.groupBy("file_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("r")).crossJoin(F.broadcast(newest))  # one row
    return last.filter((F.col("r.status") == "processing") & (F.col("r.ts") + F.expr("INTERVAL 2 DAYS") < F.col("as_of"))).select("file_id", F.col("r.ts").alias("since"))


@query("file_events", sql="""
, q AS (SELECT event_id, file_id, CAST(floor(value) AS BIGINT) AS score FROM file_events WHERE status = 'pending') SELECT event_id, file_id, score FROM q ORDER BY score, event_id LIMIT 5""")
def next_in_queue(events: DataFrame) -> DataFrame:
    items = events.filter("status = 'pending'").select("event_id", "file_id", F.floor("value").cast("long").alias("score"))
    return L.page(items, [F.col("score"), F.col("event_id")], 5, 0)


@query("file_events", "users", sql="SELECT e.event_id, e.file_id AS user_id, u.name AS user_name FROM file_events e LEFT JOIN users u ON u.id = e.file_id")
def audit_feed(events: DataFrame, users: DataFrame) -> DataFrame:
    return flows.audit_with_users(events.select("event_id", F.col("file_id").alias("user_id")), users).select("event_id", "user_id", "user_name")


@query("job_files", sql="""
SELECT id, CASE WHEN job_id % 4 = 0 THEN CASE page_count % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'in_review' END ELSE review_status END AS review_status,
  CASE WHEN job_id % 4 <> 0 OR page_count % 3 = 2 THEN created_at WHEN page_count % 3 = 1 THEN TIMESTAMP '2024-01-01' END AS reviewed_at FROM job_files""")
def review_update(files: DataFrame) -> DataFrame:
    now = files.select("id", "review_status", F.col("created_at").alias("reviewed_at"))
    new = F.when(F.col("page_count") % 3 == 0, "pending").when(F.col("page_count") % 3 == 1, "approved").otherwise("in_review")
    return M.review_update(now, files.filter("job_id % 4 = 0").select("id", new.alias("status")), F.lit("2024-01-01").cast("timestamp_ntz"))


@query("job_files", sql="""
SELECT id, CASE WHEN page_count > 2 AND job_id % 2 = 0 THEN 'reviewed' ELSE review_status END AS review_status,
  CASE WHEN page_count > 2 AND job_id % 2 = 0 AND review_status <> 'reviewed' THEN created_at END AS reviewed_at FROM job_files""")
def verified_migration(files: DataFrame) -> DataFrame:
    rows = files.select("id", "review_status", F.lit(None).cast("timestamp_ntz").alias("reviewed_at"), F.col("created_at").alias("updated_at"), (F.col("page_count") > 2).alias("admin_verified"), (F.col("job_id") % 2 == 0).alias("customer_verified"))
    return M.verified_to_reviewed(rows).select("id", "review_status", "reviewed_at")


_CHANGE = "SELECT id AS user_id, organization_id, 'owner' AS role FROM users WHERE id % 6 = 0"
query("memberships", "users", name="upsert_membership", sql=f"""
, c AS ({_CHANGE}) SELECT coalesce(m.user_id, c.user_id) AS user_id, coalesce(m.organization_id, c.organization_id) AS organization_id, coalesce(c.role, m.role) AS role
FROM memberships m FULL JOIN c ON m.user_id = c.user_id AND m.organization_id = c.organization_id""")(lambda m, u: M.upsert(m, u.filter("id % 6 = 0").select(F.col("id").alias("user_id"), "organization_id", F.lit("owner").alias("role")), ["user_id", "organization_id"]))
query("memberships", "users", name="insert_ignore_membership", sql=f"""
SELECT user_id, organization_id, role FROM memberships UNION ALL
SELECT * FROM ({_CHANGE}) c WHERE NOT EXISTS (SELECT 1 FROM memberships m WHERE m.user_id = c.user_id AND m.organization_id = c.organization_id)""")(lambda m, u: M.insert_ignore(m, u.filter("id % 6 = 0").select(F.col("id").alias("user_id"), "organization_id", F.lit("owner").alias("role")), ["user_id", "organization_id"]))
query("users", "memberships", name="default_owner_organizations", sql="""
SELECT id AS user_id, regexp_replace(lower(name), '[^a-z0-9]', '-', 'g') || '-' || id AS slug, 'owner' AS role FROM users WHERE id NOT IN (SELECT user_id FROM memberships)""")(lambda u, m: L.without_membership(u, m).select(F.col("id").alias("user_id"), F.concat_ws("-", S.owner_slug(F.col("name")), "id").alias("slug"), F.lit("owner").alias("role")))
query("users", "file_events", name="login_counts", sql="""
, e AS (SELECT file_id, count(*) AS n FROM file_events GROUP BY 1) SELECT u.id, CAST(u.login_count + coalesce(e.n, 0) AS BIGINT) AS login_count FROM users u LEFT JOIN e ON e.file_id = u.id""")(lambda u, e: M.add_counts(u.select("id", F.col("login_count").cast("long").alias("login_count")), e.select(F.col("file_id").alias("id")), "id", "login_count"))
query("jobs", "job_files", name="cascade_delete", sql="SELECT id, job_id FROM job_files WHERE job_id IN (SELECT id FROM jobs WHERE status <> 'failed')")(lambda j, f: M.cascade(j.filter("status <> 'failed'"), f.select("id", "job_id"), "id", "job_id"))
query("users", "jobs", name="set_null_reference", sql="SELECT j.id, CASE WHEN u.id % 3 = 0 THEN NULL ELSE j.user_id END AS user_id FROM jobs j LEFT JOIN users u ON u.id = j.user_id")(lambda u, j: M.cascade(u.filter("id % 3 <> 0"), j.select("id", "user_id"), "id", "user_id", "set_null"))


@query("preview_items", sql="""
, a AS (SELECT preview_id, file_id FROM preview_items WHERE NOT contains(file_id, '-1-') UNION ALL SELECT DISTINCT preview_id, 'new-' || preview_id FROM preview_items)
SELECT preview_id, count(*) AS n, count(DISTINCT file_id) AS n_distinct FROM a GROUP BY 1""")
def preview_item_changes(items: DataFrame) -> DataFrame:
    rows = _arrays(items)
    gone = items.filter(F.contains("file_id", F.lit("-1-"))).select("preview_id", F.col("file_id").alias("item"))
    new = rows.select("preview_id", F.lit(0).alias("pos"), F.concat(F.lit("new-"), "preview_id").alias("item"))
    out = M.append_items(M.remove_items(rows, gone, "preview_id", "items"), new, "preview_id", "items")
    return out.select("preview_id", F.size("items").cast("long").alias("n"), F.size(F.array_distinct("items")).cast("long").alias("n_distinct"))


@query("job_files", sql="""
SELECT id, CASE WHEN extraction_status = 'completed' AND processing_status = 'completed' THEN 'already successful' WHEN page_count - 2 >= 3 THEN 'retry limit reached' ELSE 'retry' END AS outcome,
  CAST(5000 * pow(2, page_count) AS BIGINT) AS delay_ms FROM job_files""")
def retry_plan(files: DataFrame) -> DataFrame:
    rows = files.withColumn("retry_count", F.col("page_count") - 2)
    return M.retry_outcome(rows).select("id", "outcome", S.backoff_ms(F.col("page_count")).alias("delay_ms"))


@query("organizations", "users", "memberships", "jobs", "job_files", sql="""
SELECT 'unique_email' AS check_name, count(*) AS violations FROM (SELECT email FROM users GROUP BY 1 HAVING count(*) > 1) a UNION ALL
SELECT 'unique_membership', count(*) FROM (SELECT user_id, organization_id FROM memberships GROUP BY 1, 2 HAVING count(*) > 1) b UNION ALL
SELECT 'file_has_job', count(*) FROM job_files WHERE job_id NOT IN (SELECT id FROM jobs) UNION ALL
SELECT 'inviter_exists', count(*) FROM users WHERE invited_by IS NOT NULL AND invited_by NOT IN (SELECT id FROM users) UNION ALL
SELECT 'review_domain', count(*) FROM job_files WHERE review_status NOT IN ('pending', 'in_review', 'approved') UNION ALL
SELECT 'permit_not_null', count(*) FROM job_files WHERE permit_number IS NULL UNION ALL
SELECT 'has_owner', count(*) FROM organizations WHERE id NOT IN (SELECT organization_id FROM memberships WHERE role = 'owner')""")
def constraint_report(organizations: DataFrame, users: DataFrame, memberships: DataFrame, jobs: DataFrame, files: DataFrame) -> DataFrame:
    return M.constraint_report({
        "unique_email": M.duplicates(users, ["email"]),
        "unique_membership": M.duplicates(memberships, ["user_id", "organization_id"]),
        "file_has_job": M.orphans(files, jobs, "job_id", "id"),
        "inviter_exists": M.orphans(users, users.select("id"), "invited_by", "id"),
        "review_domain": M.out_of_domain(files, "review_status", ["pending", "in_review", "approved"]),
        "permit_not_null": files.filter("permit_number IS NULL"),
        "has_owner": M.ownerless(organizations, memberships),
    })
