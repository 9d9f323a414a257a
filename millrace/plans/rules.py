"""Queries of rules that compose several operators, and of parsing steps, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes as M
from ..operators import documents as D
from ..operators import enrich as X
from ..operators import listing as L
from ..operators import records as R
from ..sources import io
from .registry import _POINTS, query, table_query


def _text(*parts):
    """Texts and columns one after another."""
    return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])


@query("well_registry", sql=_POINTS.replace("CASE well_type WHEN 'XYZ' THEN 'Unknown' ELSE well_type END AS label", "CASE line_no % 4 WHEN 0 THEN 'Forest' WHEN 1 THEN 'Commercial' WHEN 2 THEN 'Water/Wetland' ELSE 'Unknown' END AS label") + """
, c AS (SELECT point_id, feature_id, label, distance FROM d WHERE feature_id % 6 <> 5 AND distance <= 1000 AND label <> 'Unknown'),
b AS (SELECT point_id, feature_id, label, row_number() OVER (PARTITION BY point_id ORDER BY distance, feature_id) AS n FROM c)
SELECT p.id AS point_id, coalesce(b.label, CASE WHEN p.lon IS NOT NULL THEN 'Unknown' END) AS label, b.feature_id FROM p LEFT JOIN b ON b.point_id = p.id AND b.n = 1""")
def land_use_of_wells(registry: DataFrame) -> DataFrame:
    """Land use of every well: features' tags tell their class, their centre or the middle of their bounds where they are."""
    n, lat, lon = F.col("line_no"), S.lenient_number(F.col("lat_text")), S.lenient_number(F.col("lon_text"))
    tags = F.when(n % 4 == 0, F.create_map(F.lit("landuse"), F.lit("Forest"))).when(n % 4 == 1, F.create_map(F.lit("building"), F.lit("Office block"))).when(n % 4 == 2, F.create_map(F.lit("name"), F.lit("Old River mouth"))).otherwise(F.create_map(F.lit("name"), F.lit("x")))
    centred, bounded = n % 2 == 0, (n % 6 != 5)
    # odd features have bounds only, and every sixth has one that is not finite
    low, high = F.when(bounded, lon - 0.001).otherwise(F.lit(float("nan"))), lon + 0.001
    features = registry.select(n.alias("feature_id"), tags.alias("tags"), F.when(centred, lat).alias("lat"), F.when(centred, lon).alias("lon"), (lat - 0.001).alias("minlat"), (lat + 0.001).alias("maxlat"), low.alias("minlon"), high.alias("maxlon"))
    points = registry.select(n.alias("point_id"), lat.alias("lat"), lon.alias("lon"))
    return X.land_use_of_points(points, features)


@query("job_files", "well_registry", "preview_items", sql="""
, r AS (SELECT DISTINCT trim(permit_no) AS k FROM well_registry),
f AS (SELECT id, job_id % 10 AS preview_id, coalesce(nullif(regexp_replace(regexp_extract(filename, '([0-9]+)', 1), '^0+', ''), ''), '0') AS key FROM job_files WHERE processing_status = 'completed'),
a AS (SELECT preview_id, id AS file_id FROM f JOIN r ON r.k = f.key UNION ALL SELECT preview_id, file_id FROM preview_items)
SELECT preview_id, file_id, count(*) AS copies FROM a GROUP BY 1, 2""")
def corrected_into_previews(files: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """Completed files whose key, corrected from their name, the registry knows are appended to their job's preview."""
    done = files.filter("processing_status = 'completed'")
    place = (F.col("job_id") % 10).alias("preview_id")
    recs = done.select("id", place, S.reconcile(S.permit_of_filename(F.col("filename")), S.first_with_digits([F.col("permit_number")]))[0].alias("permit"))
    found = X.merge(recs.withColumn("lease_name", F.lit("")), X.decode_registry(X.first_per_key(registry, "permit_no", "line_no")), "permit")
    added = found.filter("matched").select("preview_id", F.col("id").alias("file_id"))
    return items.select("preview_id", "file_id").unionByName(added).groupBy("preview_id", "file_id").agg(F.count("*").alias("copies"))


@query("organizations", "users", "memberships", sql="""
, t AS (SELECT max(id) AS top FROM organizations), a AS (SELECT u.id, u.name, t.top + u.id + 1 AS key FROM users u, t WHERE u.id NOT IN (SELECT user_id FROM memberships))
SELECT id, name, slug, plan, CAST(NULL AS BIGINT) AS owner FROM organizations UNION ALL
SELECT key, name || '''s Organization', regexp_replace(lower(name), '[^a-z0-9]', '-', 'g') || '-org-' || id, 'free', id FROM a""")
def owned_organizations(organizations: DataFrame, users: DataFrame, memberships: DataFrame) -> DataFrame:
    """All organizations after every user without one has got their own, and who owns the new ones."""
    both, members = M.with_owner_organizations(organizations, users, memberships)
    new = members.join(organizations.select(F.col("id").alias("organization_id")), "organization_id", "left_anti").filter("role = 'owner'")
    return both.join(new.select(F.col("organization_id").alias("id"), F.col("user_id").alias("owner")), "id", "left").select("id", "name", "slug", "plan", "owner")


@query("job_files", sql="""
, f AS (SELECT id, page_count AS n, size % 5 AS k FROM job_files)
SELECT id, CASE WHEN n = 2 THEN 'Invalid extraction_mode. Must be ''full_extraction'' or ''text_only''' WHEN k = 0 THEN 'processing_config must be an object'
  WHEN k = 1 AND n = 3 THEN 'Invalid extraction.method. Must be one of: mineru, documentai, extendai, paddleocr' WHEN k = 2 THEN 'Invalid processing.method. Must be one of: openai, qwen'
  WHEN k = 3 AND n <> 4 THEN 'Invalid processing.model for openai. Must be one of: gpt-4o, gpt-4o-2024-08-06, gpt-4, gpt-3.5-turbo' END AS fault FROM f""")
def request_faults(files: DataFrame) -> DataFrame:
    """The first reason against each request: mode, shape of the configuration, methods, model of its method."""
    n, k = F.col("page_count"), F.col("size") % 5
    mode = F.when(n == 2, "extraction_only").when(n == 3, "text_only").when(n == 4, "full_extraction")
    config = (
        F.when(k == 0, "[1]")
        .when(k == 1, F.when(n == 3, '{"extraction":{"method":"tea"}}').otherwise('{"extraction":{"method":"mineru"},"processing":{"method":""}}'))
        .when(k == 2, '{"processing":{"method":"tea","model":"gpt-4"}}')
        .when(k == 3, F.when(n == 4, '{"processing":{"method":"openai","model":"gpt-4"}}').otherwise('{"processing":{"method":"openai","model":"qwen-max"}}'))
    )
    return files.select("id", S.request_fault(mode, config).alias("fault"))


@query("users", sql="SELECT id, CAST(row_number() OVER (ORDER BY invited_by ASC NULLS LAST, id) AS BIGINT) AS place FROM users ORDER BY place LIMIT 500")
def users_by_inviter(users: DataFrame) -> DataFrame:
    """The first five hundred users by inviter, those without one last."""
    shown = L.page(users.select("id", "invited_by"), [F.col("invited_by").asc_nulls_last(), F.col("id")], 500, 0)
    return shown.withColumn("place", F.row_number().over(Window.orderBy(F.col("invited_by").asc_nulls_last(), "id")).cast("long")).select("id", "place")


@table_query("documents", sql="""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x, doc_id % 2 AS kind FROM documents), b AS (SELECT doc_id, kind, unnest(x) AS content, unnest(range(0, len(x))) AS p, len(x) AS n FROM l),
o AS (SELECT doc_id, 'blocks' AS origin, (max(n) - 1) // 5 + 1 AS n_pages, count(*) FILTER (WHERE p % 7 = 3 AND p % 5 <> 0 AND trim(content) <> '') AS n_tables, max(n - 1) // 5 * 2 + CAST(sum(CASE WHEN p % 5 = 0 THEN length(content) ELSE 0 END) AS BIGINT) AS text_length FROM b WHERE kind = 0 GROUP BY 1),
c AS (SELECT doc_id, 'chunks' AS origin, count(*) FILTER (WHERE p % 7 <> 3) AS n_pages, count(*) FILTER (WHERE p % 7 = 3) AS n_tables, CAST(sum(CASE WHEN p % 7 <> 3 THEN length(content) + 2 ELSE 0 END) - 2 AS BIGINT) AS text_length FROM b WHERE kind = 1 GROUP BY 1)
SELECT * FROM o UNION ALL SELECT * FROM c""")
def unified_extractions(documents: DataFrame) -> DataFrame:
    """Both payload kinds from their JSON text to one record: pages, tables and text length of every document."""
    lines = documents.select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n").alias("x"))
    label = lambda p: F.when(p % 5 == 0, "header").when(p % 7 == 3, "table").otherwise("text")
    block = lambda x, p: F.struct(p.cast("string").alias("blockId"), label(p).alias("blockLabel"), x.alias("blockContent"))
    blocks = F.transform("x", block)
    page_no = F.sequence(F.lit(0), F.floor((F.size("x") - 1) / 5).cast("int"))
    pages = F.transform(page_no, lambda k: F.struct(k.alias("pageIndex"), F.struct(F.get("x", k * 5).alias("text")).alias("markdown"), F.slice(blocks, k * 5 + 1, F.lit(5)).alias("sourceBlocks")))
    ocr = lines.filter("doc_id % 2 = 0").select("doc_id", F.to_json(F.struct(F.col("doc_id").cast("string").alias("documentId"), pages.alias("pages"))).alias("payload"))
    chunk = F.transform("x", lambda x, p: F.struct(F.when(p % 7 == 3, "table").otherwise("page").alias("type"), x.alias("content")))
    chunks = lines.filter("doc_id % 2 = 1").select("doc_id", F.to_json(F.struct(chunk.alias("chunks"))).alias("payload"))
    found = D.unified(D.parse_ocr(ocr), D.parse_chunks(chunks))
    return found.select("doc_id", "origin", F.col("n_pages").cast("long").alias("n_pages"), F.col("n_tables").cast("long").alias("n_tables"), F.length("text").cast("long").alias("text_length"))


@query("file_events", sql="SELECT CAST(file_id AS STRING) AS file_id, CAST(job_id AS STRING) AS job_id, CAST(event_id % 10 AS INTEGER) AS priority, event_id AS stamp FROM file_events WHERE event_id % 4 < 2")
def queue_items(events: DataFrame) -> DataFrame:
    """Queue items from JSON lines; lines that are cut off or lack the file are skipped."""
    n = F.col("event_id").cast("string")
    good = _text('{"fileId":"', F.col("file_id").cast("string"), '","jobId":"', F.col("job_id").cast("string"), '","priority":', (F.col("event_id") % 10).cast("string"), ',"timestamp":', n, "}")
    line = F.when(F.col("event_id") % 4 < 2, good).when(F.col("event_id") % 4 == 2, F.substring(good, 1, 9)).otherwise(_text('{"jobId":"', n, '"}'))
    found = io.parse_items(events.select(line.alias("value")))
    return found.select(F.col("fileId").alias("file_id"), F.col("jobId").alias("job_id"), "priority", F.col("timestamp").alias("stamp"))


@query("job_files", sql="SELECT id, CASE page_count % 3 WHEN 2 THEN NULL ELSE size END AS n FROM job_files")
def double_encoded(files: DataFrame) -> DataFrame:
    """A number in JSON, also where the JSON stands in a JSON string; what does not parse is null."""
    plain = _text('{"n":', F.col("size").cast("string"), "}")
    k = F.col("page_count") % 3
    text = F.when(k == 0, plain).when(k == 1, _text('"', F.replace(plain, F.lit('"'), F.lit('\\"')), '"')).otherwise("{n")
    return files.select("id", F.try_variant_get(R.reparsed(text), "$.n", "bigint").alias("n"))


@table_query("documents", sql="SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, CASE doc_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/msword' ELSE 'application/octet-stream' END AS content_type FROM documents")
def content_hashes(documents: DataFrame) -> DataFrame:
    """Hash and type of every document's content."""
    name = F.when(F.col("doc_id") % 3 == 0, "a.PDF").when(F.col("doc_id") % 3 == 1, "b.doc").otherwise("c.bin")
    return documents.select("doc_id", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("file_hash"), S.content_type(name).alias("content_type"))


@query("job_files", sql="SELECT id, CAST(CASE WHEN page_count % 2 = 0 THEN page_count WHEN page_count = 1 THEN 3 WHEN page_count = 3 THEN 9 END AS INTEGER) AS page_count FROM job_files")
def page_count_backfill(files: DataFrame) -> DataFrame:
    """Missing page counts from the stored pages (an array's length, a number, else nothing); known ones stay."""
    n = F.col("page_count")
    pages = F.when(n == 1, "[1,2,3]").when(n == 3, "9").when(n == 5, "[]").otherwise('"none"')
    rows = files.select("id", F.when(n % 2 == 0, n).alias("page_count"), pages.alias("pages"))
    return M.backfill(rows, "page_count", S.page_count(F.col("pages"), F.lit(None).cast("int"))).select("id", F.col("page_count").cast("int").alias("page_count"))


@query("job_files", "preview_items", sql="SELECT id, size FROM job_files WHERE id IN (SELECT file_id FROM preview_items)")
def files_in_any_preview(files: DataFrame, items: DataFrame) -> DataFrame:
    return L.in_dataset(files.select("id", "size"), items.select(F.col("file_id").alias("id")), "id")


@query("job_files", sql="SELECT count(*) FILTER (WHERE permit_number IS NULL) AS permit_number, count(*) FILTER (WHERE elevation IS NULL) AS elevation, count(*) FILTER (WHERE id IS NULL) AS id FROM job_files")
def null_report(files: DataFrame) -> DataFrame:
    return M.null_counts(files, ["permit_number", "elevation", "id"])


@query("job_files", sql="""
SELECT id, CASE WHEN page_count % 3 = 0 THEN CAST(page_count AS DOUBLE) WHEN page_count % 3 = 1 THEN page_count + 0.5 END AS lat, CASE WHEN page_count % 3 = 0 THEN -1.0::DOUBLE WHEN page_count % 3 = 1 THEN -2.5::DOUBLE END AS lon FROM job_files""")
def feature_centres(files: DataFrame) -> DataFrame:
    """A feature's own centre, else the middle of its bounds, else nothing where a side is not finite."""
    n = F.col("page_count").cast("double")
    k = F.col("page_count") % 3
    own = lambda v: F.when(k == 0, v)
    at = S.feature_centre(own(n), own(F.lit(-1.0)), n, n + 1, F.when(k == 2, F.lit(float("inf"))).otherwise(F.lit(-3.0)), F.lit(-2.0))
    return files.select("id", at.alias("at")).select("id", "at.lat", "at.lon")
