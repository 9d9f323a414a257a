"""More named queries: projections, key lookups, JSON columns, single-row views and queue figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import changes as M
from ..operators import documents as D
from ..operators import enrich as X
from ..operators import listing as L
from ..operators import records as R
from ..streaming import flows
from .registry import _MINE, _POINTS, USER, _arrays, _payload, _points, query, table_query


@query("job_files", sql="SELECT id, job_id, filename, size, extraction_status, processing_status FROM job_files WHERE job_id = 100")
def file_detail_narrow(files: DataFrame) -> DataFrame:
    return L.where_given(files, job_id=100).select("id", "job_id", "filename", "size", "extraction_status", "processing_status")


@query("job_files", sql="SELECT count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM job_files WHERE extraction_status = 'failed' OR processing_status = 'failed'")
def failed_in_either_stage(files: DataFrame) -> DataFrame:
    return files.filter(L.in_either(("extraction_status", "processing_status"), "failed")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


@query("users", "organizations", sql="SELECT u.id, u.name, u.email, o.id AS org_id, o.name AS org_name, o.plan AS org_plan FROM users u JOIN organizations o ON o.id = u.organization_id")
def user_profile(users: DataFrame, organizations: DataFrame) -> DataFrame:
    org = F.struct(F.col("o.id").alias("id"), F.col("o.name").alias("name"), F.col("o.plan").alias("plan"))
    nested = users.drop("login_count").alias("u").join(organizations.alias("o"), F.col("u.organization_id") == F.col("o.id")).select("u.id", "u.name", "u.email", org.alias("organization"))
    return nested.select("id", "name", "email", F.col("organization.id").alias("org_id"), F.col("organization.name").alias("org_name"), F.col("organization.plan").alias("org_plan"))


@query("jobs", sql="SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN NULL ELSE name END, 'Untitled job') AS name, coalesce(CASE WHEN id % 2 = 0 THEN extraction_mode END, 'full_extraction') AS mode, 'default' AS model FROM jobs")
def job_defaults(jobs: DataFrame) -> DataFrame:
    from ..sources.io import with_defaults

    raw = jobs.select("id", F.when(F.col("id") % 3 != 0, F.col("name")).alias("name"), F.when(F.col("id") % 2 == 0, F.col("extraction_mode")).alias("mode"))
    return with_defaults(raw, {"name": F.lit("Untitled job"), "mode": F.lit("full_extraction"), "model": F.lit("default")})


@query("job_files", sql="""
SELECT id, CAST(CASE page_count % 4 WHEN 0 THEN 3 WHEN 1 THEN size WHEN 2 THEN page_count + 10 ELSE page_count END AS BIGINT) AS pages FROM job_files""")
def page_counts(files: DataFrame) -> DataFrame:
    n = F.col("page_count") % 4
    payload = F.when(n == 0, '[{"a":1},{},{}]').when(n == 1, F.col("size").cast("string")).when(n == 2, F.concat(F.lit('{"total":'), (F.col("page_count") + 10).cast("string"), F.lit("}")))
    return files.select("id", S.page_count(payload, F.col("page_count")).cast("long").alias("pages"))


@query("jobs", "users", sql="""
, c AS (SELECT id AS job_id, user_id AS uid, 0 AS pos FROM jobs WHERE id % 4 <> 1 UNION ALL SELECT id, user_id + 1000000, 1 FROM jobs WHERE id % 4 <> 1)
SELECT c.job_id, CAST(c.pos AS BIGINT) AS pos, u.id AS user_id, coalesce(u.name, 'unknown') AS name FROM c LEFT JOIN users u ON u.id = c.uid""")
def collaborators(jobs: DataFrame, users: DataFrame) -> DataFrame:
    mail = lambda k: F.concat(F.lit('{"email":"customer.'), F.lpad((F.col("user_id") + k).cast("string"), 9, "0"), F.lit('@example.com"}'))
    raw = jobs.select("id", F.when(F.col("id") % 4 == 1, F.lit("{}")).otherwise(F.concat(F.lit("["), mail(0), F.lit(","), mail(1000000), F.lit("]"))).alias("people"))
    rows = M.json_array_rows(raw, "id", "people", "struct<email:string>").select(F.col("id").alias("job_id"), F.col("pos").cast("long").alias("pos"), F.col("item.email").alias("email"))
    return rows.join(users.select("email", F.col("id").alias("user_id"), "name"), "email", "left").select("job_id", "pos", "user_id", F.coalesce("name", F.lit("unknown")).alias("name"))


@query("preview_items", sql="SELECT DISTINCT preview_id FROM preview_items WHERE file_id = (SELECT max(file_id) FROM preview_items)")
def previews_of_file(items: DataFrame) -> DataFrame:
    newest = items.agg(F.max("file_id").alias("f"))
    return _arrays(items).crossJoin(F.broadcast(newest)).filter(F.array_contains("items", F.col("f"))).select("preview_id")  # one row


@query("users", sql="SELECT id, CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END || ',' || CASE WHEN id % 3 = 0 THEN 'y' ELSE 'x' END || ',z' AS config FROM users")
def config_merge(users: DataFrame) -> DataFrame:
    old = F.create_map(F.lit("k"), F.lit("a"), F.lit("l"), F.lit("x"), F.lit("m"), F.lit("z"))
    new = F.map_filter(F.create_map(F.lit("k"), F.when(F.col("id") % 2 == 0, "b"), F.lit("l"), F.when(F.col("id") % 3 == 0, "y")), lambda _, v: v.isNotNull())
    m = S.merge_maps(old, new)
    return users.select("id", F.concat_ws(",", m["k"], m["l"], m["m"]).alias("config"))


@table_query("documents", sql="""
SELECT doc_id, length('Extract the fields of this JSON schema:' || chr(10) || '{}' || chr(10) || chr(10) || 'Document:' || chr(10) || coalesce(text, '')) AS n FROM documents""")
def prompt_lengths(documents: DataFrame) -> DataFrame:
    text = S.text_for_model(F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(""), F.col("text"))
    return documents.select("doc_id", F.length(R.prompt(text, F.lit("{}"))).cast("long").alias("n"))


@query("job_files", sql="SELECT id, unnest(range(1, page_count + 1)) AS page_no FROM job_files WHERE page_count > 0")
def placeholder_pages(files: DataFrame) -> DataFrame:
    return D.placeholder_pages(files, "id", "page_count").select("id", F.col("page_no").cast("long").alias("page_no"))


@table_query("documents", sql="SELECT doc_id, CAST(0 AS DOUBLE) AS seconds, 'pdf' AS file_type, (len(string_split(coalesce(text, ''), chr(10))) - 1) // 5 + 1 AS n_pages FROM documents")
def extraction_metadata(documents: DataFrame) -> DataFrame:
    docs = _payload(documents).withColumn("doc", F.col("doc").withField("extractionMetadata", F.lit(None).cast("struct<extractionTimeSeconds:double,fileType:string>")))
    pages = D.page_rows(docs)
    return D.extraction_metadata(docs, D.document_totals(pages, D.block_rows(pages))).select("doc_id", "seconds", "file_type", "n_pages")


@query("job_files", "well_registry", "preview_items", sql="""
, r AS (SELECT trim(permit_no) AS k, arg_min(api_wellno, line_no) AS api, arg_min(lease_name, line_no) AS lease FROM well_registry GROUP BY 1),
f AS (SELECT id, coalesce(nullif(regexp_replace(regexp_extract(filename, '([0-9]+)', 1), '^0+', ''), ''), '0') AS key, lease_name AS own FROM job_files)
SELECT f.id, f.key AS permit, r.api AS api_number, CASE WHEN f.own <> '' THEN f.own WHEN r.k IS NULL THEN f.own ELSE r.lease END AS lease_name FROM f LEFT JOIN r ON r.k = f.key""")
def corrected_records(files: DataFrame, registry: DataFrame, items: DataFrame) -> DataFrame:
    """The record's key is corrected from the file name, then enriched."""
    found = files.select("id", "lease_name", S.permit_of_filename(F.col("filename")).alias("f"), S.first_with_digits([F.col("permit_number")]).alias("d"))
    recs = found.select("id", "lease_name", S.reconcile(F.col("f"), F.col("d"))[0].alias("permit"))
    return X.merge(recs, X.decode_registry(X.first_per_key(registry, "permit_no", "line_no")), "permit").select("id", "permit", "api_number", "lease_name")


@query("well_registry", sql=_POINTS + " SELECT label, count(*) AS pairs FROM d WHERE distance <= 1000 AND point_id <> feature_id GROUP BY 1")
def near_pairs_by_label(registry: DataFrame) -> DataFrame:
    points, features = _points(registry)
    return X.within(points, features, 1000.0).filter("point_id <> feature_id").groupBy("label").agg(F.count("*").alias("pairs"))


@query("file_events", sql=", p AS (SELECT job_id, event_id, CAST(floor(value) AS BIGINT) AS score FROM file_events WHERE status = 'pending') SELECT job_id, event_id, score, row_number() OVER (PARTITION BY job_id ORDER BY score, event_id) AS place FROM p")
def queue_order(events: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    items = events.filter("status = 'pending'").select("job_id", "event_id", F.floor("value").cast("long").alias("score"))
    return items.withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("score", "event_id")).cast("long"))


@query("jobs", "job_files", "memberships", sql=f"""
, m AS (SELECT id FROM jobs WHERE organization_id IN ({_MINE}))
SELECT f.id, f.job_id, CASE WHEN f.job_id IN (SELECT id FROM m) THEN 'deleted' ELSE 'denied' END AS outcome FROM job_files f WHERE f.job_id % 6 = 0""")
def bulk_delete_outcomes(jobs: DataFrame, files: DataFrame, memberships: DataFrame) -> DataFrame:
    ask = files.filter("job_id % 6 = 0")
    own = L.accessible(jobs, memberships, USER).select(F.col("id").alias("job_id"), F.lit(True).alias("own"))
    return ask.join(own, "job_id", "left").select("id", "job_id", F.when(F.col("own"), "deleted").otherwise("denied").alias("outcome"))


@query("job_files", sql="SELECT id, coalesce(CASE WHEN page_count % 2 = 0 THEN TRUE END, page_count % 3 = 0) AS admin_verified, page_count > 3 AS customer_verified FROM job_files")
def verification_update(files: DataFrame) -> DataFrame:
    now = files.select("id", (F.col("page_count") % 3 == 0).alias("admin_verified"), (F.col("page_count") > 3).alias("customer_verified"))
    change = files.filter("page_count % 2 = 0").select("id", F.lit(True).alias("admin_verified"), F.lit(None).cast("boolean").alias("customer_verified"))
    return M.verification_update(now, change)


@query("job_files", sql="SELECT id, CASE WHEN page_count % 2 = 0 THEN '[1,2]' WHEN page_count % 3 = 0 THEN NULL ELSE '[7]' END AS pages FROM job_files")
def pages_or_stored(files: DataFrame) -> DataFrame:
    """Pages from the raw payload, else those stored, else none."""
    raw = F.when(F.col("page_count") % 2 == 0, F.lit('{"pages":[1,2]}')).otherwise(F.lit('{"other":1}'))
    stored = F.when(F.col("page_count") % 3 != 0, F.lit("[7]"))
    return files.select("id", F.coalesce(F.to_json(F.try_variant_get(F.try_parse_json(raw), F.lit("$.pages"), "variant")), stored).alias("pages"))


@query("jobs", "job_files", sql="""
, s AS (SELECT job_id, count(*) AS n FROM job_files GROUP BY 1), f AS (SELECT job_id, count(*) AS failed FROM job_files WHERE processing_status = 'failed' GROUP BY 1)
SELECT s.job_id, s.n, f.failed FROM s LEFT JOIN f ON f.job_id = s.job_id""")
def combined_results(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Two result sets by id, the first one kept whole."""
    counts = files.groupBy("job_id").agg(F.count("*").alias("n"))
    failed = files.filter("processing_status = 'failed'").groupBy("job_id").agg(F.count("*").alias("failed"))
    return counts.join(failed, "job_id", "left")


@query("users", sql="SELECT id, email FROM users WHERE id % 4 <> 0 AND TIMESTAMP '2024-01-01' + to_days(CAST(id % 30 AS INTEGER)) > TIMESTAMP '2024-01-15'")
def open_invitations(users: DataFrame) -> DataFrame:
    from ..streaming.flows import active_sessions

    expires = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(F.col("id") % 30).cast("int"))
    rows = users.select("id", "email", expires.alias("expires_at"), F.when(F.col("id") % 4 == 0, F.lit("2024-01-02")).alias("accepted_at"))
    return active_sessions(rows, F.lit("2024-01-15").cast("timestamp_ntz"), accepted="accepted_at").select("id", "email")


@query("job_files", sql="""
SELECT CASE WHEN review_status IN ('pending', 'in_review', 'reviewed') THEN 'valid' ELSE 'unknown status' END AS verdict, count(*) AS n FROM job_files GROUP BY 1""")
def requested_statuses(files: DataFrame) -> DataFrame:
    """Requested values against a domain table."""
    spark = files.sparkSession
    domain = spark.createDataFrame([(s,) for s in ("pending", "in_review", "reviewed")], "review_status string").withColumn("ok", F.lit(True))
    return files.join(F.broadcast(domain), "review_status", "left").groupBy(F.when(F.col("ok"), "valid").otherwise("unknown status").alias("verdict")).agg(F.count("*").alias("n"))


@query("job_files", "well_registry", sql="""
, r AS (SELECT trim(permit_no) AS k, arg_min(api_wellno, line_no) AS api FROM well_registry GROUP BY 1), f AS (SELECT id, ltrim(nullif(regexp_replace(permit_number, '[^0-9]', '', 'g'), ''), '0') AS key FROM job_files WHERE id = (SELECT max(id) FROM job_files))
SELECT f.id, coalesce(r.api, 'no match') AS api_number FROM f LEFT JOIN r ON r.k = f.key""")
def single_enrichment(files: DataFrame, registry: DataFrame) -> DataFrame:
    """The bulk rule for one file; a miss is named."""
    newest = files.agg(F.max("id").alias("id"))
    one = files.join(F.broadcast(newest), "id", "left_semi").select("id", S.normal_permit(S.digits_of(F.col("permit_number"))).alias("key"))
    return X.merge(one, X.decode_registry(X.first_per_key(registry, "permit_no", "line_no")), "key").select("id", F.coalesce("api_number", F.lit("no match")).alias("api_number"))


# --- rules that the tables' own values do not show -------------------------------------------------------------


@query("job_files", sql="""
, f AS (SELECT id, size, CASE size % 3 WHEN 0 THEN filename WHEN 1 THEN filename || '.Gif' ELSE filename || '.exe' END AS name, CASE size % 4 WHEN 0 THEN 'image/webp' WHEN 1 THEN 'application/zip' WHEN 3 THEN 'text/plain' END AS mime FROM job_files)
SELECT id, CASE WHEN NOT (coalesce(mime IN ('image/webp', 'text/plain'), false) OR regexp_matches(lower(name), '\\.(pdf|txt|docx?|png|jpe?g|gif|bmp|tiff?|webp)$')) THEN 'type' WHEN size > 52428800 THEN 'size' END AS reject_reason FROM f""")
def upload_admission(files: DataFrame) -> DataFrame:
    """The default rule: extension or content type."""
    name = F.when(F.col("size") % 3 == 0, F.col("filename")).when(F.col("size") % 3 == 1, F.concat("filename", F.lit(".Gif"))).otherwise(F.concat("filename", F.lit(".exe")))
    mime = F.when(F.col("size") % 4 == 0, "image/webp").when(F.col("size") % 4 == 1, "application/zip").when(F.col("size") % 4 == 3, "text/plain")
    return L.admission(files.select("id", "size", name.alias("filename"), mime.alias("mime")), mime="mime").select("id", "reject_reason")


ITEMS = {"type": "object", "properties": {"n": {"type": "integer", "enum": [1, 2, 3]}, "casing": {"type": "array", "items": {"type": "object", "additionalProperties": False, "required": ["size"], "properties": {"size": {"type": "number"}, "depth": {"type": ["integer", "null"]}}}}}}


@query("job_files", sql="""
SELECT id, concat_ws('; ', CASE WHEN page_count > 3 THEN '$.n: enum' END, CASE WHEN page_count = 3 THEN '$.casing[0].size: type; $.casing[0]: unknown zz' ELSE '$.casing[1].size: required' END, CASE WHEN page_count = 2 THEN '$.casing[2].depth: type' END) AS violations FROM job_files""")
def record_item_conformance(files: DataFrame) -> DataFrame:
    """Required keys, types and unknown keys inside array items, and an enum of numbers."""
    n = F.col("page_count")
    more = F.when(n == 2, ',{"size":1,"depth":"deep"}').otherwise("")
    items = F.when(n == 3, '{"size":"x","zz":1}').otherwise(F.concat(F.lit('{"size":2.5,"depth":null},{"depth":1}'), more))
    text = F.concat(F.lit('{"n":'), n.cast("string"), F.lit(',"casing":['), items, F.lit("]}"))
    return files.select("id", text.alias("result")).select("id", F.array_join(R.violations("result", ITEMS), "; ").alias("violations"))


@query("job_files", sql="""
SELECT id, CASE size % 4 WHEN 0 THEN nullif(regexp_replace(permit_number, '[^0-9]', '', 'g'), '') WHEN 1 THEN '7' || size WHEN 2 THEN '12' END AS permit FROM job_files""")
def record_permits(files: DataFrame) -> DataFrame:
    """The permit of a JSON record: the first of its keys that is a string with digits."""
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    k = F.col("size") % 4
    record = (
        F.when(k == 0, text('{"wellPermit":"', F.coalesce("permit_number", F.lit("none")), '"}'))
        .when(k == 1, text('{"permit_number":"none","permitNo":', F.col("size").cast("string"), ',"drilling_permit":"7-', F.col("size").cast("string"), '"}'))
        .when(k == 2, F.lit('{"permit_id":"99","permit":"No. 12"}'))
        .otherwise(F.lit('{"permit":5}'))
    )
    return files.select("id", S.permit_of_record(record).alias("permit"))


@table_query("documents", sql="SELECT doc_id, CASE doc_id % 2 WHEN 0 THEN '=== PAGE 1 ===' || chr(10) ELSE '' END AS feed FROM documents")
def document_feed_bare(documents: DataFrame) -> DataFrame:
    """Pages without blocks keep their heading; documents without pages have an empty feed."""
    first = F.slice("doc.pages", 1, 1)
    bare = F.transform(first, lambda p: p.withField("sourceBlocks", F.slice(p["sourceBlocks"], 1, 0)))
    docs = _payload(documents).withColumn("doc", F.col("doc").withField("pages", F.when(F.col("doc_id") % 2 == 0, bare)))
    return D.feed(D.block_rows(D.page_rows(docs)), blocked=True)


@query("users", sql="SELECT id, 'new' AS a, CASE WHEN id % 2 = 0 THEN NULL ELSE 'old' END AS b, 'kept' AS c, 'added' AS d FROM users")
def config_merge_sections(users: DataFrame) -> DataFrame:
    """Sections are merged key by key; an incoming null wins."""
    section = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v)]).cast("map<string,string>")
    old = F.create_map(F.lit("extraction"), section(a=F.lit("old"), b=F.lit("old")), F.lit("processing"), section(c=F.lit("kept")))
    fresh = F.when(F.col("id") % 2 == 0, section(a=F.lit("new"), b=F.lit(None))).otherwise(section(a=F.lit("new")))
    m = S.merge_config(old, F.create_map(F.lit("extraction"), fresh, F.lit("other"), section(d=F.lit("added"))))
    return users.select("id", m["extraction"]["a"].alias("a"), m["extraction"]["b"].alias("b"), m["processing"]["c"].alias("c"), m["other"]["d"].alias("d"))


@query("file_events", sql="""
, f AS (SELECT job_id, file_id, arg_max(status, (ts, event_id)) AS status FROM file_events GROUP BY 1, 2), n AS (SELECT job_id, count(*) AS files, count(*) FILTER (WHERE status = 'completed') AS completed FROM f GROUP BY 1)
SELECT job_id, files, completed, CASE WHEN files = completed THEN 'completed' WHEN completed > 0 THEN 'partial' ELSE 'failed' END AS job_status FROM n""")
def job_states(events: DataFrame) -> DataFrame:
    newest = events.groupBy("job_id", "file_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return flows.rollup_of(newest)


@query("file_events", sql="""
, w AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) FILTER (WHERE status = 'pending') AS waiting, count(*) FILTER (WHERE status = 'processing') AS active, coalesce(avg(value * 1000) FILTER (WHERE status = 'pending'), 0) AS wait FROM file_events GROUP BY 1),
s AS (SELECT *, greatest(0, 100 - CASE WHEN waiting > 100 THEN 20 WHEN waiting > 50 THEN 10 ELSE 0 END - CASE WHEN active > 10 THEN 15 WHEN active > 5 THEN 5 ELSE 0 END - CASE WHEN wait > 300000 THEN 25 WHEN wait > 60000 THEN 10 ELSE 0 END) AS score FROM w)
SELECT window_start, waiting, active, CAST(score AS BIGINT) AS score, CASE WHEN score < 50 THEN 'critical' WHEN score < 75 THEN 'warning' ELSE 'healthy' END AS health FROM s""")
def queue_waits(events: DataFrame) -> DataFrame:
    """Queue health by mean wait, an event's value being its wait in seconds."""
    m = flows.queue_metrics(events, wait_ms=F.col("value") * 1000)
    return m.select("window_start", "waiting", "active", F.col("score").cast("long").alias("score"), "health")


@query("users", sql="""
SELECT id, CASE id % 3 WHEN 0 THEN '[{"text":"old"},{"user":' || id || ',"text":"ok"}]' ELSE '[{"user":' || id || ',"text":"ok"}]' END AS comments FROM users""")
def commented(users: DataFrame) -> DataFrame:
    """A comment appended to a JSON array; what is not an array gives way."""
    old = F.when(F.col("id") % 3 == 0, '[{"text":"old"}]').when(F.col("id") % 3 == 1, "[ ]")
    return users.select("id", M.append_comment(old, F.struct(F.col("id").alias("user"), F.lit("ok").alias("text"))).alias("comments"))


@query("job_files", "preview_items", sql="""
, l AS (SELECT DISTINCT file_id, preview_id FROM preview_items),
g AS (SELECT file_id, string_agg(preview_id || ':Preview ' || preview_id || ':' || (20000 + preview_id), ',' ORDER BY preview_id) AS p FROM l GROUP BY 1)
SELECT f.id, coalesce(g.p, '') AS previews FROM job_files f LEFT JOIN g ON g.file_id = f.id""")
def file_preview_details(files: DataFrame, items: DataFrame) -> DataFrame:
    """Each file's previews as records of id, name and time of creation."""
    previews = _arrays(items).withColumn("name", F.concat(F.lit("Preview "), F.col("preview_id").cast("string"))).withColumn("created_at", F.col("preview_id") + 20000)
    rows = L.previews_by_file(files.select("id"), previews, ("name", "created_at"))
    shown = F.transform("previews", lambda p: F.concat_ws(":", p["preview_id"].cast("string"), p["name"], p["created_at"].cast("string")))
    return rows.select("id", F.array_join(shown, ",").alias("previews"))


@query("job_files", sql="""
SELECT id, CASE page_count WHEN 1 THEN NULL WHEN 2 THEN 'done' ELSE review_status END AS review_status, CASE page_count WHEN 2 THEN NULL ELSE size END AS size FROM job_files""")
def presence_updates(files: DataFrame) -> DataFrame:
    """A change sets what it lists, null too, and leaves the rest."""
    n = F.col("page_count")
    listed = F.when(n == 1, F.array(F.lit("review_status"))).when(n == 2, F.array(F.lit("review_status"), F.lit("size"))).otherwise(F.array().cast("array<string>"))
    changes = files.select("id", F.when(n == 2, "done").alias("review_status"), F.lit(None).cast("bigint").alias("size"), listed.alias("given"))
    return M.partial_update(files.select("id", "review_status", "size"), changes, ["id"], ["review_status", "size"], "given")
