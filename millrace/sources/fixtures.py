"""Views of the job, file and registry tables over the star-schema tables, in SQL that Spark and DuckDB both read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages")

VIEWS = {
    "organizations": """
SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name,
       lower(replace(n_name, '_', '-')) AS slug,
       CASE WHEN n_regionkey = 0 THEN 'free' WHEN n_regionkey < 3 THEN 'pro' ELSE 'enterprise' END AS plan
FROM nation
""",
    "users": """
SELECT c_custkey AS id, c_name AS name,
       lower(replace(c_name, '#', '.')) || '@example.com' AS email,
       CAST(c_nationkey AS BIGINT) AS organization_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin'
                         WHEN 'AUTOMOBILE' THEN 'viewer' ELSE 'member' END AS role,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 97 END AS invited_by,
       CAST(c_custkey % 50 AS INT) AS login_count
FROM customer
""",
    "memberships": """
SELECT c_custkey AS user_id, CAST(c_nationkey AS BIGINT) AS organization_id,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'owner' WHEN 'MACHINERY' THEN 'admin'
                         WHEN 'AUTOMOBILE' THEN 'viewer' ELSE 'member' END AS role
FROM customer WHERE c_custkey % 10 <> 9
UNION ALL
SELECT c_custkey AS user_id, CAST((c_nationkey + 7) % 25 AS BIGINT) AS organization_id, 'viewer' AS role
FROM customer WHERE c_custkey % 4 = 0
""",
    "jobs": """
SELECT o.o_orderkey AS id, 'Job ' || CAST(o.o_orderkey AS STRING) AS name,
       CASE o.o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed'
                             WHEN 3 THEN 'partial' ELSE 'failed' END AS status,
       o.o_custkey AS user_id, CAST(c.c_nationkey AS BIGINT) AS organization_id,
       CASE WHEN o.o_orderpriority = '5-LOW' THEN 'text_only' ELSE 'full_extraction' END AS extraction_mode,
       o.o_orderdate AS created_at
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
""",
    "job_files": """
SELECT CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
       CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id,
       l_orderkey AS job_id,
       'permit_' || lpad(CAST(l_partkey AS STRING), 6, '0') ||
         CASE WHEN l_linenumber = 1 THEN '.png' ELSE '.pdf' END AS filename,
       CAST(l_quantity * 1024 AS BIGINT) AS size,
       CAST(l_linenumber AS INT) AS page_count,
       CASE WHEN l_returnflag = 'R' THEN 'completed'
            WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'completed'
            WHEN l_returnflag = 'A' THEN 'failed'
            WHEN l_linestatus = 'O' THEN 'pending' ELSE 'processing' END AS extraction_status,
       CASE WHEN l_returnflag = 'N' OR (l_returnflag = 'A' AND l_linestatus = 'F') THEN 'pending'
            WHEN l_suppkey % 4 = 0 THEN 'processing' WHEN l_suppkey % 4 = 1 THEN 'failed'
            ELSE 'completed' END AS processing_status,
       CASE WHEN l_partkey % 11 = 0 THEN NULL
            WHEN l_partkey % 7 = 0 THEN 'No. ' || CAST(l_partkey + 1 AS STRING)
            ELSE lpad(CAST(l_partkey AS STRING), 6, '0') END AS permit_number,
       CASE WHEN l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) WHEN l_partkey % 5 = 1 THEN NULL
            ELSE l_extendedprice END AS elevation,
       CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'L-' || CAST(l_suppkey AS STRING) END AS lease_name,
       CASE l_linenumber % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'in_review' WHEN 2 THEN 'reviewed'
                             WHEN 3 THEN 'approved' ELSE 'rejected' END AS review_status,
       l_shipdate AS created_at
FROM lineitem
""",
    "preview_items": """
SELECT CAST(l_suppkey AS BIGINT) AS preview_id,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
       CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS file_id
FROM lineitem
UNION ALL
SELECT CAST(CASE WHEN l_linenumber < 3 THEN l_suppkey ELSE l_suppkey + 1 END AS BIGINT) AS preview_id,
       CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '-' ||
       CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS file_id
FROM lineitem
""",
    "well_registry": """
SELECT p_partkey AS line_no,
       CASE WHEN p_partkey % 13 = 0 THEN ' ' || CAST(p_partkey % 1000 AS STRING) || ' '
            ELSE CAST(p_partkey AS STRING) END AS permit_no,
       '21-' || lpad(CAST(p_partkey AS STRING), 8, '0') AS api_wellno,
       p_name AS lease_name,
       CASE WHEN p_size % 2 = 0 THEN 'A' || CAST(p_size AS STRING) || ' / 2' ELSE CAST(p_size AS STRING) END AS well_no,
       CAST(42 + p_partkey % 3 AS STRING) || '.' || lpad(CAST(p_partkey % 100 AS STRING), 2, '0') AS lat_text,
       CASE WHEN p_partkey % 17 = 0 THEN '' ELSE '-' || CAST(84 + p_partkey % 2 AS STRING) || '.' || lpad(CAST((p_partkey * 7) % 100 AS STRING), 2, '0') END AS lon_text,
       CAST(p_size AS STRING) || ' ft' AS elev_ref,
       CASE p_size % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'G' WHEN 2 THEN 'R' WHEN 3 THEN 'D' ELSE 'Z' END AS ref_tops,
       CASE p_type WHEN 'ECONOMY' THEN 'GAS' WHEN 'STANDARD' THEN 'OIL' WHEN 'PROMO' THEN 'DH'
                   WHEN 'SMALL' THEN 'MTW' ELSE 'XYZ' END AS well_type,
       CASE p_size % 4 WHEN 0 THEN 'H' WHEN 1 THEN 'D' WHEN 2 THEN 'V' ELSE NULL END AS slant
FROM part
""",
    "file_events": """
SELECT event_id, ts, user_id AS file_id, user_id % 20 AS job_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'processing'
                       WHEN 'error' THEN 'failed' ELSE 'completed' END AS status,
       value, props
FROM events
""",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view by name; its base tables are read where the query is built, so nothing is registered in the session."""
    sql = VIEWS[name]
    used = [t for t in BASE if re.search(rf"\b(FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in used})


def oracle(*names: str, body: str) -> str:
    """SQL text of a query over views, for an engine that knows the base tables."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + body
