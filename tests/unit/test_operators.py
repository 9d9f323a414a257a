"""Operators on small rows, and properties."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes as M
from millrace.operators import documents as D
from millrace.operators import enrich as X
from millrace.operators import listing as L
from millrace.operators import records as R
from millrace.operators import stats as A
from millrace.plans.registry import RECORD
from millrace.sources import io
from millrace.sources.fixtures import view

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_status_classes_are_parenthesised(spark):
    f = spark.createDataFrame([(1, "processing", "failed"), (2, "completed", "processing"), (1, "pending", "pending")], "job_id int, extraction_status string, processing_status string")
    assert f.filter((F.col("job_id") == 1) & A.status_class("processing")).count() == 1


def test_upsert_twice_is_upsert_once(spark):
    m, u = view(spark, SF, "memberships"), view(spark, SF, "users").select(F.col("id").alias("user_id"), "organization_id", F.lit("owner").alias("role"))
    once = M.upsert(m, u, ["user_id", "organization_id"])
    assert rows(M.upsert(once, u, ["user_id", "organization_id"])) == rows(once)


def test_upsert_takes_the_last_change(spark):
    s = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    c = spark.createDataFrame([(1, "x", 2), (1, "y", 1), (3, "z", 1)], "k int, v string, ts int")
    assert rows(M.upsert(s, c, ["k"], "ts")) == [(1, "x"), (2, "b"), (3, "z")]
    assert rows(M.insert_ignore(s, c.drop("ts"), ["k"])) == [(1, "a"), (2, "b"), (3, "z")]


def test_partial_updates_and_flags(spark):
    s = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "id int, name string, secret string")
    c = spark.createDataFrame([(1, None, "x"), (2, "n", "y")], "id int, name string, secret string")
    assert rows(M.partial_update(s, c, ["id"], ["name"])) == [(1, "a", "p"), (2, "n", "q")]
    v = spark.createDataFrame([(1, True, None)], "id int, admin_verified boolean, customer_verified boolean")
    assert rows(M.verification_update(v, spark.createDataFrame([(1, None, True)], v.schema))) == [(1, True, True)]


def test_access_partition_is_disjoint_and_complete(spark):
    files, jobs, members = (view(spark, SF, n) for n in ("job_files", "jobs", "memberships"))
    ids = files.select(F.col("id").alias("file_id"))
    got = L.access_partition(ids, files, jobs, members, 7)
    assert got.select("file_id").distinct().count() == ids.distinct().count()
    assert got.filter("accessible = (reason IS NOT NULL)").count() == 0


def test_listing_without_organizations_is_empty(spark):
    jobs, files, members = (view(spark, SF, n) for n in ("jobs", "job_files", "memberships"))
    assert L.job_listing(jobs, files, members, -1, 10, 0).count() == 0


def test_pages_order_nulls_first(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 9)], "id int, created_at int")
    assert [r["id"] for r in L.page(df, [F.col("created_at").desc_nulls_first(), F.col("id")], 2, 0).collect()] == [1, 3]


def test_slugs_go_past_taken_ones(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, base string")
    assert [r["slug"] for r in L.unique_slugs(df, "base", "id").orderBy("id").collect()] == ["a", "a-1", "b"]
    taken = spark.createDataFrame([("a",), ("a-1",)], "slug string")
    assert [r["slug"] for r in L.unique_slugs(df, "base", "id", taken).orderBy("id").collect()] == ["a-2", "a-3", "b"]


def plain_slugs(rows_, taken=()):
    seen, out = set(taken), []
    for _, name in sorted(rows_):
        slug, k = name, 0
        while slug in seen:
            k += 1
            slug = f"{name}-{k}"
        seen.add(slug)
        out.append(slug)
    return out


@pytest.mark.parametrize(
    ("names", "taken"),
    [
        (["a", "a", "a-1"], []),
        (["a-1", "a", "a", "a-1", "a-1-1"], ["a"]),
        (["b", "b", "b", "c"], ["b-1", "b-3", "b-x", "b-01", "c"]),
        (["d-2", "d-2", "d"], ["d-2", "d-2-1"]),
        (["e", "e"], ["e-1"]),
    ],
)
def test_slugs_are_unique_over_all_bases(spark, names, taken):
    made = list(enumerate(names))
    df = spark.createDataFrame(made, "id int, base string")
    got = L.unique_slugs(df, "base", "id", spark.createDataFrame([(t,) for t in taken], "slug string"))
    assert [r["slug"] for r in got.orderBy("id").collect()] == plain_slugs(made, taken)


def test_grid_join_equals_the_nested_loop(spark):
    points = spark.createDataFrame([(k, 42 + (k % 37) * 0.004, -84 - (k % 23) * 0.006) for k in range(200)] + [(900, 10.0, 179.999), (901, 89.9, 0.0)], "point_id int, lat double, lon double")
    features = points.select(F.col("point_id").alias("feature_id"), F.lit("x").alias("label"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon")).union(spark.createDataFrame([(902, "x", 10.0, -179.999), (903, "x", 89.9, 170.0)], "feature_id int, label string, f_lat double, f_lon double"))
    got = rows(X.within(points, features, 1000.0).select("point_id", "feature_id"))
    from millrace.functions.scalars import haversine

    slow = points.crossJoin(features).filter(haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= 1000).select("point_id", "feature_id")
    assert (900, 902) in got and got == rows(slow)


def test_payloads_become_one_record(spark):
    ocr = {"documentId": "d", "pages": [{"pageIndex": 0, "markdown": {"text": "p0"}, "sourceBlocks": [{"blockId": "1", "blockLabel": "doc_title", "blockContent": "T"}, {"blockId": "2", "blockLabel": "Table", "blockContent": "a \\\"b\\\""}, {"blockId": "3", "blockLabel": "table", "blockContent": "  "}]}, {"markdown": {"text": "p1"}}]}
    chunk = {"id": "c", "chunks": [{"type": "page", "content": "x", "metadata": {"pageRange": {"start": 0, "end": 4}}}, {"type": "table", "content": "t"}, {"type": "page", "content": "y"}]}
    a = D.parse_ocr(spark.createDataFrame([(1, json.dumps(ocr))], "doc_id int, payload string"))
    b = D.parse_chunks(spark.createDataFrame([(2, json.dumps(chunk))], "doc_id int, payload string"))
    assert rows(D.unified(a, b)) == [(1, "blocks", "p0\n\np1", 2, 1), (2, "chunks", "x\n\ny", 2, 1)]
    assert [r["page_no"] for r in D.route_chunks(b).filter("kind = 'page'").orderBy("pos").collect()] == [4, 2]
    blocks = D.block_rows(D.page_rows(a))
    assert D.feed(blocks).first()["feed"] == "# T\n\na \\\"b\\\"\n"
    assert D.feed(blocks, blocked=True).first()["feed"].startswith("=== PAGE 1 ===\n\n[BLOCK: 1]\n\n# T\n")
    assert D.tables(blocks).first()["content"] == "a 'b'"
    assert D.placeholder_pages(spark.createDataFrame([(1, 3), (2, 0)], "doc_id int, n int"), "doc_id", "n").count() == 3


def test_schema_mapping_and_catalogue(spark):
    assert R.spark_type(RECORD).simpleString() == "struct<permit:string,elevation:double,review:string,casing:array<struct<size:double,depth:bigint>>>"
    assert R.schema_of(json.dumps(json.dumps({"schema": RECORD}))) == RECORD
    assert R.catalogue_paths("not json") == []
    assert ("casing[].size", 2, "number", False, None) in R.catalogue_paths(json.dumps(RECORD))


@pytest.mark.parametrize(("text", "want"), [('{"permit":"1"}', ""), ("{}", "$.permit: required"), ('{"permit":null}', "$.permit: type"), ('{"permit":1}', "$.permit: type"), ('{"permit":"1","review":"no"}', "$.review: enum"), ('{"permit":"1","review":null,"elevation":2.5}', ""), ('{"permit":"1","z":1,"a":2}', "$: unknown a,z"), ("{", "$: json")])
def test_conformance(spark, text, want):
    df = spark.createDataFrame([(text,)], "r string").select(F.array_join(R.violations("r", RECORD), "; "))
    assert df.first()[0] == want


@pytest.mark.parametrize(("text", "finish", "want"), [('{"a":1}', "stop", "ok"), ('{"a":1', "stop", "truncated"), ('{"a":}', "stop", "malformed"), ('{"a":}', "length", "truncated"), ("", "stop", "truncated")])
def test_parse_outcomes(spark, text, finish, want):
    df = spark.createDataFrame([(text, finish)], "r string, f string")
    assert df.select(R.parse_outcome("r", "f")).first()[0] == want


def test_double_encoding(spark):
    df = spark.createDataFrame([(json.dumps(json.dumps({"a": 5})),), (json.dumps({"a": 5}),)], "r string")
    assert [r[0] for r in df.select(F.try_variant_get(R.reparsed(F.col("r")), "$.a", "int")).collect()] == [5, 5]


def test_failed_batches_become_rows(spark):
    def call(texts):
        if any("bad" in t for t in texts):
            raise ValueError("no")
        return [{"n": len(t)} for t in texts]

    df = spark.createDataFrame([(1, "abc"), (2, "bad")], "id int, text string").repartition(2, "id")
    got = {r["id"]: r for r in R.extract_batches(df, "id", "text", "m", call).collect()}
    assert got[2]["error"] == "ValueError: no" and not got[2]["success"]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pdf").write_bytes(b"x")
    (tmp_path / "in" / "r.csv").write_text("permit_no,name\n007,a\n,b\n")
    m = {r["filename"]: r for r in io.landing_manifest(spark, str(tmp_path / "in")).collect()}
    assert m["a.pdf"]["kind"] == "pdf" and m["a.pdf"]["file_hash"].startswith("2d711642")
    assert rows(io.read_registry(spark, str(tmp_path / "in" / "r.csv"), ["permit_no", "name"])) == [("007", "a"), (None, "b")]
    items = spark.createDataFrame([('{"fileId":"f","retries":2}',), ("oops",), ("{}",)], "value string")
    assert [r["fileId"] for r in io.parse_items(items).collect()] == ["f"]
    df = spark.createDataFrame([(1, None)], "job_id int, model string")
    io.append(df, str(tmp_path / "t"), {"model": F.lit("default"), "status": F.lit("queued")})
    assert rows(spark.read.parquet(str(tmp_path / "t"))) == [(1, "default", "queued")]
    io.write_curated(df.withColumn("x", F.lit(1)), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1


def test_curated_folders_of_other_keys_stay(spark, tmp_path):
    path = str(tmp_path / "c")
    spark.sparkContext.setCheckpointDir(str(tmp_path / "k"))
    io.write_curated(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 3, "c")], "job_id int, id int, x string"), path)
    io.merge_curated(spark, spark.createDataFrame([(1, 2, None), (1, 4, "d")], "job_id int, id int, x string"), path, ["job_id", "id"])
    assert rows(spark.read.parquet(path).select("job_id", "id", "x")) == [(1, 1, "a"), (1, 2, None), (1, 4, "d"), (2, 3, "c")]


def test_centres(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 4.0, 0.0, 6.0), (None, 2.0, 0.0, 4.0, 0.0, 6.0), (float("nan"), 2.0, 0.0, None, 0.0, 6.0)], "lat double, lon double, a double, b double, c double, d double")
    from millrace.functions.scalars import feature_centre

    assert [tuple(r[0]) if r[0] else None for r in df.select(feature_centre(*[F.col(c) for c in ("lat", "lon", "a", "b", "c", "d")])).collect()] == [(1.0, 2.0), (2.0, 3.0), None]


def test_json_array_rows(spark):
    df = spark.createDataFrame([(1, '[{"email":"a"},{"email":"b"}]'), (2, "[]"), (3, "{}"), (4, None)], "id int, c string")
    assert [(r["id"], r["pos"], r["item"]["email"]) for r in M.json_array_rows(df, "id", "c", "struct<email:string>").collect()] == [(1, 0, "a"), (1, 1, "b")]
