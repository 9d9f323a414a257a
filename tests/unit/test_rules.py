"""Dense cells, organizations for users without one, reasons against requests."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars as S
from millrace.operators import changes as M
from millrace.operators import enrich as X


@pytest.mark.parametrize("most", [2, 7, 4096])
def test_dense_cells_give_the_same_pairs(spark, most):
    """A third of all points in one cell, and more in one place."""
    rnd = random.Random(1)
    places = [(42.0 + rnd.uniform(0, 0.008), -84.0 + rnd.uniform(0, 0.008)) for _ in range(30)] + [(42.003, -84.003)] * 10 + [(42 + rnd.uniform(0, 1), -84 - rnd.uniform(0, 1)) for _ in range(60)]
    points = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(places)], "point_id int, lat double, lon double")
    features = points.select(F.col("point_id").alias("feature_id"), F.lit("x").alias("label"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    got = sorted(map(tuple, X.within(points, features, 1000.0, most=most).select("point_id", "feature_id").collect()))
    slow = points.crossJoin(features).filter(S.haversine(F.col("lat"), F.col("lon"), F.col("f_lat"), F.col("f_lon")) <= 1000).select("point_id", "feature_id")
    assert got == sorted(map(tuple, slow.collect())) and len(got) > 1000


def test_a_dense_cell_is_shared_by_tasks(spark):
    points = spark.range(400).select(F.col("id").alias("point_id"), F.lit(42.0005).alias("lat"), F.lit(-84.0005).alias("lon"))
    features = points.select(F.col("point_id").alias("feature_id"), F.lit("x").alias("label"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}  # the join's own partitions
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        found = X.within(points, features, 1000.0, most=20)
        assert found.count() == 160_000
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k in plain:
            spark.conf.unset(k)
    assert len(sizes) == 4 and max(sizes) < 2 * min(sizes)


def plain_near(points, features):
    """(point, feature, label, distance) of all pairs within the radius."""
    import math

    def metres(p, q):
        a = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(min(1.0, a)))

    return [(p, f, label, d) for p, *at in points for f, label, *there in features if None not in at and None not in there and (d := metres(at, there)) <= 1000]


def test_equal_places_are_compared_once(spark):
    """3,000 wells at each of two places and some around them: sums, the nearest, the nearest but oneself, over rows of equal ids."""
    rnd = random.Random(4)
    places = [(42.0, -84.0), (42.0, -84.005)] * 3 + [(42 + rnd.uniform(0, 0.02), -84 - rnd.uniform(0, 0.02)) for _ in range(30)] + [(10.0, 10.0), (None, 5.0), (5.0, None)]
    points = [(k, a, b) for k, (a, b) in enumerate(places)] + [(6, 10.0, 10.0), (None, 42.0, -84.0)]
    features = [(k, "Unknown" if k % 7 == 3 else f"L{k % 5}", a, b) for k, (a, b) in enumerate(places)] + [(0, "again", 42.0, -84.0), (0, "again", 42.0, -84.005), (None, "no id", 42.0, -84.0)]
    a, b = spark.createDataFrame(points, "point_id long, lat double, lon double"), spark.createDataFrame(features, "feature_id long, label string, f_lat double, f_lon double")
    pairs = plain_near(points, features)
    sums = {p: (sum(x[0] == p for x in pairs), sum(x[1] or 0 for x in pairs if x[0] == p)) for p in {x[0] for x in pairs}}
    assert {r["point_id"]: (r["n_near"], r["ids"]) for r in X.near_sums(a, b, 1000.0).collect()} == sums

    def nearest(p, at, own):
        near = [(d, f is not None, f or 0, label) for _, f, label, d in plain_near([(p, *at)], features) if label != "Unknown" and (own or None not in (f, p) and f != p)]
        return min(near)[3] if near else "Unknown"

    for own, found in ((True, X.nearest_label(a, b)), (False, X.nearest_other_label(a, b))):
        assert sorted(map(str, (tuple(r) for r in found.select("point_id", "label").collect()))) == sorted(str((p, nearest(p, at, own))) for p, *at in points)
    many = spark.range(6000).select(F.col("id").alias("point_id"), F.lit(42.0).alias("lat"), F.when(F.col("id") % 2 == 0, -84.0).otherwise(-84.5).alias("lon"))
    there = many.select(F.col("point_id").alias("feature_id"), F.lit("x").alias("label"), F.col("lat").alias("f_lat"), F.col("lon").alias("f_lon"))
    plan = X.near_sums(many, there, 1000.0)
    assert plan.agg(F.sum("n_near")).first()[0] == 2 * 3000 * 3000
    assert "BroadcastHashJoin [gy" not in plan._jdf.queryExecution().sparkPlan().toString()


def test_tags_are_named_once(spark):
    """A filter by the class below which the tags are made has their expression once."""
    made = spark.range(3).select("id", F.when(F.col("id") == 0, F.create_map(F.lit("mark"), F.lit("park"))).when(F.col("id") == 1, F.create_map(F.lit("landuse"), F.lit("Forest"))).alias("tags"))
    found = made.select("id", X.land_use_class("tags").alias("label"))
    assert [tuple(r) for r in found.orderBy("id").collect()] == [(0, "Public/Open"), (1, "Forest"), (2, "Unknown")]
    plan = found.filter("label <> 'Unknown'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("keys: [mark]") + plan.count("map(mark") <= 2


def test_organizations_are_inserted_once(spark):
    orgs = spark.createDataFrame([(1, "o", "o", "pro")], "id long, name string, slug string, plan string")
    users = spark.createDataFrame([(5, "Ann B.", 1), (6, "Bo", 1)], "id long, name string, organization_id long")
    members = spark.createDataFrame([(6, 1, "viewer")], "user_id long, organization_id long, role string")
    orgs2, members2 = M.with_owner_organizations(orgs, users, members)
    assert sorted(map(tuple, orgs2.collect())) == [(1, "o", "o", "pro"), (7, "Ann B.'s Organization", "ann-b--org-5", "free")]
    assert sorted(map(tuple, members2.collect())) == [(5, 7, "owner"), (6, 1, "viewer")]
    orgs3, members3 = M.with_owner_organizations(orgs2, users, members2)
    assert orgs3.count() == 2 and members3.count() == 2


def test_requests_without_anything_pass(spark):
    rows = [(1, None, None), (2, "full_extraction", '{"processing":{"method":"qwen","model":"qwen-plus"}}'), (3, None, "{"), (4, None, '{"processing":{"model":"unknown"}}'), (5, "", None), (6, None, '{"processing":{"method":"qwen","model":"gpt-4"}}')]
    got = {r["id"]: r["f"] for r in spark.createDataFrame(rows, "id int, mode string, config string").select("id", S.request_fault(F.col("mode"), F.col("config")).alias("f")).collect()}
    assert got[1] is got[2] is got[4] is None
    assert got[3] == "processing_config must be an object" and got[5].startswith("Invalid extraction_mode") and got[6].startswith("Invalid processing.model for qwen. Must be one of: qwen3-max")
