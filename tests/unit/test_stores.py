"""Curated stores, publication, job counts, static sides and timers, over restarts and any split into batches."""

import json
import random
import re
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import changes as M
from millrace.sources import io
from millrace.sources.curated import CuratedStore
from millrace.streaming import flows, publish, states

SCHEMA = "id int, job_id int, x string, n long"


def merged(store, *batches):
    for b in batches:
        touched = store.merge(store.spark.createDataFrame(b, SCHEMA))
    return set(map(tuple, store.rows().select("id", "job_id", "x", "n").collect())), touched


def test_store_moves_keys_and_takes_the_newest(spark, tmp_path):
    store = CuratedStore(spark, str(tmp_path / "s"), "id", "job_id", order=["n"])
    first = [(1, 8, "a", 1), (2, 8, "b", 1), (3, 9, "c", 1), (4, 7, "d", 1), (5, None, "e", 1)]
    rows, _ = merged(store, first)
    assert rows == set(first)
    rows, touched = merged(store, [(1, 9, None, 2), (1, 9, "late", 1), (4, 9, "moved", 3), (None, 3, "no key", 9)])
    assert set(rows) == {(1, 9, None, 2), (2, 8, "b", 1), (3, 9, "c", 1), (4, 9, "moved", 3), (5, None, "e", 1)}
    plan = store._within("rows", store.rows().schema, "job_id", touched)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*job_id#\d+ IN \([789,]+\)", plan), plan
    # an old batch again, in part older than what is stored, changes nothing; a folder that lost all rows is seen as empty
    again, _ = merged(store, first)
    assert set(again) == set(rows) and store.rows().filter("job_id = 7").count() == 0
    # and it can be filled again
    rows, _ = merged(store, [(6, 7, "f", 1), (5, 7, "g", 2)])
    assert {(6, 7, "f", 1), (5, 7, "g", 2)} < set(rows) and len(rows) == 6


def test_store_reads_touched_folders_only(spark, tmp_path):
    store = CuratedStore(spark, str(tmp_path / "s"), "id", "job_id", order=["n"])
    store.merge(spark.createDataFrame([(k, k % 40, "x", 1) for k in range(400)], SCHEMA))
    touched = store.merge(spark.createDataFrame([(3, 5, "y", 2)], SCHEMA))
    assert sorted(r[0] for r in touched.collect()) == [3, 5]
    assert store.rows().count() == 400 and store.rows().filter("id = 3").collect()[0]["x"] == "y"


def test_merge_without_an_index(spark, tmp_path):
    path = str(tmp_path / "c")
    io.write_curated(spark.createDataFrame([(8, 1, "a"), (8, 2, "b"), (7, 3, "c")], "job_id int, id int, x string"), path)
    io.merge_curated(spark, spark.createDataFrame([(9, 1, "m"), (9, 1, "n"), (9, 3, None)], "job_id int, id int, x string"), path, ["id"])
    got = {tuple(r) for r in spark.read.parquet(path).filter("id IS NOT NULL").select("job_id", "id", "x").collect()}
    assert got == {(8, 2, "b"), (9, 1, "n"), (9, 3, None)}


def test_fold_keeps_the_first_result_and_nulls(spark):
    events = spark.createDataFrame([("f", 1, "completed", "r1"), ("f", 2, "processing", None), ("g", 1, "failed", None), ("f", 0, "completed", None)], "id string, ts int, status string, result string")
    got = {r["id"]: r for r in M.fold_results(events, "id", ["ts"], ["result"]).collect()}
    assert (got["f"]["status"], got["f"]["result"], got["f"]["actual_result"], got["f"]["processed_at"]) == ("processing", None, "r1", None)
    assert (got["g"]["status"], got["g"]["actual_result"], got["g"]["processed_at"]) == ("failed", None, 1)


def test_comments(spark):
    rows = spark.createDataFrame([(1, "[1] junk"), (2, ' [ {"a":1} , "x" ] '), (3, "nope"), (4, None), (5, "[]"), (6, '{"a":1}')], "id int, c string")
    got = {r["id"]: r["d"] for r in rows.select("id", M.append_comment(F.col("c"), F.struct(F.lit(1).alias("u"))).alias("d")).collect()}
    assert got == {1: '[{"u":1}]', 2: '[{"a":1},"x",{"u":1}]', 3: '[{"u":1}]', 4: '[{"u":1}]', 5: '[{"u":1}]', 6: '[{"u":1}]'}


# --- streams ----------------------------------------------------------------------------------------------------

BASE = datetime(2024, 1, 1, tzinfo=UTC)
EVENT = "file_id string, job_id string, ts timestamp, event_id long, status string"


@pytest.fixture()
def rocks(spark):
    for k, v in states.STATE_STORE.items():
        spark.conf.set(k, v)
    yield spark
    for k in states.STATE_STORE:
        spark.conf.unset(k)


def write(spark, path, rows, schema=EVENT):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def source(spark, path, schema=EVENT):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def disordered(seed, n=90, files=4, kinds=("failed", "failed", "failed", "completed", "processing"), late=20.0):
    rnd = random.Random(seed)
    rows = [(f"f{rnd.randrange(files)}", f"j{rnd.randrange(3)}", BASE + timedelta(milliseconds=rnd.randrange(300_000)), k, rnd.choice(kinds)) for k in range(n)]
    return sorted(rows, key=lambda r: r[2].timestamp() + rnd.uniform(0, late))


def close(spark, path):
    import time

    for k in (3, 4):  # others, late enough for all timers
        time.sleep(1.1)  # file sources read by time of change
        write(spark, path, [("z", "j", BASE + timedelta(hours=k), 10**6 + k, "processing")])


def test_retry_timers_fire_as_the_batch_form_says(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    rows = disordered(1)
    write(spark, path, rows[:45])
    write(spark, path, rows[45:])
    close(spark, path)
    flows.replay(states.retry_timers(source(spark, path)), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, states.retry_timers_batch(spark.read.parquet(path)).collect())) and len(got) > 20


def test_retry_rules(spark):
    at = lambda s: BASE + timedelta(seconds=s)
    rows = [("a", "j", at(0), 1, "failed"), ("a", "j", at(4), 2, "completed"), ("b", "j", at(0), 3, "failed"), ("b", "j", at(6), 4, "completed"), ("b", "j", at(7), 5, "failed")]
    rows += [("c", "j", at(100 * k), 10 + k, "failed") for k in range(5)]
    got = sorted((r["file_id"], r["retries"], r["outcome"], int((r["due"].replace(tzinfo=UTC) - BASE).total_seconds())) for r in states.retry_timers_batch(spark.createDataFrame(rows, EVENT)).collect())
    assert got == [("b", 1, "retry", 5), ("b", 1, "retry", 12), ("c", 1, "retry", 5), ("c", 1, "retry", 405), ("c", 2, "retry", 110), ("c", 3, "retry", 220), ("c", 4, "failed", 300)]


def test_sessions_over_a_restart(rocks, tmp_path):
    spark, path = rocks, str(tmp_path / "in")
    rename = {"failed": "login", "completed": "logout", "processing": "refresh"}
    rows = [(*r[:4], rename[r[4]]) for r in disordered(2, n=80)]
    schema = EVENT.replace("status", "kind")
    run = lambda: flows.replay(states.ended_sessions(source(spark, path, schema), 9_000, "file_id"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    write(spark, path, rows[:40], schema)
    run()
    write(spark, path, rows[40:], schema)  # the second run takes up the first one's state
    close(spark, path)
    run()
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(tuple, states.sessions_batch(spark.read.schema(schema).parquet(path).filter("file_id <> 'z' AND kind IN ('login', 'logout', 'refresh')"), 9_000, "file_id").collect()))
    assert got == want and {r[4] for r in got} == {"logout", "expired"}


def test_a_live_session_has_no_end(spark):
    rows = spark.createDataFrame([("t", BASE, 1, "login"), ("t", BASE + timedelta(seconds=5), 2, "refresh"), ("u", BASE, 3, "login"), ("v", BASE, 4, "refresh")], "token string, ts timestamp, event_id long, kind string")
    got = {r["token"]: (r["refreshes"], r["reason"]) for r in states.sessions_batch(rows, 10_000, as_of=F.lit(BASE + timedelta(seconds=12))).collect()}
    assert got == {"t": (1, None), "u": (0, "expired")}


class Killed(Exception):
    pass


def test_a_killed_batch_is_published_once(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = disordered(3, n=60)
    write(spark, path, rows[:30] + rows[:5])
    write(spark, path, rows[30:])

    def kill(batch_id):
        if batch_id == 1:
            raise Killed("between write and commit")

    with pytest.raises(Exception, match="between write and commit"):
        publish.publish_keys(source(spark, path), out, "status", str(tmp_path / "c"), before_commit=kill).awaitTermination()
    schema = "job_id string, file_id string, status string"
    half = publish.published(spark, out, schema).count()
    publish.publish_keys(source(spark, path), out, "status", str(tmp_path / "c")).awaitTermination()
    publish.Publisher(out, "status")(spark.createDataFrame([("j", "f", "s")], schema), 1)  # a replay adds nothing
    found = publish.published(spark, out, schema)
    got = sorted((r["batch"], r["job_id"], r["file_id"], r["status"]) for r in found.collect())
    whole = spark.read.parquet(path).select("job_id", "file_id", "status").distinct()
    assert {r[1:] for r in got} == set(map(tuple, whole.collect())) and len(got) == len(set(got)) > half > 0


@pytest.mark.parametrize("cuts", [(0, 70), (0, 10, 35, 70)])
def test_job_counts_after_any_split(rocks, tmp_path, cuts):
    spark, path = rocks, str(tmp_path / "in")
    rows = disordered(4, n=70, files=12, late=120.0)
    for a, b in zip(cuts, cuts[1:], strict=False):
        write(spark, path, rows[a:b])
    publish.rollup_by_deltas(source(spark, path), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination()
    counts = publish.JobCounts(spark, str(tmp_path / "s"), "string")
    newest = spark.createDataFrame(rows, EVENT).groupBy("file_id").agg(F.max_by(F.struct("job_id", "status"), F.struct("ts", "event_id")).alias("r")).select("file_id", "r.*")
    want = sorted(map(tuple, flows.rollup_of(newest).collect()))
    assert sorted(map(tuple, counts.states().collect())) == want
    counts.add(spark.createDataFrame([(want[0][0], 5, 5)], "job string, files int, completed int"), 0)  # a batch that was added
    assert sorted(map(tuple, counts.states().collect())) == want


def test_the_registry_is_read_again_after_its_age(spark, tmp_path):
    path, registry, now = str(tmp_path / "in"), tmp_path / "r.csv", [0.0]
    static = publish.Refreshed(spark, lambda: io.read_registry(spark, str(registry), ["permit_no", "name"]), 300, lambda: now[0])
    join = lambda batch, table: batch.join(table, batch.file_id == table.permit_no, "left").select("file_id", "name")
    run = lambda: publish.with_static(source(spark, path), static, join, str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    for k, (at, name) in enumerate([(0, "old"), (299, "new"), (300, "new")]):
        now[0] = at
        registry.write_text(f"permit_no,name\n007,{name}\n")
        write(spark, path, [("007", "j", BASE, k, "x")])
        run()
    got = [(r["batch"], r["name"]) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()]
    assert got == [(0, "old"), (1, "old"), (2, "new")] and static.version == 2


# --- schemas, previews, extraction ------------------------------------------------------------------------------


def test_catalogue_equals_a_walk_of_each_schema(spark):
    from millrace.operators import records as R

    deep = {"type": "object", "properties": {"o'q.x": {"type": ["null", "array"], "items": {"type": "object", "required": ["b"], "properties": {"b": {"type": "integer", "description": "d"}, "c": {"type": "array", "items": {"type": "string"}}}}}, "n": {}}}
    texts = [json.dumps(deep), json.dumps(json.dumps({"schema": deep})), json.dumps({"schema": json.dumps(deep)}), "[1]", "{", None, json.dumps({"type": "array", "items": deep}), '{"type":"object","properties":3}']
    df = spark.createDataFrame(list(enumerate(texts)), "id int, s string")
    got = sorted((tuple(r) for r in R.schema_catalogue(df, "id", "s").collect()), key=str)
    want = sorted(((k, *x) for k, t in enumerate(texts) for x in R.catalogue_paths(t)), key=str)
    assert got == want and len(want) == 16
    assert R.schema_catalogue(df.limit(0), "id", "s").count() == 0


def test_previews_are_written_and_read_back(spark, tmp_path):
    from millrace.operators import records as R

    previews = spark.createDataFrame([(1, '{"type":"object","properties":{"a":{"type":"integer"},"o":{"type":"object"}}}'), (2, '{"type":"object","properties":{"b":{"type":"boolean"},"a":{"type":"string"}}}'), (3, "none")], "preview_id int, schema string")
    links = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (2, "x"), (2, "gone"), (3, "x")], "preview_id int, file_id string")
    records = spark.createDataFrame([("x", '{"a":5,"b":true,"o":{"k":[1]}}'), ("y", "broken {")], "id string, result string")
    R.write_previews(*R.preview_rows(previews, links, records), str(tmp_path / "p"))
    one, two = (R.read_preview(spark, str(tmp_path / "p"), k) for k in (1, 2))
    assert one.dtypes == [("id", "string"), ("a", "bigint"), ("o", "string")] and two.dtypes == [("id", "string"), ("a", "string"), ("b", "boolean")]
    assert sorted(map(tuple, one.collect())) == [("x", 5, '{"k":[1]}'), ("y", None, None)]
    assert sorted(map(tuple, two.collect())) == [("x", None, True)]  # a number is not a string
    assert "PartitionFilters: [isnotnull(preview_id" in one._jdf.queryExecution().executedPlan().toString()


def test_rows_of_previews_move_as_text(spark):
    """Links and results are shuffled once by file and once by preview, before results are parsed."""
    from millrace.operators import records as R

    previews = spark.createDataFrame([(1, '{"type":"object","properties":{"a":{"type":"integer"}}}')], "preview_id long, schema string")
    links = spark.range(10).select(F.lit(1).cast("long").alias("preview_id"), F.col("id").cast("string").alias("file_id"))
    records = spark.range(10).select(F.col("id").cast("string").alias("id"), F.lit('{"a":1}').alias("result"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows, _ = R.preview_rows(previews, links.union(links), records)
        plan = rows._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    assert sum(x.startswith("id#") for x in exchanges) == 2 and not any("," in x for x in exchanges)
    # the only parsed values below an exchange are those of schemas
    assert "members" not in plan and rows.count() == 10


def test_one_bad_row_is_one_error(spark):
    from millrace.operators import records as R

    def call(texts):
        assert sum(map(len, texts)) <= 40 or len(texts) == 1
        if any(t == "bad" for t in texts):
            raise ValueError("no")
        return [{"n": len(t)} for t in texts]

    rows = [(k, "bad" if k == 13 else "x" * k, "m") for k in range(30)] + [(40, None, "m"), (41, "y", None), (42, "z", "nobody")]
    got = {r["id"]: r for r in R.extract_batches(spark.createDataFrame(rows, "id int, text string, method string").coalesce(1), "id", "text", "method", {"m": call}, most=40).collect()}
    assert len(got) == 33 and [k for k, r in got.items() if not r["success"]] == [13, 41, 42]
    assert got[13]["error"] == "ValueError: no" and got[42]["error"] == "unknown method: nobody" and got[41]["error"] == "unknown method: None"
    assert all(json.loads(got[k]["data"]) == {"n": k} for k in range(30) if k != 13) and json.loads(got[40]["data"]) == {"n": 0}


def test_a_quote_in_a_property_name(spark):
    from millrace.operators import records as R

    schema = {"type": "object", "required": ["o'q"], "properties": {"o'q": {"type": "integer"}, "back\\slash": {"type": "string"}}}
    df = spark.createDataFrame([(1, json.dumps({"o'q": 1, "back\\slash": "x"})), (2, json.dumps({"o'q": "s"})), (3, "{}")], "id int, r string")
    got = {r["id"]: r["v"] for r in df.select("id", R.violations("r", schema).alias("v")).collect()}
    assert got == {1: [], 2: ["$.o'q: type"], 3: ["$.o'q: required"]}


@pytest.mark.parametrize("seed", range(3))
def test_slugs_of_clashing_families_follow_the_walk(spark, seed):
    from millrace.operators import listing as L

    rnd = random.Random(seed)
    rows = [(k, rnd.choice(["a", "a-1", "a-2", "a-1-1", "b", "b-1", "a-01", "c-3", "c", "a-1-2"])) for k in range(60)]
    taken = rnd.sample(["a", "a-3", "b-2", "c-1", "a-1-3", "zz"], 3)
    seen, want = set(taken), {}
    for k, base in rows:
        slug, n = base, 0
        while slug in seen:
            n += 1
            slug = f"{base}-{n}"
        seen.add(slug)
        want[k] = slug
    got = L.unique_slugs(spark.createDataFrame(rows, "id int, base string"), "base", "id", spark.createDataFrame([(t,) for t in taken], "slug string"))
    assert {r["id"]: r["slug"] for r in got.collect()} == want
