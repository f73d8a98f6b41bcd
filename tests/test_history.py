import datetime as dt

from pyspark.sql import functions as F

from lakelens.operators.history import (HISTORY_SCHEMA, append_by_key, append_history, cached_ids, current, fresh,
                                        history_rows, read_by_key, read_history, stale, tombstones)

AS_OF = dt.datetime(2024, 1, 2, 0, 0, 0)
DAY = dt.timedelta(seconds=86400)


def _hist(spark):
    rows = [
        ("s1", "t1", "metadata", '{"v":1}', AS_OF - 3 * DAY, False, True),
        ("s1", "t1", "metadata", '{"v":2}', AS_OF - DAY, False, True),            # exactly the TTL: fresh
        ("s1", "t2", "metadata", '{"v":1}', AS_OF - DAY - dt.timedelta(microseconds=1), False, True),
        ("s1", "t3", "metadata", '{"v":1}', AS_OF - dt.timedelta(hours=1), False, False),
        ("s1", "t3", "metadata", None, AS_OF - dt.timedelta(minutes=1), True, False),  # tombstone
        ("s2", "t1", "metadata", '{"v":9}', AS_OF, False, True),                  # same id, other source
        ("s1", "t4", "metadata", '{"v":1}', AS_OF - DAY, False, True),
        ("s1", "t4", "metadata", None, AS_OF - DAY, True, False),                 # tie -> tombstone wins
        ("s1", "db", "discovery", '["a"]', AS_OF - dt.timedelta(seconds=3600), False, False),
        ("s1", "db2", "discovery", '["b"]', AS_OF - dt.timedelta(seconds=3601), False, False),
    ]
    return spark.createDataFrame(rows, HISTORY_SCHEMA)


def test_current_and_tombstones(spark):
    cur = {(r.source, r.id): r for r in current(_hist(spark)).collect()}
    assert cur[("s1", "t1")].content == '{"v":2}'
    assert ("s1", "t3") not in cur and ("s1", "t4") not in cur
    assert cur[("s2", "t1")].content == '{"v":9}'


def test_ttl_boundaries(spark):
    f = {(r.kind, r.source, r.id) for r in fresh(current(_hist(spark)), AS_OF).collect()}
    assert ("metadata", "s1", "t1") in f            # age == TTL is fresh
    assert ("metadata", "s1", "t2") not in f        # one microsecond older is stale
    assert ("discovery", "s1", "db") in f and ("discovery", "s1", "db2") not in f
    f2 = {(r.source, r.id) for r in fresh(current(_hist(spark)), AS_OF, need_column_stats=True).collect()}
    assert ("s1", "t3") not in f2


def test_stale_and_ids(spark):
    cat = spark.createDataFrame([("s1", "t1"), ("s1", "t2"), ("s1", "new"), ("s2", "t1")], "source string, id string")
    st = {(r.source, r.id) for r in stale(cat, current(_hist(spark)), AS_OF).collect()}
    assert st == {("s1", "t2"), ("s1", "new")}
    assert cached_ids(current(_hist(spark))).count() == 3


def test_append_clear_roundtrip(spark, scratch):
    path = f"{scratch}/history/h1"
    df = spark.createDataFrame([("a", 1), ("b", 2)], "name string, n int")
    rows = history_rows(df, "src", "name", F.to_json(F.struct("n")), last_updated=AS_OF - DAY)
    append_history(rows, path)
    h = read_history(spark, path)
    assert current(h).count() == 2
    append_history(tombstones(current(h), spark.createDataFrame([("src", "a")], "source string, id string"),
                              at=AS_OF), path)
    assert {r.id for r in current(read_history(spark, path)).collect()} == {"b"}
    append_history(tombstones(current(read_history(spark, path)), kinds=("metadata", "discovery"), at=AS_OF), path)
    assert current(read_history(spark, path)).count() == 0


def test_refresh_stale_read_through(spark, scratch):
    from lakelens.operators.history import refresh_stale
    from tests.conftest import SF001
    path = f"{scratch}/history/refresh"
    t = {"tpch.region": spark.read.parquet(f"{SF001}/region.parquet"),
         "tpch.nation": spark.read.parquet(f"{SF001}/nation.parquet")}
    assert refresh_stale(spark, t, path, "lake", AS_OF - 2 * DAY) == ["tpch.nation", "tpch.region"]
    assert refresh_stale(spark, t, path, "lake", AS_OF - 2 * DAY + dt.timedelta(hours=1)) == []
    assert refresh_stale(spark, t, path, "lake", AS_OF) == ["tpch.nation", "tpch.region"]
    assert refresh_stale(spark, t, path, "lake", AS_OF, force=True) == ["tpch.nation", "tpch.region"]
    cur = current(read_history(spark, path)).collect()
    assert len(cur) == 2 and all(r.has_column_stats for r in cur)
    import json
    reg = [json.loads(r.content) for r in cur if r.id == "tpch.region"][0]
    assert reg["stats"]["row_count"] == 5 and reg["database"] == "tpch"
    paths = {"tpch.region": f"{SF001}/region.parquet"}
    refresh_stale(spark, t, path, "lake", AS_OF + DAY, force=True, paths=paths, primary_keys={"tpch.region": ["r_regionkey"]})
    reg = json.loads([r.content for r in current(read_history(spark, path)).collect() if r.id == "tpch.region"][0])
    assert reg["stats"]["total_size_bytes"] > 0 and reg["stats"]["last_modified"]
    assert reg["schema_info"]["primary_keys"] == ["r_regionkey"]


def test_rows_after_as_of_do_not_count(spark, scratch):
    from lakelens.operators.history import fresh_history
    path = f"{scratch}/history/as_of"
    append_history(_hist(spark), path)
    later = AS_OF - DAY
    assert {(r.source, r.id) for r in fresh_history(spark, path, later).collect()} == {("s1", "t1"), ("s1", "t2")}
    full = sorted(tuple(r) for r in fresh(current(read_history(spark, path), as_of=AS_OF), AS_OF).collect())
    assert sorted(tuple(r) for r in fresh_history(spark, path, AS_OF).collect()) == full
    plan = fresh_history(spark, path, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_date" in plan and "run_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_compaction_keeps_current_state(spark, scratch):
    from lakelens.operators.history import compact_history
    src = f"{scratch}/history/compact_src"
    append_history(_hist(spark), src)
    before = sorted(tuple(r) for r in current(read_history(spark, src)).collect())
    out = compact_history(spark, src, f"{scratch}/history/compact_dst")
    assert out.count() == len(before)
    assert sorted(tuple(r) for r in current(out).collect()) == before


def test_history_by_key_shuffles_nothing_of_it(spark, scratch):
    h = _hist(spark)
    append_by_key(h.where("source = 's1'"), "h_by_key", f"{scratch}/by-key", buckets=8)
    append_by_key(h.where("source = 's2'").unionByName(h.where("id = 't1'")), "h_by_key")
    stored = read_by_key(spark, "h_by_key")
    assert sorted(map(str, current(stored).collect())) == sorted(map(str, current(h).collect()))
    cat = spark.createDataFrame([("s1", "t1"), ("s1", "t2"), ("s1", "new"), ("s2", "t1")], "source string, id string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df, exchanges in ((current(stored), 0), (stale(cat, current(stored), AS_OF), 1)):
            df.collect()
            plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
            assert plan.count("Exchange hashpartitioning") == exchanges, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    got = {(r.source, r.id) for r in stale(cat, current(stored), AS_OF).collect()}
    assert got == {("s1", "t2"), ("s1", "new")}
    # an append holds one row a key, however often it was saved
    hot = h.where("id = 't1'").crossJoin(spark.range(50)).drop("id").withColumn("id", F.lit("hot")).select(*HISTORY_SCHEMA.names)
    append_by_key(hot, "h_by_key")
    assert read_by_key(spark, "h_by_key").where("id = 'hot'").count() == 2


def test_history_by_key_refuses_other_tables(spark, scratch):
    import pytest

    _hist(spark).write.option("path", f"{scratch}/plain").saveAsTable("h_plain")
    with pytest.raises(ValueError):
        append_by_key(_hist(spark), "h_plain")
