from lakelens.plans.fixtures import delta_orders
from lakelens.sources.deltalog import delta_column_stats, delta_table_stats, snapshot_files, table_metadata
from tests.conftest import SF001, by_col


def test_replay_add_remove_readd(spark):
    t = delta_orders(spark, SF001)
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    n = {r.o_orderstatus: r["count"] for r in o.groupBy("o_orderstatus").count().collect()}
    st = delta_table_stats(spark, t).collect()[0]
    assert st.row_count == sum(n.values())          # P files carry no statistics and are read
    assert st.files_without_stats >= 1 and st.max_add_version == 2
    v1 = snapshot_files(spark, t, version=1).collect()
    assert v1 and all(r.partitionValues["o_orderstatus"] == "O" for r in v1)
    v0 = delta_table_stats(spark, t, version=0).collect()[0]
    assert v0.row_count == n["F"] + n["O"] and v0.files_without_stats == 0
    schema, parts = table_metadata(spark, t)
    assert parts == ["o_orderstatus"] and "o_orderkey" in schema.names


def test_column_stats_from_log(spark):
    t = delta_orders(spark, SF001)
    c = by_col(delta_column_stats(spark, t))
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    mn = o.agg({"o_orderkey": "min"}).collect()[0][0]
    assert c["o_orderkey"].min_int == mn and c["o_orderkey"].row_count == o.count()
    assert c["o_orderstatus"].min_str == "F" and c["o_orderstatus"].max_str == "P"
    assert c["o_orderdate"].min_ts is not None and c["o_totalprice"].null_count == 0


def test_checkpoint_base_without_old_commits(spark, scratch):
    """A log whose commits 0 and 1 were cleaned up after a checkpoint at
    version 1: the snapshot comes from the checkpoint plus commit 2."""
    from pyspark.sql import functions as F

    from lakelens.session import write_single_file, write_single_text_file
    from lakelens.sources.deltalog import ACTION_SCHEMA, log_actions

    src = delta_orders(spark, SF001)
    full = sorted((r.path, r.added_in_version) for r in snapshot_files(spark, src).collect())
    dst = f"{scratch}/delta/cp_table"
    log = f"{dst}/_delta_log"
    acts = log_actions(spark, src)
    for f in snapshot_files(spark, src).select("path").collect():  # the data the new log points to
        write_single_file(spark, spark.read.parquet(f"{src}/{f.path}"), f"{dst}/{f.path}", "parquet")
    v1 = snapshot_files(spark, src, version=1)
    adds = v1.select(F.struct("path", "partitionValues", "size", "modificationTime",
                              F.lit(True).alias("dataChange"), "stats",
                              F.lit(None).cast("struct<storageType:string>").alias("deletionVector")).alias("add"))
    meta = acts.where(F.col("metaData").isNotNull()).select("metaData")
    cp = adds.select("add", F.lit(None).cast(ACTION_SCHEMA["remove"].dataType).alias("remove"),
                     F.lit(None).cast(ACTION_SCHEMA["metaData"].dataType).alias("metaData")).unionByName(
        meta.select(F.lit(None).cast(ACTION_SCHEMA["add"].dataType).alias("add"),
                    F.lit(None).cast(ACTION_SCHEMA["remove"].dataType).alias("remove"), "metaData"))
    write_single_file(spark, cp, f"{log}/{1:020d}.checkpoint.parquet", "parquet")
    write_single_text_file(spark, spark.createDataFrame([('{"version":1,"size":3}',)], "value string"),
                           f"{log}/_last_checkpoint")
    c2 = spark.read.text(f"{src}/_delta_log/{2:020d}.json")
    write_single_text_file(spark, c2, f"{log}/{2:020d}.json")
    got = sorted((r.path, r.added_in_version) for r in snapshot_files(spark, dst).collect())
    assert [p for p, _ in got] == [p for p, _ in full]
    assert delta_table_stats(spark, dst).collect()[0].row_count == delta_table_stats(spark, src).collect()[0].row_count


def test_read_delta_data_and_time_travel(spark):
    from lakelens.sources.deltalog import read_delta
    t = delta_orders(spark, SF001)
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    latest = read_delta(spark, t)
    assert latest.count() == o.count() and "o_orderstatus" in latest.columns
    v0 = read_delta(spark, t, version=0)
    assert v0.count() == o.where("o_orderstatus IN ('F', 'O')").count()
    assert {r.o_orderstatus for r in v0.select("o_orderstatus").distinct().collect()} == {"F", "O"}


def _hand_made(spark, root, commits, files=()):
    """A Delta table from data files [(relative path, DataFrame)] and commits (lists of actions)."""
    import json

    from lakelens.session import write_single_file, write_single_text_file

    for path, df in files:
        write_single_file(spark, df, f"{root}/{path}", "parquet")
    for v, actions in enumerate(commits):
        lines = spark.createDataFrame([(json.dumps(a),) for a in actions], "value string")
        write_single_text_file(spark, lines, f"{root}/_delta_log/{v:020d}.json")
    return root


def _meta(schema, parts=(), conf=None):
    from pyspark.sql.types import _parse_datatype_string

    return {"metaData": {"id": "x", "schemaString": _parse_datatype_string(schema).json(),
                         "partitionColumns": list(parts), "configuration": conf or {}, "createdTime": 0}}


def _add(path, stats=None, parts=None, **more):
    import json

    return {"add": {"path": path, "partitionValues": parts or {}, "size": 1, "modificationTime": 0, "dataChange": True,
                    "stats": json.dumps(stats) if stats else None, **more}}


def test_added_column_escaped_path_and_string_partition(spark, scratch):
    from lakelens.sources.deltalog import read_delta

    one = spark.createDataFrame([(1,), (2,)], "id long")
    two = spark.createDataFrame([(3, "x")], "id long, b string")
    t = _hand_made(spark, f"{scratch}/delta/hand", [
        [_meta("id long, k string", ["k"]), _add("k=01/a%20b.parquet", parts={"k": "01"})],
        [_meta("id long, b string, k string", ["k"]), _add("k=__HIVE_DEFAULT_PARTITION__/c.parquet", parts={"k": None})],
    ], [("k=01/a b.parquet", one), ("k=__HIVE_DEFAULT_PARTITION__/c.parquet", two)])
    now = sorted(tuple(r) for r in read_delta(spark, t).collect())
    assert now == [(1, None, "01"), (2, None, "01"), (3, "x", None)]
    before = read_delta(spark, t, version=0)
    assert before.columns == ["id", "k"] and sorted(tuple(r) for r in before.collect()) == [(1, "01"), (2, "01")]
    c = by_col(delta_column_stats(spark, t))
    assert (c["id"].row_count, c["id"].min_int, c["id"].max_int) == (3, 1, 3)
    assert (c["b"].null_count, c["b"].min_str, c["k"].null_count, c["k"].min_str) == (2, "x", 1, "01")


def test_gaps_of_single_columns_are_read(spark, scratch):
    """One file with bounds, three with a row count alone."""
    files = [(f"f{i}.parquet", spark.createDataFrame([(10 * i + j,) for j in range(5)], "id long")) for i in range(4)]
    full = {"numRecords": 5, "minValues": {"id": 0}, "maxValues": {"id": 4}, "nullCount": {"id": 0}}
    t = _hand_made(spark, f"{scratch}/delta/gaps", [
        [_meta("id long"), _add("f0.parquet", full), *[_add(f"f{i}.parquet", {"numRecords": 5}) for i in (1, 2, 3)]]], files)
    c = by_col(delta_column_stats(spark, t))["id"]
    assert (c.row_count, c.null_count, c.min_int, c.max_int) == (20, 0, 0, 34)
    st = delta_table_stats(spark, t).collect()[0]
    assert (st.row_count, st.num_files, st.files_without_stats) == (20, 4, 0)


def test_versions_outside_the_log_are_errors(spark, scratch):
    import os

    import pytest

    from lakelens.session import write_single_file
    from lakelens.sources.deltalog import ACTION_SCHEMA, log_actions, read_delta

    df = spark.createDataFrame([(1,)], "id long")
    t = _hand_made(spark, f"{scratch}/delta/versions", [
        [_meta("id long"), _add("a.parquet")], [_add("b.parquet")], [_add("c.parquet")]],
        [(f"{n}.parquet", df) for n in "abc"])
    for bad in (-1, 3, 99):
        with pytest.raises(ValueError, match="not in the log"):
            read_delta(spark, t, version=bad)
    cp = log_actions(spark, t, 1).select(*ACTION_SCHEMA.names)
    # an incomplete multi-part checkpoint and a UUID-named one are not read
    write_single_file(spark, cp.limit(0), f"{t}/_delta_log/{2:020d}.checkpoint.{1:010d}.{2:010d}.parquet", "parquet")
    write_single_file(spark, cp.limit(0), f"{t}/_delta_log/{2:020d}.checkpoint.0f-uuid.parquet", "parquet")
    write_single_file(spark, cp, f"{t}/_delta_log/{1:020d}.checkpoint.parquet", "parquet")
    # a version before a checkpoint is rebuilt from the commits
    assert [read_delta(spark, t, version=v).count() for v in (0, 1, 2)] == [1, 2, 3]
    os.rename(f"{t}/_delta_log/{0:020d}.json", f"{t}/_delta_log/was-0")
    assert [read_delta(spark, t, version=v).count() for v in (1, 2)] == [2, 3]
    with pytest.raises(ValueError, match="commit 0 is missing"):
        read_delta(spark, t, version=0)


def test_deletion_vectors_and_column_mapping_are_refused(spark, scratch):
    import pytest

    from lakelens.sources.deltalog import read_delta

    df = spark.createDataFrame([(1,)], "id long")
    dv = _hand_made(spark, f"{scratch}/delta/dv", [
        [_meta("id long"), _add("a.parquet", {"numRecords": 1}, deletionVector={"storageType": "u"})]], [("a.parquet", df)])
    cm = _hand_made(spark, f"{scratch}/delta/cm", [
        [_meta("id long", conf={"delta.columnMapping.mode": "name"}), _add("a.parquet", {"numRecords": 1})]], [("a.parquet", df)])
    for t in (dv, cm):
        for read in (read_delta, delta_column_stats, delta_table_stats):
            with pytest.raises(NotImplementedError):
                read(spark, t).collect()
