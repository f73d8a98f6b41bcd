import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lakelens.operators.footer_stats import (footer_column_stats, footer_row_count, footer_table_stats,
                                             pushdown_aggregate, schema_drift)
from lakelens.operators.profile import profile
from lakelens.sources.footers import footer_chunks
from tests.conftest import SF001, by_col


@pytest.fixture(scope="module")
def multi(spark, scratch):
    out = f"{scratch}/footers/orders6"
    spark.read.parquet(f"{SF001}/orders.parquet").repartition(6).write.parquet(out)
    return out


def test_footers_equal_scan_on_null_free_data(spark, multi):
    f = by_col(footer_table_stats(spark, multi))
    p = by_col(profile(spark.read.parquet(multi), distinct="none"))
    assert footer_chunks(spark, multi).select("file_path").distinct().count() == 6
    for k, r in p.items():
        for fld in ("row_count", "null_count", "min_int", "max_int", "min_num", "max_num",
                    "min_str", "max_str", "min_ts", "max_ts"):
            assert getattr(f[k], fld) == getattr(r, fld), (k, fld)
    rc = footer_row_count(spark, multi).collect()[0]
    assert (rc.row_count, rc.file_count) == (1500, 6)


def test_unknown_column_raises(spark, multi):
    with pytest.raises(ValueError):
        footer_column_stats(spark, multi, "nope")
    assert footer_column_stats(spark, multi, "o_custkey").collect()[0].row_count == 1500


def test_nan_bounds_and_missing_stats(spark, scratch):
    d = f"{scratch}/footers/nan"
    import os
    os.makedirs(d, exist_ok=True)
    t = pa.table({"x": pa.array([float("nan"), 1.0, None]), "y": pa.array([1, 2, None])})
    pq.write_table(t, f"{d}/a.parquet")  # pyarrow leaves NaN out of min/max
    pq.write_table(t, f"{d}/b.parquet", write_statistics=False)
    st = by_col(footer_table_stats(spark, d))
    assert st["x"].row_count == 6
    assert st["x"].null_count is None and st["y"].null_count is None  # a chunk lacks statistics
    assert st["y"].min_int is None  # a chunk without bounds: unknown, not a wrong bound
    only_a = by_col(footer_table_stats(spark, f"{d}/a.parquet"))
    assert only_a["y"].min_int == 1 and only_a["y"].null_count == 1
    s = f"{scratch}/footers/nan_spark"
    spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double").coalesce(1).write.parquet(s)
    sp = by_col(footer_table_stats(spark, s))["x"]
    assert sp.has_nan_bound and sp.max_num is None


def test_pushdown_plan(spark):
    path = f"{SF001}/lineitem.parquet"
    df = pushdown_aggregate(spark, path, ["l_orderkey", "l_quantity"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(l_orderkey), MAX(l_orderkey)" in plan
    rows = by_col(df)
    assert rows["l_orderkey"].row_count == spark.read.parquet(path).count()
    with pytest.raises(ValueError):
        pushdown_aggregate(spark, path, ["l_returnflag"])
    # the caller's session is untouched
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") in ("false", None)


def test_drift(spark, scratch):
    d = f"{scratch}/footers/drift"
    spark.createDataFrame([(1, "x")], "a int, b string").write.mode("append").parquet(d)
    spark.createDataFrame([(2, "y", 1.5)], "a bigint, b string, c double").write.mode("append").parquet(d)
    cols = {r.column_name: r for r in schema_drift(spark, d, by_type=False).collect()}
    assert cols["a"].types == ["int32", "int64"] and cols["a"].conflict
    assert not cols["b"].conflict and cols["b"].in_all_files
    assert not cols["c"].in_all_files and cols["c"].presence_ratio == 0.5


def test_unsigned_and_decimal_bounds(spark, scratch):
    import decimal
    import os
    d = f"{scratch}/footers/uint"
    os.makedirs(d, exist_ok=True)
    t = pa.table({"u": pa.array([1, 2 ** 64 - 1], pa.uint64()),
                  "dec": pa.array([decimal.Decimal("1.25"), decimal.Decimal("-3.50")], pa.decimal128(10, 2)),
                  "day": pa.array([1, 20000], pa.date32())})
    pq.write_table(t, f"{d}/u.parquet")
    st = by_col(footer_table_stats(spark, d))
    assert st["u"].max_int is None and st["u"].row_count == 2
    assert st["dec"].min_num == -3.5 and st["dec"].max_str == "1.25"
    assert str(st["day"].min_ts) == "1970-01-02 00:00:00"


def test_int96_and_far_dates(spark, scratch):
    d = f"{scratch}/footers/int96"
    df = spark.sql("SELECT 1 AS a, TIMESTAMP'2024-01-01 00:00:00' AS t, DATE'9999-12-31' AS far, "
                   "TIMESTAMP_NTZ'9999-12-31 23:59:59' AS far_ts")
    spark.conf.set("spark.sql.parquet.outputTimestampType", "INT96")
    try:
        df.coalesce(1).write.parquet(d)
    finally:
        spark.conf.unset("spark.sql.parquet.outputTimestampType")
    st = by_col(footer_table_stats(spark, d))
    assert st["a"].min_int == 1 and st["t"].row_count == 1 and st["t"].min_ts is None
    assert str(st["far"].max_ts) == "9999-12-31 00:00:00" and str(st["far_ts"].max_ts) == "9999-12-31 23:59:59"
    assert footer_row_count(spark, d).collect()[0].row_count == 1


def test_unsigned_beyond_a_long_is_unknown_in_any_chunk(spark, scratch):
    import os
    d = f"{scratch}/footers/uint_groups"
    os.makedirs(d, exist_ok=True)
    t = pa.table({"u": pa.array([1, 2, 2 ** 63 + 6, 2 ** 63 + 5], pa.uint64())})
    pq.write_table(t, f"{d}/u.parquet", row_group_size=2)
    r = by_col(footer_table_stats(spark, d))["u"]
    assert (r.min_int, r.max_int, r.row_count, r.null_count) == (None, None, 4, 0)


def test_decimal_bounds_over_files(spark, scratch):
    d = f"{scratch}/footers/decimals"
    for x in ("9.10", "10.50", "-2.25", "-10.00"):
        spark.sql(f"SELECT CAST('{x}' AS DECIMAL(38,2)) AS x").coalesce(1).write.mode("append").parquet(d)
    r = by_col(footer_table_stats(spark, d))["x"]
    assert (r.min_str, r.max_str, r.min_num, r.max_num) == ("-10.00", "10.50", -10.0, 10.5)


def test_files_without_suffix_and_drifted_rows(spark, scratch):
    import os
    d = f"{scratch}/footers/hive_writer"
    os.makedirs(d, exist_ok=True)
    pq.write_table(pa.table({"a": [1, 2], "b": [5, None]}), f"{d}/000000_0")
    pq.write_table(pa.table({"a": [3, 4, 5, 6, 7]}), f"{d}/000001_0")
    st = by_col(footer_table_stats(spark, d))
    assert (st["a"].row_count, st["a"].null_count) == (7, 0)
    assert (st["b"].row_count, st["b"].null_count, st["b"].max_int) == (7, 6, 5)
    from lakelens.operators.catalog_stats import row_count_ladder
    assert tuple(row_count_ladder(spark, path=d).collect()[0]) == (7, "footer")


def test_instants_read_in_the_session_zone(spark, scratch):
    d = f"{scratch}/footers/zone"
    spark.conf.set("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
    try:
        spark.sql("SELECT TIMESTAMP'2024-01-01 00:00:00Z' AS t").coalesce(1).write.parquet(d)
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        footer = by_col(footer_table_stats(spark, d))["t"].min_ts
        scan = by_col(profile(spark.read.parquet(d), distinct="none"))["t"].min_ts
        assert footer == scan and str(footer) == "2023-12-31 16:00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        spark.conf.unset("spark.sql.parquet.outputTimestampType")


def test_s3_settings_reach_the_reader(spark):
    from lakelens.sources.footers import s3_options
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        conf.set("fs.s3a.endpoint", "http://localhost:4566")
        conf.set("fs.s3a.access.key", "k")
        assert s3_options(spark) == {"access_key": "k", "scheme": "http", "endpoint_override": "localhost:4566"}
    finally:
        conf.unset("fs.s3a.endpoint")
        conf.unset("fs.s3a.access.key")
