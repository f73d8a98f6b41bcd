import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lakelens.model import PROFILE_SCHEMA
from lakelens.operators.profile import (column_stats, merge_partials, profile, profile_partials,
                                        profile_tables, row_counts)
from tests.conftest import SF001, by_col


def test_golden_users(users):
    p = by_col(profile(users, "test_users", distinct="exact"))
    age = p["age"]
    assert age.row_count == 3
    assert (age.min_int, age.max_int, age.null_count, age.distinct_count) == (25, 30, 1, 2)
    assert age.data_type == "integer" and age.original_type == "int"
    assert p["name"].min_str == "Alice" and p["name"].max_str == "Charlie"
    assert p["name"].avg_len == pytest.approx(5.0) and p["name"].max_len == 7
    assert p["id"].ordinal == 1


def _shape(schema):
    return [(f.name, f.dataType) for f in schema.fields]


def test_schema_is_fixed(users):
    for mode in ("exact", "approx", "none"):
        assert _shape(profile(users, distinct=mode).schema) == _shape(PROFILE_SCHEMA)


def test_column_stats_single(users):
    r = column_stats(users, "age").collect()
    assert len(r) == 1 and r[0].null_count == 1 and r[0].distinct_count == 2


def test_unknown_column_raises(users):
    with pytest.raises(ValueError):
        profile(users, columns=["nope"])


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c double, d timestamp_ntz")
    for r in profile(df, "empty", distinct="exact").collect():
        assert r.row_count == 0 and r.null_count == 0 and r.distinct_count == 0
        assert r.min_int is None and r.min_str is None and r.min_num is None and r.min_ts is None
        assert r.avg_len is None


def test_all_null_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "k int, n bigint")
    r = by_col(profile(df, distinct="exact"))["n"]
    assert r.null_count == 2 and r.distinct_count == 0 and r.min_int is None


def test_nan_is_largest_and_not_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    r = profile(df, distinct="exact").collect()[0]
    assert r.null_count == 1 and r.distinct_count == 2
    assert r.min_num == 1.0 and math.isnan(r.max_num)


def test_nested_and_other_types(spark):
    df = spark.sql("""SELECT array(1, 2) AS arr, named_struct('a', 1) AS st, map('k', 1) AS mp,
                             CAST('ab' AS BINARY) AS bin, true AS flag, CAST(1.25 AS DECIMAL(10,2)) AS dec,
                             DATE'2024-01-02' AS d, INTERVAL '1' DAY AS iv""")
    p = by_col(profile(df, distinct="exact"))
    assert {k: v.data_type for k, v in p.items()} == {
        "arr": "array", "st": "struct", "mp": "map", "bin": "binary", "flag": "boolean",
        "dec": "float", "d": "date", "iv": "unknown"}
    assert p["arr"].min_int is None and p["mp"].distinct_count == 1
    assert p["bin"].max_len == 2 and p["flag"].min_str is None
    assert p["dec"].min_num == 1.25 and p["dec"].min_str == "1.25"
    assert str(p["d"].min_ts) == "2024-01-02 00:00:00"


def test_invariants_and_batching(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    a = sorted(profile(li, "l", distinct="exact").collect())
    b = sorted(profile(li, "l", distinct="exact", batch_size=3).collect())
    assert a == b
    for r in a:
        assert r.null_count + (r.row_count - r.null_count) == r.row_count
        assert r.distinct_count <= r.row_count - r.null_count


def test_approx_close_to_exact(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    ex = by_col(profile(o, distinct="exact"))
    ap = by_col(profile(o, distinct="approx", rsd=0.01))
    for k, r in ex.items():
        assert ap[k].distinct_is_approx is True
        assert abs(ap[k].distinct_count - r.distinct_count) <= max(2, 0.05 * r.distinct_count)


def test_partials_merge_equal_profile(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    whole = by_col(profile(o, "orders", distinct="exact"))
    merged = by_col(merge_partials(profile_partials(
        o.withColumn("g", F.col("o_orderpriority")), ["g"], "orders", columns=o.columns)))
    for k, r in whole.items():
        m = merged[k]
        for f in ("row_count", "null_count", "min_int", "max_int", "min_num", "max_num",
                  "min_str", "max_str", "min_ts", "max_ts", "avg_len", "max_len"):
            assert getattr(m, f) == getattr(r, f), (k, f)
        assert abs(m.distinct_count - r.distinct_count) <= max(2, 0.05 * r.distinct_count)


def test_row_counts_and_tables(spark):
    t = {n: spark.read.parquet(f"{SF001}/{n}.parquet") for n in ("region", "nation")}
    assert {r.table_name: r.row_count for r in row_counts(t).collect()} == {"region": 5, "nation": 25}
    assert profile_tables(t).count() == 5


def test_one_scan_without_exact_distinct(spark):
    li = spark.read.parquet(f"{SF001}/lineitem.parquet")
    plan = profile(li, distinct="approx")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Expand" not in plan


def test_variant_and_interval_columns(spark):
    df = spark.sql("""SELECT parse_json('{"a": 1}') AS v, INTERVAL '2' HOUR AS iv, 1 AS k
                      UNION ALL SELECT parse_json('{"a": 2}'), INTERVAL '2' HOUR, 2""")
    for mode in ("exact", "approx"):
        p = by_col(profile(df, distinct=mode))
        assert p["v"].data_type == "unknown" and p["iv"].data_type == "unknown"
        assert p["k"].distinct_count == 2
    ex = by_col(profile(df, distinct="exact"))
    assert ex["v"].distinct_count == 2 and ex["iv"].distinct_count == 1


def test_digest_keys_equal_raw_values(spark):
    from lakelens.operators.profile import _fields, exact_distinct_counts
    df = spark.read.parquet(f"{SF001}/documents.parquet").unionByName(
        spark.read.parquet(f"{SF001}/documents.parquet").limit(50))
    f = _fields(df, None)
    got = dict(tuple(r) for r in exact_distinct_counts(df, f).collect())
    assert got == {i: df.select(c.name).distinct().count() for i, c in f}


def test_decimal_bounds_merge_as_numbers(spark):
    from lakelens.operators.profile import merge_partials, profile_partials
    df = spark.sql("""SELECT g, CAST(x AS DECIMAL(38,2)) AS d FROM VALUES (1, '9.10'), (2, '10.50'), (2, '-3.05'),
                      (3, '-3.5'), (3, '-0.50'), (4, '123456789012345678901234567890123456.78'), (4, NULL) AS t(g, x)""")
    r = by_col(merge_partials(profile_partials(df, ["g"]).drop("g")))["d"]
    assert (r.min_str, r.max_str) == ("-3.50", "123456789012345678901234567890123456.78")
    small = by_col(merge_partials(profile_partials(df.where("g < 3 and d > 0"), ["g"]).drop("g")))["d"]
    assert (small.min_str, small.max_str) == ("9.10", "10.50")


def test_unreachable_error_is_refused():
    import pytest
    from lakelens.operators.profile import lg_k_for
    assert lg_k_for(0.01) == 14
    for rsd in (0.0005, 0.5):
        with pytest.raises(ValueError):
            lg_k_for(rsd)


def test_retried_chunks_replace_themselves(spark, scratch):
    t = {"a": spark.range(3), "b": spark.range(4)}
    for _ in range(2):
        rows = profile_tables(t, out_path=f"{scratch}/profiles/retry", chunk=1).collect()
        assert sorted((r.table_name, r.row_count) for r in rows) == [("a", 3), ("b", 4)]


def test_awkward_names(spark):
    from lakelens.operators.profile import merge_partials, profile_partials
    names = ["a.b", "c d", "e`f", "g'h", "ünï", "back\\slash"]
    df = spark.createDataFrame([(1, "x", 2.5, "it's", 3, "p"), (2, None, None, "ok", 3, "q")],
                               names)
    for mode in ("exact", "approx", "none"):
        p = by_col(profile(df, "t'able", distinct=mode))
        assert set(p) == set(names)
        assert p["a.b"].max_int == 2 and p["c d"].null_count == 1 and p["g'h"].min_str == "it's"
        assert {r.table_name for r in p.values()} == {"t'able"}
    assert by_col(profile(df, distinct="exact"))["ünï"].distinct_count == 1
    m = by_col(merge_partials(profile_partials(df, [], "t'able")))
    assert m["back\\slash"].max_str == "q" and m["e`f"].null_count == 1


def test_profile_tables_written_in_chunks(spark, scratch):
    t = {n: spark.read.parquet(f"{SF001}/{n}.parquet") for n in ("region", "nation", "supplier")}
    inline = sorted(tuple(r) for r in profile_tables(t, distinct="exact").collect())
    written = profile_tables(t, out_path=f"{scratch}/profiles/chunked", chunk=2, distinct="exact")
    assert sorted(tuple(r) for r in written.select(*PROFILE_SCHEMA.names).collect()) == inline


def test_default_is_one_scan_approx(users):
    r = by_col(profile(users))
    assert r["age"].distinct_is_approx is True and r["age"].distinct_count == 2
    plan = profile(users)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan


def test_row_counts_one_job_and_empty_tables(spark):
    t = {"region": spark.read.parquet(f"{SF001}/region.parquet"),
         "none": spark.createDataFrame([], "a int")}
    got = {r.table_name: r.row_count for r in row_counts(t).collect()}
    assert got == {"region": 5, "none": 0}


def test_duplicate_column_names(spark):
    df = spark.createDataFrame([(1, "x"), (2, "y")], ["a", "b"]).selectExpr("a", "b", "a * 10 AS a")
    for mode in ("exact", "approx"):
        rows = sorted((r.ordinal, r.column_name, r.max_int) for r in profile(df, distinct=mode).collect())
        assert rows == [(1, "a", 2), (2, "b", None), (3, "a", 20)]


def test_profile_by_group_equals_profile_of_each_group(spark):
    from lakelens.operators.profile import profile_by_group
    o = spark.read.parquet(f"{SF001}/orders.parquet")
    g = profile_by_group(o, ["o_orderstatus"], "orders").collect()
    assert {r.o_orderstatus for r in g} == {"F", "O", "P"}
    for status in ("F", "P"):
        want = by_col(profile(o.where(F.col("o_orderstatus") == status).drop("o_orderstatus"), "orders",
                              distinct="exact"))
        got = {r.column_name: r for r in g if r.o_orderstatus == status}
        for k, r in want.items():
            assert (got[k].row_count, got[k].min_int, got[k].max_num, got[k].max_str, got[k].min_ts) == \
                   (r.row_count, r.min_int, r.max_num, r.max_str, r.min_ts)


def test_negative_zero_bounds_read_as_zero(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (-0.0,)], "x double")
    for mode in ("none", "approx", "exact"):
        r = profile(df, distinct=mode).collect()[0]
        assert math.copysign(1.0, r.min_num) == 1.0 and math.copysign(1.0, r.max_num) == 1.0, mode
        if mode == "exact":
            assert r.distinct_count == 1


def test_exact_path_derives_ltz_timestamps_and_booleans(spark):
    s2 = spark.newSession()
    s2.conf.set("spark.sql.session.timeZone", "America/New_York")
    df = s2.sql("""SELECT * FROM VALUES
        (TIMESTAMP'2024-03-10 01:30:00', true, 1.5D),
        (TIMESTAMP'2024-03-10 03:30:00', false, -0.0D),
        (CAST(NULL AS TIMESTAMP), true, NULL) AS t(ts, flag, x)""")
    exact = by_col(profile(df, "t", distinct="exact"))
    cheap = by_col(profile(df, "t", distinct="none"))
    for c in ("ts", "flag", "x"):
        for f in ("row_count", "null_count", "min_int", "max_int", "min_num", "max_num", "min_ts", "max_ts"):
            assert getattr(exact[c], f) == getattr(cheap[c], f), (c, f)
    assert exact["ts"].distinct_count == 2 and exact["flag"].distinct_count == 2 and exact["x"].distinct_count == 2
